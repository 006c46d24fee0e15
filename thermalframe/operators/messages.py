"""Message envelopes, topic routing and the tall point form of sensor rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.scalars import to_long

RETAINED_PREFIXES = (C.ALERT_TOPIC_PREFIX, C.STATUS_TOPIC)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def sensor_message(ts: Column, columns: Sequence[str]) -> list[Column]:
    """topic and payload of a sensor reading; missing sensors are absent from the payload."""
    data = F.struct(*[F.col(c) for c in columns])
    return [F.lit(C.SENSOR_TOPIC).alias("topic"),
            F.to_json(F.struct(iso(ts).alias("timestamp"), data.alias("data"))).alias("payload")]


def prediction_message(ts: Column, fields: dict[str, Column]) -> list[Column]:
    body = F.struct(*[c.alias(n) for n, c in fields.items()])
    return [F.lit(C.PREDICTION_TOPIC).alias("topic"),
            F.to_json(F.struct(iso(ts).alias("timestamp"), body.alias("prediction"))).alias("payload")]


def alert_message(ts: Column, kind: Column, message: Column, severity: Column) -> list[Column]:
    """The topic ends in the lower-case severity."""
    return [F.concat(F.lit(C.ALERT_TOPIC_PREFIX), F.lower(severity)).alias("topic"),
            F.to_json(F.struct(iso(ts).alias("timestamp"), kind.alias("type"), message.alias("message"),
                               severity.alias("severity"))).alias("payload")]


def status_message(ts: Column, status: Column, details: dict[str, Column]) -> list[Column]:
    body = F.struct(*[c.alias(n) for n, c in details.items()])
    return [F.lit(C.STATUS_TOPIC).alias("topic"),
            F.to_json(F.struct(iso(ts).alias("timestamp"), status.alias("status"), body.alias("details"))).alias("payload")]


def alerts_from_drift(drift: DataFrame, ts: Column) -> DataFrame:
    """One alert per feature that is not stable."""
    text = F.concat(F.lit("Feature drift in "), F.col("feature"))
    return drift.where(F.col("status") != "STABLE").select(
        "feature", *alert_message(ts, F.lit("drift"), text, F.col("status")))


def parse_messages(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``valid`` (payload is JSON), ``sent`` (its timestamp) and ``data`` (map of readings)."""
    if dict(messages.dtypes)[payload] == "binary":
        messages = messages.withColumn(payload, F.decode(payload, "UTF-8"))
    body = F.from_json(payload, "timestamp string, data map<string,double>")
    return (messages.withColumn("valid", F.coalesce(F.try_parse_json(payload).isNotNull(), F.lit(False)))
            .withColumn("__body", F.when(F.col("valid"), body))
            .withColumn("sent", F.to_timestamp("__body.timestamp")).withColumn("data", F.col("__body.data"))
            .drop("__body"))


def split_valid(parsed: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead-letter rows with a reason)."""
    dead = parsed.where(~F.col("valid")).withColumn("reason", F.lit("invalid JSON"))
    return parsed.where("valid"), dead


def topic_regex(pattern: str) -> str:
    """Topic filter to regular expression: ``+`` is one level, ``#`` is this level and all below."""
    levels = pattern.split("/")
    out = ""
    for i, level in enumerate(levels):
        if level == "#":
            if i != len(levels) - 1:
                raise ValueError("# must be the last level")
            out += "(/.*)?" if i else ".*"
        else:
            out += ("/" if i else "") + ("[^/]+" if level == "+" else re.escape(level))
    return f"^{out}$"


def route(messages: DataFrame, routes: Sequence[tuple[str, str]], topic: str = "topic") -> DataFrame:
    """One row per (message, matching handler). The route list is part of the plan, so nothing is joined."""
    hits = F.array(*[F.when(F.col(topic).rlike(topic_regex(p)),
                            F.struct(F.lit(p).alias("pattern"), F.lit(h).alias("handler"))) for p, h in routes])
    return messages.select("*", F.inline(F.filter(hits, lambda h: h.isNotNull())))


def retained_latest(messages: DataFrame, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """(topic, payload, ts): newest alert or status per topic; works as a stream aggregation too."""
    keep = F.lit(False)
    for p in RETAINED_PREFIXES:
        keep = keep | F.col("topic").startswith(p)
    at = F.struct(ts, tie) if tie else F.struct(ts)
    return (messages.where(keep).groupBy("topic")
            .agg(F.max_by("payload", at).alias("payload"), F.max(ts).alias(ts)))


def point_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.POINT_MAP, "name string, object_type string, instance int")


def points_read(points: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Tall (key, object_type, instance, value) readings to one wide row per key.

    Only input points are read and failed reads stay empty. The mapping is a
    fixed table of ten rows, hence the broadcast.
    """
    names = [n for n, t, _ in C.POINT_MAP if t == "analogInput"]
    inputs = mapping.where(F.col("object_type") == "analogInput")
    joined = points.join(F.broadcast(inputs), ["object_type", "instance"])
    return joined.groupBy(key).pivot("name", names).agg(F.max("value"))


def points_write(predictions: DataFrame, mapping: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Wide predictions to (key, name, object_type, instance, value); unmapped names are not written."""
    outputs = mapping.where(F.col("object_type") == "analogValue")
    long = to_long(predictions, columns, keep=[key], name="name").where(F.col("value").isNotNull())
    return long.join(F.broadcast(outputs), "name").select(key, "name", "object_type", "instance", "value")
