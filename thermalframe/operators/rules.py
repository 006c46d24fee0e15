"""Threshold rules kept as small tables and joined to what they judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalframe import config as C


def kpi_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        C.KPI_RULES, "metric string, direction string, target double, warning double, critical double")


def kpi_levels(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, value, level): OK / WATCH (misses the target) / WARNING / CRITICAL."""
    v, below = F.col("value"), F.col("direction") == "below"

    def passed(limit: str) -> Column:
        return F.when(below, v > F.col(limit)).otherwise(v < F.col(limit))

    level = (F.when(v.isNull(), None).when(passed("critical"), "CRITICAL").when(passed("warning"), "WARNING")
             .when(passed("target"), "WATCH").otherwise("OK"))
    return measured.join(rules, "metric").select("metric", "value", level.alias("level"))


def operating_alerts(df: DataFrame, key: str, keep: tuple[str, ...] = (), rules=C.OPERATING_RULES) -> DataFrame:
    """(key, sensor, value, side): readings outside their operating range.

    The rules travel with the projection, so nothing is shuffled.
    """
    items = []
    for name, low, high in rules:
        v = F.col(name)
        side = F.when(v > high, F.lit("high")).when(v < low, F.lit("low"))
        items.append(F.struct(F.lit(name).alias("sensor"), v.alias("value"), side.alias("side")))
    return df.select(key, *keep, F.inline(F.array(*items))).where(F.col("side").isNotNull())


def retrain_triggers(drift: DataFrame, metrics: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row: which triggers fire, whether enough new rows exist, and the decision.

    ``drift`` has psi and status, ``metrics`` r2, ``new_rows`` one row (samples, age_days).
    """
    d = drift.agg(F.max("psi").alias("max_psi"), F.count_if(F.col("status") == "WARNING").alias("warnings"),
                  F.count_if(F.col("status") == "CRITICAL").alias("criticals"))
    one = d.withColumns({"min_r2": metrics.agg(F.min("r2")).scalar(), "samples": new_rows.select("samples").scalar(),
                         "age_days": new_rows.select("age_days").scalar()})
    out = one.withColumns({
        "psi_trigger": F.col("max_psi") > C.RETRAIN_PSI,
        "r2_trigger": F.col("min_r2") < C.RETRAIN_R2,
        "age_trigger": F.col("age_days") > C.RETRAIN_MAX_AGE_DAYS,
        "enough_samples": F.col("samples") >= C.RETRAIN_MIN_SAMPLES,
        "weekly_action": (F.col("max_psi") > C.PSI_THRESHOLD) | (F.col("warnings") > 1) | (F.col("criticals") > 0)})
    fires = F.col("psi_trigger") | F.col("r2_trigger") | F.col("age_trigger")
    return out.withColumn("retrain", fires & F.col("enough_samples"))


def model_acceptance(comparison: DataFrame, latency_ms: Column) -> DataFrame:
    """Adds ``decision``: accept, reject (clearly worse) or review, per target."""
    better = ((F.col("candidate_r2") >= F.col("baseline_r2")) & (F.col("candidate_mape") <= F.col("baseline_mape"))
              & (latency_ms < C.ACCEPT_MAX_LATENCY_MS))
    worse = (F.col("r2_gain_pct") < -C.REJECT_DEGRADATION_PCT) | (F.col("mape_gain_pct") < -C.REJECT_DEGRADATION_PCT)
    return comparison.withColumn("decision", F.when(better, "accept").when(worse, "reject").otherwise("review"))


def retention_filter(df: DataFrame, kind: Column, ts: str = "ts", days: dict[str, int] | None = None) -> DataFrame:
    """Keep rows not older than their kind's limit, counted back from the newest row."""
    days = days or C.RETENTION_DAYS
    newest = df.agg(F.max(ts)).first()[0]
    if newest is None:
        return df
    keep = F.lit(True)
    for name, n in days.items():
        limit = F.lit(newest).cast("timestamp") - F.make_dt_interval(F.lit(n))
        keep = F.when(kind == name, F.col(ts) >= limit).otherwise(keep)
    return df.where(keep)


def input_availability(df: DataFrame, inputs: list[str], minimum: float = C.MIN_INPUT_SHARE) -> DataFrame:
    """Adds the share of known inputs per row and whether it reaches the minimum."""
    known = F.array(*[F.col(c).isNotNull() for c in inputs])
    share = F.size(F.filter(known, lambda x: x)) / F.lit(float(len(inputs)))
    return df.withColumn("input_share", share).withColumn("usable", share >= minimum)


def leaking_columns(features: list[str], targets=C.TARGETS) -> list[str]:
    return [t for t in targets if t in features]


def missing_physics_inputs(features: list[str]) -> list[str]:
    return [c for c in C.PHYSICS_INPUTS if c not in features]


