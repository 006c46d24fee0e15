"""The sensor view over the event table, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENSORS = ("UCWIT", "UCWOT", "UCAIT", "UCAOT", "UCWF", "UCAF", "UCAIH", "AMBT", "UCTSP", "UCFS", "UCWDP")
ORDER = "sample_id"
UNIT = "unit_id"
UNIT_ROWS = 2500


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def sensor_view(e: DataFrame) -> DataFrame:
    """Sensor readings of event rows, batch or stream.

    The JSON field is read once per row in a projection of its own; it is needed
    by five columns.
    """
    with_k = e.select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"),
                      F.get_json_object("props", "$.k").cast("int").alias("k"))
    return with_k.select(*_sensor_columns())


def _sensor_columns() -> list[Column]:
    e, u, v, k = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("k")

    def d(x) -> Column:
        return F.lit(float(x))

    no_inlet = e.between(3000, 3014) | ((e % 11).between(3, 9) & (e % 77 < 22))
    room = d(18) + (u % 20) / d(2)
    return [
        e.alias(ORDER), F.col("ts"), F.expr(f"event_id div {UNIT_ROWS}").alias(UNIT),
        F.when(~no_inlet, d(6) + k / d(8)).alias("UCWIT"),
        F.when(e % 13 == 5, None).when(e % 211 == 0, d(14999.8)).otherwise(d(8) + k / d(8) + v / d(100)).alias("UCWOT"),
        F.when(e % 17 != 2, room).alias("UCAIT"),
        F.when(e % 199 == 0, d(-273.2)).otherwise(room + v / d(50)).alias("UCAOT"),
        F.when(e % 29 == 0, -v).when(e % 31 == 0, d(0)).otherwise(d(3) * v).alias("UCWF"),
        F.when(e % 97 == 0, d(65535)).when(e % 101 == 0, d(65534)).otherwise(d(372) + d(20) * v).alias("UCAF"),
        F.when(e % 4 == 0, d(40) + k / d(4)).alias("UCAIH"),
        (d(15) + (e % 160) / d(8)).alias("AMBT"),
        F.when(e % 23 != 7, d(21) + F.expr("(event_id div 500) % 15").cast("double")).alias("UCTSP"),
        (d(800) + ((e * 37) % 700).cast("double")).alias("UCFS"),
        F.when(e % 19 == 0, d(0)).otherwise(k / d(25)).alias("UCWDP"),
    ]


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reading: ``sample_id`` (unique, in time order), ``ts``, ``unit_id`` and the sensors."""
    return sensor_view(events(spark, sf_dir))
