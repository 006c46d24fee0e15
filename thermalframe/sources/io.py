"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermalframe import config as C
from thermalframe.functions.scalars import nan_to_null


def sensor_schema(columns: Sequence[str], order: str | None = None) -> T.StructType:
    head = [T.StructField(order, T.LongType())] if order else []
    return T.StructType(head + [T.StructField(c, T.DoubleType()) for c in columns])


def read_sensor_csv(spark: SparkSession, path: str, schema: T.StructType, readings: Sequence[str] | None = None,
                    sep: str = ";") -> DataFrame:
    """Semicolon CSV with blanks after the separator; rows without any reading are dropped.

    ``readings`` are all columns of doubles unless named; an order column is no reading.

    An explicit schema keeps the read to one pass. Give the file an order column:
    lines have no position once they are split over tasks.
    """
    raw = spark.read.csv(path, schema=schema, sep=sep, header=True, ignoreLeadingWhiteSpace=True,
                         ignoreTrailingWhiteSpace=True)
    names = list(readings or (f.name for f in schema if isinstance(f.dataType, T.DoubleType)))
    return nan_to_null(raw).dropna("all", subset=names)


def read_reference_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma CSV of reference or current readings."""
    return nan_to_null(spark.read.csv(path, schema=schema, header=True))


def dataset_metadata(df: DataFrame) -> DataFrame:
    """(column, dtype, ordinal, rows)."""
    items = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                      F.lit(i).cast("bigint").alias("ordinal")) for i, f in enumerate(df.schema.fields)]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*items)), "rows")


def role_presence(df: DataFrame) -> DataFrame:
    """(role, name, present, known): which key columns exist and how many known values they have."""
    wanted = [("target", n) for n in C.KEY_TARGETS] + [("input", n) for n in C.KEY_INPUTS]
    have = [n for n in dict.fromkeys(n for _, n in wanted) if n in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(n).alias(n) for n in have])
    items = [F.struct(F.lit(r).alias("role"), F.lit(n).alias("name"), F.lit(n in have).alias("present"),
                      (F.col(n) if n in have else F.lit(0).cast("bigint")).alias("known")) for r, n in wanted]
    return row.select(F.inline(F.array(*items)))


def write_dataset(df: DataFrame, path: str, params: DataFrame | None = None, metadata: DataFrame | None = None,
                  split: str = "split") -> None:
    """Parquet partitioned by split, so that reading one part prunes the others; parameters and metadata beside it."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")
    if params is not None:
        params.write.mode("overwrite").parquet(f"{path}/scaler")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_results(table: DataFrame, path: str) -> None:
    """A result table (one row per model, set and target) as a single CSV file."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def union_history(training: DataFrame, new: DataFrame) -> DataFrame:
    """Append new data; columns one side lacks become missing."""
    return training.unionByName(new, allowMissingColumns=True)
