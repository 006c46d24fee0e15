"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL here; NaN would poison averages and be counted as present."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    """Bound a value and keep NULL (``least``/``greatest`` would skip the NULL)."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def relu(c: Column) -> Column:
    return F.when(c > 0, c).when(c.isNotNull(), F.lit(0.0))


def is_inf(c: Column) -> Column:
    return F.abs(c) == F.lit(INF)


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero divisor, in ANSI mode too."""
    return num / F.when(den != 0, den)


def null_share(c: str) -> Column:
    return F.avg(F.col(c).isNull().cast("double"))


def wide_to_rows(row_df: DataFrame, columns: list[str], fields: dict[str, str],
                 name: str = "column") -> DataFrame:
    """Turn one row of ``<column>__<stat>`` values into one row per column.

    ``fields`` maps the output name to the suffix it is read from.
    """
    items = F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"`{c}__{suffix}`").alias(out) for out, suffix in fields.items()])
        for c in columns
    ])
    return row_df.select(F.inline(items))


def to_long(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = (),
            name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (kept keys, column) pair; a projection, no shuffle."""
    items = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(items))
