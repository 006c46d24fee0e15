"""Scalers as parameter tables: fit on the training rows, apply anywhere, undo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.scalars import to_long, wide_to_rows
from thermalframe.operators.quantiles import grouped_quantiles, settle

METHODS = ("standard", "robust", "minmax")


def _guard(scale: Column) -> Column:
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def fit_scaler(train: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """(column, center, scale): mean and population deviation, median and quartile range, or min and range."""
    aggs = []
    if method == "standard":
        for c in columns:
            aggs += [F.avg(c).alias(f"{c}__center"), _guard(F.stddev_pop(c)).alias(f"{c}__scale")]
    elif method == "robust":
        table = grouped_quantiles(to_long(train, columns, name="column"), ["column"], "value", (0.25, 0.5, 0.75))
        return table.select("column", F.col("q")[1].alias("center"),
                            _guard(settle(F.col("q")[2] - F.col("q")[0])).alias("scale"))
    elif method == "minmax":
        for c in columns:
            aggs += [F.min(c).alias(f"{c}__center"), _guard(F.max(c) - F.min(c)).alias(f"{c}__scale")]
    else:
        raise ValueError(f"unknown scaling method: {method}")
    return wide_to_rows(train.agg(*aggs), list(columns), {"center": "center", "scale": "scale"})


def params_of(table: DataFrame) -> dict[str, tuple[float, float]]:
    """Parameters on the driver: one row per column."""
    return {r["column"]: (r["center"], r["scale"]) for r in table.collect()}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in params.items() if c in df.columns})


def invert_scaler(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "",
                  out_suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{out_suffix}": F.col(f"{c}{suffix}") * F.lit(s) + F.lit(m)
                           for c, (m, s) in params.items() if f"{c}{suffix}" in df.columns})


def fit_regime_scaler(train: DataFrame, columns: Sequence[str], regime: str, method: str = "standard",
                      min_rows: int = C.MIN_REGIME_ROWS) -> DataFrame:
    """(regime, column, center, scale) for every regime with more than ``min_rows`` training rows."""
    rows = train.where(F.col(regime).isNotNull())
    sizes = rows.groupBy(regime).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > min_rows)
    long = to_long(rows, columns, keep=[regime], name="column")
    if method == "robust":
        q = grouped_quantiles(long, [regime, "column"], "value", (0.25, 0.5, 0.75))
        stats = q.select(regime, "column", F.col("q")[1].alias("center"),
                         _guard(settle(F.col("q")[2] - F.col("q")[0])).alias("scale"))
    elif method == "standard":
        stats = long.groupBy(regime, "column").agg(
            F.avg("value").alias("center"), _guard(F.stddev_pop("value")).alias("scale"))
    elif method == "minmax":
        stats = long.groupBy(regime, "column").agg(
            F.min("value").alias("center"), _guard(F.max("value") - F.min("value")).alias("scale"))
    else:
        raise ValueError(f"unknown scaling method: {method}")
    return stats.join(sizes.select(regime), regime, "left_semi")


def apply_regime_scaler(df: DataFrame, params: DataFrame, columns: Sequence[str], regime: str,
                        suffix: str = "_scaled") -> DataFrame:
    """Scale each row with its own regime's parameters; a regime without parameters gives NULL.

    Spark broadcasts the parameter table while it is below its broadcast limit
    and otherwise joins by shuffle, so no hint is given.
    """
    wide = params.groupBy(regime).pivot("column", list(columns)).agg(
        F.first("center").alias("center"), F.first("scale").alias("scale"))
    joined = df.join(wide, regime, "left")
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"`{c}_center`")) / F.col(f"`{c}_scale`") for c in columns}
    return joined.withColumns(scaled).select(*df.columns, *scaled)
