"""Cleaning rules that need one row only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.scalars import clip


def is_temperature(name: str) -> bool:
    return name.endswith("T") or "temp" in name.lower() or "AMBT" in name


def is_flow(name: str) -> bool:
    return name.endswith("F") or "flow" in name.lower()


def may_not_be_negative(name: str) -> bool:
    return "F" in name or "flow" in name.lower()


def limits_of(name: str) -> tuple[float, float] | None:
    if name == "UCAIH":
        return C.HUMIDITY_LIMITS
    if is_temperature(name):
        return C.TEMPERATURE_LIMITS
    if is_flow(name):
        return C.FLOW_LIMITS
    return None


def column_class(name: str) -> str:
    if is_temperature(name):
        return "temperature"
    if is_flow(name):
        return "flow"
    return "other"


def sentinel_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Saturation codes (0 included) become missing; the air flow also from 65534 upwards."""
    out = {}
    for c in columns:
        kept = ~F.col(c).isin(*C.SENTINELS)
        if c == "UCAF":
            kept = kept & (F.col(c) < C.FLOW_SATURATION)
        out[c] = F.when(kept, F.col(c))
    return df.withColumns(out)


def fix_negative_flows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = {c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns if may_not_be_negative(c)}
    return df.withColumns(out) if out else df


def clip_physical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = {c: clip(F.col(c), *limits_of(c)) for c in columns if limits_of(c)}
    return df.withColumns(out) if out else df


def clip_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, clipped): how many values lie outside the physical limits; one pass."""
    limited = [c for c in columns if limits_of(c)]
    row = df.agg(*[F.count_if((F.col(c) < limits_of(c)[0]) | (F.col(c) > limits_of(c)[1])).alias(c) for c in limited])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("clipped")) for c in limited])))


def bound(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sentinels, negative flows and physical limits in that order, as one expression per column."""
    out = {}
    for c in columns:
        x = F.col(c)
        missing = x.isin(*C.SENTINELS)
        if c == "UCAF":
            missing = missing | (x >= C.FLOW_SATURATION)
        low, high = limits_of(c) or (None, None)
        if may_not_be_negative(c):
            low = max(low or 0.0, 0.0)
        fixed = F.when(missing, None)
        if low is not None:
            fixed = fixed.when(x < low, F.lit(low))
        if high is not None:
            fixed = fixed.when(x > high, F.lit(high))
        out[c] = fixed.otherwise(x)
    return df.withColumns(out)


def physics_flags(df: DataFrame) -> DataFrame:
    """Mark implausible temperature differences; rows are kept."""
    out = {}
    if {"UCWIT", "UCWOT"} <= set(df.columns):
        out["water_delta_T"] = F.coalesce(F.abs(F.col("UCWIT") - F.col("UCWOT")) > C.MAX_DELTA_T, F.lit(False))
    if {"UCAIT", "UCAOT"} <= set(df.columns):
        out["air_delta_T"] = F.coalesce(F.abs(F.col("UCAOT") - F.col("UCAIT")) > C.MAX_DELTA_T, F.lit(False))
    return df.withColumns(out) if out else df


def default_inputs(df: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Missing optional inputs get their serving default (0.0 where none is named)."""
    defaults = C.SERVING_DEFAULTS if defaults is None else defaults
    present = [c for c in df.columns if c in C.INPUT_SENSORS]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(defaults.get(c, 0.0))) for c in present})


def validate_ranges(df: DataFrame, rules=C.RANGE_RULES) -> DataFrame:
    """Adds ``failed`` (names of broken closed-range rules, a missing value breaks its rule) and ``valid``."""
    checks = [F.when(F.col(c).between(lo, hi), None).otherwise(F.lit(c)) for c, lo, hi in rules if c in df.columns]
    failed = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.withColumn("failed", failed).withColumn("valid", F.size("failed") == 0)
