"""Exact quantiles and empirical distribution functions at any size.

Equal values merge into counts before anything moves. The counts are then cut
into ranges of (group, value) and written once to the shared folder, so a group
of any size lies in as many ranges as it needs. Ranks are found in two levels:
the sums of the ranges of a group say which range holds a rank, and only inside
that range are values brought into order. No sketch, no bound on the number of
rows, and the same way for every size; a missing group key is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalframe.functions.scalars import to_long
from thermalframe.operators.blocks import named_series
from thermalframe.session import cut_lineage

DECIMALS = 9
NOISE = 1e-12
_PART = "__part"


def settle(x: Column) -> Column:
    """Take off interpolation noise.

    Sensors report short decimals, so a quantile that is a reading, or lies on the
    same grid, must equal it exactly when used as a bound or a bin edge. A value
    within ``NOISE`` of a nine-digit decimal is that decimal; others stay as they are.
    """
    short = F.round(x, DECIMALS)
    return F.when(F.abs(x - short) <= NOISE * F.greatest(F.lit(1.0), F.abs(x)), short).otherwise(x)


def settled(x: float) -> float:
    """``settle`` for a number on the driver."""
    short = round(x, DECIMALS)
    return short if abs(x - short) <= NOISE * max(1.0, abs(x)) else x


def _rounded(q: Column, probs: Sequence[float]) -> Column:
    """The smallest and the largest value are readings and stay untouched."""
    return F.array(*[q[i] if p in (0.0, 1.0) else settle(q[i]) for i, p in enumerate(probs)])


def ranged(counts: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """``counts`` (one row per group and value) in ranges of (group, value), with the range's number ``__part``."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, _ = named_series(counts, keys)
    placed = placed.repartitionByRange(parts, *keys, value).withColumn(_PART, F.spark_partition_id())
    return cut_lineage(placed)


def _by(names: Sequence[str]) -> list:
    return [F.col(n) for n in names] or [F.lit(0)]


def quantiles_of(placed: DataFrame, keys: Sequence[str], weight: str, probs: Sequence[float], value: str = "v") -> DataFrame:
    """(keys, n, q) from a ``ranged`` table: linear-interpolated quantiles of each group's values, counted ``weight`` times."""
    _, names = named_series(placed, keys)
    placed = placed.where(F.col(weight) > 0)
    sums = placed.groupBy(*keys, *names, _PART).agg(F.sum(weight).alias("__n"))          # one row per range and group
    group = Window.partitionBy(*_by(names))
    sums = sums.withColumns({"n": F.sum("__n").over(group), "__before": F.coalesce(
        F.sum("__n").over(group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranks = [F.struct(F.lit(2 * i + up).alias("__i"), side(F.lit(float(p)) * (F.col("n") - 1)).cast("bigint").alias("__rank"))
             for i, p in enumerate(probs) for up, side in ((0, F.floor), (1, F.ceil))]
    wanted = (sums.select(*keys, *names, _PART, "n", "__n", "__before", F.inline(F.array(*ranks)))
              .where("__rank >= __before and __rank < __before + __n")
              .select(*keys, *names, _PART, "n", "__i", (F.col("__rank") - F.col("__before")).alias("__at")))
    on = [*names, _PART]
    inside = Window.partitionBy(*_by(on)).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    held = placed.select(*on, value, weight).join(wanted.select(*on).distinct(), on, "left_semi")
    held = held.withColumn("__cum", F.sum(weight).over(inside))
    hits = held.join(wanted, on).where((F.col("__at") < F.col("__cum")) & (F.col("__at") >= F.col("__cum") - F.col(weight)))
    found = hits.groupBy(*keys, *names, "n").agg(*[
        F.max(F.when(F.col("__i") == j, F.col(value))).alias(f"__{j}") for j in range(2 * len(probs))])
    outs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"__{2 * i}"), F.col(f"__{2 * i + 1}")
        outs.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))))
    return found.select(*keys, "n", F.array(*outs).alias("q")).select(*keys, "n", _rounded(F.col("q"), probs).alias("q"))


def grouped_quantiles(long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, n, q): exact linear-interpolated quantiles of the known values of each group."""
    known = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    counts = known.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("__c"))
    return quantiles_of(ranged(counts, list(keys)), list(keys), "__c", probs)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of whole columns, returned to the driver: one short list per column."""
    columns = list(columns)
    if not columns:
        return {}
    table = grouped_quantiles(to_long(df, columns), ["feature"], "value", probs)
    found = {r["feature"]: list(r["q"]) for r in table.collect()}
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def value_counts(long: DataFrame, key: str, value: str, is_reference: Column) -> DataFrame:
    """(key, v, r, c): how often each value occurs on either side; equal values merge before the shuffle."""
    known = long.where(F.col(value).isNotNull()).select(
        F.col(key), F.col(value).cast("double").alias("v"), is_reference.alias("__ref"))
    return known.groupBy(key, "v").agg(F.count_if("__ref").alias("r"), F.count_if(~F.col("__ref")).alias("c"))


def ks_of(placed: DataFrame, key: str) -> DataFrame:
    """(key, n_ref, n_cur, ks) from a ``ranged`` table of ``value_counts``: running shares inside each range, and the
    ranges' totals added up before them."""
    _, names = named_series(placed, [key])
    sums = placed.groupBy(*names, _PART).agg(F.sum("r").alias("__r"), F.sum("c").alias("__c"))
    group = Window.partitionBy(*names)
    before = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, _PART, F.sum("__r").over(group).alias("n_ref"), F.sum("__c").over(group).alias("n_cur"),
                       F.coalesce(F.sum("__r").over(before), F.lit(0)).alias("__r"),
                       F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c"))
    # An empty side has no distribution: its divisor is NULL, and so is the distance.
    n_ref, n_cur = F.nullif("n_ref", F.lit(0)), F.nullif("n_cur", F.lit(0))
    inside = Window.partitionBy(*names, _PART).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select(key, *names, _PART, F.sum("r").over(inside).alias("__ri"), F.sum("c").over(inside).alias("__ci"))
    gap = F.abs((F.col("__r") + F.col("__ri")) / n_ref - (F.col("__c") + F.col("__ci")) / n_cur)
    return run.join(sums, [*names, _PART]).groupBy(key, "n_ref", "n_cur").agg(F.max(gap).alias("ks"))


def ks_distance(long: DataFrame, key: str, value: str, is_reference: Column) -> DataFrame:
    """(key, n_ref, n_cur, ks): largest distance of two empirical distribution functions per key."""
    return ks_of(ranged(value_counts(long, key, value, is_reference), [key]), key)


def kolmogorov_p(d: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample distance ``d``."""
    n_both = F.nullif((n_ref + n_cur).cast("double"), F.lit(0.0))
    lam2 = d * d * (n_ref * n_cur / n_both)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2))
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
