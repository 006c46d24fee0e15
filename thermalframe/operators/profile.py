"""Profiles and quality checks: all columns and all statistics in one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.cleaning import may_not_be_negative
from thermalframe.functions.scalars import is_inf, to_long, wide_to_rows
from thermalframe.operators.quantiles import column_quantiles, settled
from thermalframe.session import cut_lineage

HISTOGRAM_BINS = 50


def quantile_literals(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[Column]]:
    """Exact quantiles of each column as literals for the caller's projection."""
    found = column_quantiles(df, columns, probs)
    return {c: [F.lit(q).cast("double") for q in found[c]] for c in columns}


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max)."""
    q = quantile_literals(df, columns, (0.25, 0.5, 0.75))
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                 F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    row = df.agg(*aggs).select("*", *[q[c][i].alias(f"{c}__q{p}") for c in columns for i, p in enumerate((25, 50, 75))])
    names = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")
    return wide_to_rows(row, list(columns), {n: n for n in names})


def unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique): exact distinct known values; equal values are merged before the shuffle."""
    pairs = to_long(df, columns, name="column").where(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def summary_extended(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe`` plus bias-corrected skew and kurtosis, missing, zero and distinct counts."""
    aggs = []
    for c in columns:
        aggs += [F.count(F.lit(1)).alias(f"{c}__rows"), F.count(c).alias(f"{c}__n"),
                 F.skewness(c).alias(f"{c}__skew"), F.kurtosis(c).alias(f"{c}__kurt"),
                 F.count_if(F.col(c) == 0).alias(f"{c}__zeros")]
    more = wide_to_rows(df.agg(*aggs), list(columns),
                        {"rows": "rows", "n": "n", "g1": "skew", "g2": "kurt", "zeros": "zeros"})
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6.0))
    more = more.select(
        "column", skew.alias("skew"), kurt.alias("kurtosis"), (F.col("rows") - F.col("n")).alias("missing"),
        (F.round((F.col("rows") - F.col("n")) / F.col("rows") * 100, 2)).alias("missing_pct"),
        "zeros", F.round(F.col("zeros") / F.col("rows") * 100, 2).alias("zeros_pct"))
    return (describe(df, columns).join(more, "column")
            .join(unique_counts(df, columns), "column", "left")
            .withColumn("unique", F.coalesce("unique", F.lit(0))))


def basic_info(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, columns, nulls, null_pct)."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}__nulls`").alias("nulls")) for c in columns])
    return (row.select("rows", F.lit(len(columns)).cast("bigint").alias("columns"), F.inline(items))
            .withColumn("null_pct", F.round(F.col("nulls") / F.col("rows") * 100, 4)))


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (basic_info(df, columns).select("column", "nulls", "null_pct")
            .orderBy(F.desc("null_pct"), "column"))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(duplicates): rows beyond the first of identical rows; NULL equals NULL."""
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates")))


def duplicate_rows_by_digest(df: DataFrame, columns: Sequence[str], digest: Column | None = None) -> DataFrame:
    """(duplicates) as ``duplicate_rows``, with far less moved where few rows repeat.

    Digests of the rows are counted first; whole rows are compared only where a digest repeats, so digests that clash
    change the work and not the result.
    """
    if digest is None:
        digest = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    repeated = df.groupBy(digest.alias("__digest")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__digest")
    again = df.select(digest.alias("__digest"), *columns).join(cut_lineage(repeated), "__digest", "left_semi")
    return duplicate_rows(again, columns)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, constant): at most one distinct known value, found by min = max."""
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("constant")) for c in columns])))


def quality_report(df: DataFrame, columns: Sequence[str], categorical: int = 0) -> DataFrame:
    """(check, column, value): missing, overall missing, duplicates, column kinds, constants, infinities."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"),
                 F.count_if(is_inf(F.col(c))).alias(f"{c}__inf"),
                 F.coalesce(F.min(c) == F.max(c), F.lit(True)).cast("bigint").alias(f"{c}__constant")]
    row = df.agg(*aggs)
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}__nulls`") for c in columns])

    def item(check: str, column: str | None, value: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                        value.cast("double").alias("value"))

    whole = [item("total_missing_cells", None, total),
             item("missing_pct_overall", None, F.round(total / (F.col("rows") * len(columns)) * 100, 2)),
             item("numeric_columns", None, F.lit(len(columns))),
             item("categorical_columns", None, F.lit(categorical))]
    per_column = [item(check, c, F.col(f"`{c}__{s}`")) for c in columns
                  for check, s in (("missing", "nulls"), ("constant", "constant"), ("infinite", "inf"))]
    found = row.select(F.inline(F.array(*whole, *per_column))).where(F.col("column").isNull() | (F.col("value") > 0))
    repeated = item("duplicated_rows", None, F.col("duplicates"))
    return found.unionByName(duplicate_rows(df, columns).select(F.inline(F.array(repeated))))


def quality_issues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(issue, column, value): only what is wrong."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        x = F.col(c)
        aggs += [F.count_if(x.isNull()).alias(f"{c}__missing_values"),
                 F.coalesce(F.min(c) == F.max(c), F.lit(True)).cast("bigint").alias(f"{c}__constant_column"),
                 F.count_if(x == 0).alias(f"{c}__zeros"), F.count_if(is_inf(x)).alias(f"{c}__infinite_values")]
        if may_not_be_negative(c):
            aggs.append(F.count_if(x < 0).alias(f"{c}__negative_flow_values"))
    items = []
    for c in columns:
        zero_pct = F.col(f"`{c}__zeros`") / F.col("rows") * 100
        values = {k: F.col(f"`{c}__{k}`").cast("double") for k in ("missing_values", "constant_column", "infinite_values")}
        values["high_zero_percentage"] = F.when(zero_pct > 50, F.round(zero_pct, 2)).otherwise(0.0)
        if may_not_be_negative(c):
            values["negative_flow_values"] = F.col(f"`{c}__negative_flow_values`").cast("double")
        items += [F.struct(F.lit(k).alias("issue"), F.lit(c).alias("column"), v.alias("value")) for k, v in values.items()]
    return df.agg(*aggs).select(F.inline(F.array(*items))).where("value > 0")


def variable_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std")]
    rows = wide_to_rows(df.agg(*aggs), list(columns), {n: n for n in ("min", "max", "mean", "std")})
    return rows.select("column", *[F.round(n, 3).alias(n) for n in ("min", "max", "mean", "std")],
                       F.round(F.col("max") - F.col("min"), 3).alias("range"))


def _merge(old: list | None, new: list) -> list:
    """Combine two sets of pairwise counts, means and centred products."""
    if old is None:
        return new
    n1, x1, y1, xx1, yy1, xy1 = old
    n2, x2, y2, xx2, yy2, xy2 = new
    n = n1 + n2
    share = np.divide(n2, n, out=np.zeros_like(n), where=n > 0)
    dx, dy = np.where(n1 > 0, x2 - x1, 0.0), np.where(n1 > 0, y2 - y1, 0.0)
    both = n1 * share
    return [n, np.where(n1 > 0, x1 + dx * share, x2), np.where(n1 > 0, y1 + dy * share, y2),
            xx1 + xx2 + dx * dx * both, yy1 + yy2 + dy * dy * both, xy1 + xy2 + dx * dy * both]


def _products(x: np.ndarray) -> list:
    """Pairwise-complete counts, means and centred products of the columns of one batch."""
    known = ~np.isnan(x)
    m = known.astype("float64")
    shift = np.divide(np.where(known, x, 0.0).sum(0), m.sum(0), out=np.zeros(x.shape[1]), where=m.sum(0) > 0)
    z = np.where(known, x - shift, 0.0)
    n = m.T @ m
    safe = np.where(n > 0, n, 1.0)
    sx, sxx, sxy = z.T @ m, (z * z).T @ m, z.T @ z
    mx = sx / safe
    return [n, mx + shift[:, None], mx.T + shift[None, :], sxx - n * mx * mx, (sxx - n * mx * mx).T, sxy - n * mx * mx.T]


def _pair_corr(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) for the given pairs; rows with a missing side are skipped per pair.

    All pairs together are a few matrix products per Arrow batch, against one
    aggregate per pair and row otherwise. A task emits one line per pair, and
    these lines are combined by a grouped aggregation.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(names)}
    rows, cols = np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), "float64") for c in batch.columns])
                state = _merge(state, _products(x))
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int32()), *[pa.array(s[rows, cols]) for s in state]],
                names=["pair", "n", "x", "y", "xx", "yy", "xy"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(
        partial, "pair int, n double, x double, y double, xx double, yy double, xy double").where("n > 0")
    whole = Window.partitionBy("pair")     # one line per task
    n = F.sum("n").over(whole)
    centred = parts.withColumns({
        "dx": F.col("x") - F.sum(F.col("n") * F.col("x")).over(whole) / n,
        "dy": F.col("y") - F.sum(F.col("n") * F.col("y")).over(whole) / n})

    def total(within: str, a: str, b: str) -> Column:
        return F.sum(F.col(within) + F.col("n") * F.col(a) * F.col(b))

    table = centred.groupBy("pair").agg(total("xx", "dx", "dx").alias("xx"), total("yy", "dy", "dy").alias("yy"),
                                        total("xy", "dx", "dy").alias("xy"), F.sum("n").alias("n"))
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    # NaN compares greater than any number: a pair with an infinite value has no correlation.
    finite = (F.abs(spread) < float("inf")) & (F.abs("xy") < float("inf"))
    r = F.when((F.col("n") > 1) & finite & (spread > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / spread)))
    labels = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return labels.join(table.select("pair", r.alias("r")), "pair", "left").select("a", "b", "r")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every ordered pair of columns, the diagonal included."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    upper = _pair_corr(df, pairs)
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "r"))).otherwise(
        F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")))
    return upper.select(F.inline(both))


def high_corr_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return (_pair_corr(df, pairs).where(F.abs("r") >= threshold)
            .select("a", "b", F.round("r", 3).alias("r")).orderBy(F.desc(F.abs("r")), "a", "b"))


def target_correlations(df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(column, one correlation per target), strongest with the first target first."""
    have = [t for t in targets if t in columns]
    if not have:
        raise ValueError("no target among the columns")
    long = _pair_corr(df, [(c, t) for c in columns for t in have])
    wide = long.groupBy(F.col("a").alias("column")).pivot("b", have).agg(F.first("r"))
    return wide.orderBy(F.desc_nulls_last(F.abs(F.col(have[0]))), "column")


def top_target_correlations(df: DataFrame, columns: Sequence[str], targets: Sequence[str], n: int = 10) -> DataFrame:
    """(target, feature, r, rank): the n strongest features per target, the target itself left out."""
    long = _pair_corr(df, [(c, t) for t in targets for c in columns if c != t])
    w = Window.partitionBy("target").orderBy(F.desc_nulls_last(F.abs("r")), "feature")  # one row per column
    return (long.select(F.col("b").alias("target"), F.col("a").alias("feature"), "r")
            .withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n))


def _iqr_bounds(df: DataFrame, columns: Sequence[str], k: float) -> dict[str, tuple]:
    q = column_quantiles(df, columns, (0.25, 0.75))
    out = {}
    for c, (q1, q3) in q.items():
        if q1 is not None:
            iqr = q3 - q1
            out[c] = (q1, q3, settled(q1 - k * iqr), settled(q3 + k * iqr))
    return out


def outliers_iqr(df: DataFrame, columns: Sequence[str], k: float = C.PROFILE_IQR_FACTOR) -> DataFrame:
    """(column, outliers): values outside the quartile fences; columns without values are left out."""
    bounds = _iqr_bounds(df, columns, k)
    row = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (_, _, lo, hi) in bounds.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in bounds])))


def outliers_zscore(df: DataFrame, columns: Sequence[str], threshold: float = C.PROFILE_IQR_FACTOR) -> DataFrame:
    """(column, outliers): values more than ``threshold`` sample deviations from the mean."""
    m = df.agg(*[F.avg(c).alias(f"{c}__m") for c in columns],
               *[F.stddev_samp(c).alias(f"{c}__s") for c in columns]).first()
    live = [c for c in columns if m[f"{c}__m"] is not None]
    counts = []
    for c in live:
        s = m[f"{c}__s"]
        z = F.abs((F.col(c) - m[f"{c}__m"]) / s) if s else F.lit(0.0)
        counts.append(F.count_if(z > threshold).alias(c))
    return df.agg(*counts).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in live])))


def boxplot_stats(df: DataFrame, columns: Sequence[str], k: float = C.PROFILE_IQR_FACTOR) -> DataFrame:
    bounds = _iqr_bounds(df, columns, k)
    aggs = []
    for c, (_, _, lo, hi) in bounds.items():
        aggs += [F.count(c).alias(f"{c}__n"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}__out")]
    items = [F.struct(F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"),
                      F.lit(settled(q3 - q1)).alias("iqr"), F.col(f"`{c}__out`").alias("outliers"),
                      F.round(F.col(f"`{c}__out`") / F.col(f"`{c}__n`") * 100, 4).alias("outlier_pct"))
             for c, (q1, q3, _, _) in bounds.items()]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, bin, n, mean, std, min, max): equal-width bins over the range, the last one closed.

    Range, mean and deviation are of the finite values; minus and plus infinity are counted in bins -1 and ``bins``.
    """
    infinite = float("inf")
    aggs = []
    for c in columns:
        x = F.when(F.abs(c) < infinite, F.col(c))
        aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.count(c).alias(f"{c}__n")]
    stats = df.agg(*aggs).first()
    items = []
    for c in columns:
        lo, hi = stats[f"{c}__min"], stats[f"{c}__max"]
        if not stats[f"{c}__n"]:
            continue
        width = (hi - lo) / bins if lo is not None else 0
        place = F.least(F.floor((F.col(c) - lo) / width), F.lit(bins - 1)) if width else F.lit(bins // 2)
        place = F.when(F.col(c) == infinite, bins).when(F.col(c) == -infinite, -1).otherwise(place)
        items.append(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), place.cast("bigint")).alias("bin"),
                              F.lit(stats[f"{c}__mean"]).cast("double").alias("mean"),
                              F.lit(stats[f"{c}__std"]).cast("double").alias("std"),
                              F.lit(lo).cast("double").alias("min"), F.lit(hi).cast("double").alias("max")))
    return (df.select(F.inline(F.array(*items))).where("bin is not null")
            .groupBy("column", "bin", "mean", "std", "min", "max").agg(F.count(F.lit(1)).alias("n")))
