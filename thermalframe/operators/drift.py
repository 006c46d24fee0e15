"""Data drift (population stability, distribution distance) and performance drift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.scalars import ratio, to_long
from thermalframe.operators.metrics import regression_metrics
from thermalframe.operators.quantiles import (grouped_quantiles, kolmogorov_p, ks_distance, ks_of, quantiles_of, ranged,
                                              value_counts)
from thermalframe.session import cut_lineage

BINS = 10


def tag_sides(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, is_ref) of both tables; features missing from the reference are skipped."""
    known = [f for f in features if f in reference.columns]
    ref = to_long(reference, known).withColumn("is_ref", F.lit(True))
    cur = to_long(current, [f for f in known if f in current.columns]).withColumn("is_ref", F.lit(False))
    return ref.unionByName(cur)


def bin_edges(reference_long: DataFrame, bins: int = BINS, key: str = "feature", value: str = "value") -> DataFrame:
    """(key, edges): distinct decile edges of the reference values."""
    return _distinct_edges(grouped_quantiles(reference_long, [key], value, _grid(bins)), key)


#: Rows up to which a table of one row a feature is sent to all tasks.
SMALL_ROWS = 1_000


def small(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``SMALL_ROWS`` rows, which are counted; else written once.

    Long rows then meet the few edges where they are, instead of moving to one task a feature.
    """
    rows = table.limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        return cut_lineage(table)
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def _grid(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def _distinct_edges(quantiles: DataFrame, key: str) -> DataFrame:
    return quantiles.select(key, F.array_distinct("q").alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """1-based half-open bin, the last one closed; NULL outside the edges or without bins."""
    n = F.size(edges)
    at = F.lit(0)
    for j in range(BINS + 1):       # a handful of comparisons that compile, instead of a lambda over the array
        at = at + F.when(F.get(edges, F.lit(j)) <= value, 1).otherwise(0)
    last = F.element_at(edges, -1)
    return F.when((n > 1) & (value >= edges[0]) & (value <= last), F.when(value == last, n - 1).otherwise(at))


def _share(count: Column, total: Column) -> Column:
    s = count / F.when(total > 0, total).cast("double")
    return F.when(s == 0, F.lit(C.EMPTY_SHARE)).otherwise(s)


def psi_expr(bins: int = BINS) -> Column:
    """Stability index from the columns r1..rN, c1..cN, n_ref, n_cur and bins."""
    out = F.lit(0.0)
    for j in range(1, bins + 1):
        r, c = _share(F.col(f"r{j}"), F.col("n_ref")), _share(F.col(f"c{j}"), F.col("n_cur"))
        out = out + F.when(F.col("bins") >= j, (c - r) * F.log(c / r)).otherwise(0.0)
    return out


def side_stats(counts: DataFrame, edges: DataFrame, key: str = "feature", bins: int = BINS) -> DataFrame:
    """Bin counts, sizes, means and deviations of both sides from ``value_counts``: one aggregation.

    The edge table has one short row per feature and comes marked for broadcast where its rows were counted.
    """
    v = F.col("v")
    placed = (counts.join(edges, key).withColumn("__bin", bin_of(v, F.col("edges")))
              .withColumns({"bins": F.size("edges") - 1, "__x": v - F.col("edges")[0]}))   # shifted: no cancellation
    aggs = []
    for j in range(1, bins + 1):
        aggs += [F.sum(F.when(F.col("__bin") == j, F.col(side)).otherwise(0)).alias(f"{side}{j}") for side in ("r", "c")]
    x = F.col("__x")
    for side in ("r", "c"):
        aggs += [F.sum(side).alias(f"n_{side}"), F.sum(x * F.col(side)).alias(f"s_{side}"),
                 F.sum(x * x * F.col(side)).alias(f"q_{side}")]
    table = placed.groupBy(key, "bins", F.col("edges")[0].alias("__low")).agg(*aggs)

    def mean(side: str) -> Column:
        return F.col(f"s_{side}") / F.nullif(f"n_{side}", F.lit(0))

    def squares(side: str) -> Column:
        return F.greatest(F.col(f"q_{side}") - F.col(f"s_{side}") * mean(side), F.lit(0.0))

    low = F.coalesce(F.col("__low"), F.lit(0.0))
    return table.select(
        key, "bins", *[f"{side}{j}" for j in range(1, bins + 1) for side in ("r", "c")],
        F.col("n_r").alias("n_ref"), F.col("n_c").alias("n_cur"),
        (mean("r") + low).alias("reference_mean"), (mean("c") + low).alias("current_mean"),
        F.sqrt(squares("r") / F.nullif(F.col("n_r") - 1, F.lit(0))).alias("reference_std"),
        F.sqrt(squares("c") / F.nullif("n_c", F.lit(0))).alias("current_std"))


def counts_and_edges(long: DataFrame, bins: int = BINS, key: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Value counts of a tagged (key, value, is_ref) table in ranges, and the bin edges read from them.

    The table is scanned once; all drift statistics come from the written counts.
    """
    counts = ranged(value_counts(long, key, "value", F.col("is_ref")), [key])
    return counts, small(_distinct_edges(quantiles_of(counts, [key], "r", _grid(bins)), key))


def psi(long: DataFrame, bins: int = BINS, key: str = "feature") -> DataFrame:
    """(feature, psi) from a tagged (feature, value, is_ref) table."""
    counts, edges = counts_and_edges(long, bins, key)
    return side_stats(counts, edges, key, bins).select(key, psi_expr(bins).alias("psi"))


def ks_two_sample(long: DataFrame, key: str = "feature") -> DataFrame:
    """(feature, n_ref, n_cur, ks, p_value)."""
    return with_p_value(ks_distance(long, key, "value", F.col("is_ref")))


def with_p_value(ks: DataFrame) -> DataFrame:
    return ks.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")))


def path_p(n_ref: int, n_cur: int, ks: float) -> float:
    """Chance that two samples of these sizes from one distribution are at least ``ks`` apart, by counting lattice paths.

    A path takes a step for each value in order, to the right for one sample and up for the other; all are equally
    likely. ``reached[i]`` is the chance that a path to (i, s - i) has been so far from the diagonal: the last step came from
    the left with chance i / s. Only sums of positive terms, so small chances stay exact.
    """
    m, n = sorted((int(n_ref), int(n_cur)))
    far = round(ks * m * n)
    if not m or far <= 0:
        return 1.0
    i = np.arange(m + 1)
    reached = np.zeros(m + 1)
    for s in range(1, m + n + 1):
        left = np.r_[0.0, reached[:-1]]
        reached = (i * left + np.maximum(s - i, 0) * reached) / s
        reached[np.abs(i * n - (s - i) * m) >= far] = 1.0
    return float(reached[m])


def exact_p(ks: Column, n_ref: Column, n_cur: Column) -> Column:
    """The exact p-value; NULL without a distance. For samples of up to some ten thousand values: the work grows with the
    product of the sizes, a row at a time of the aggregated table."""
    @F.pandas_udf("double")
    def p_value(distance: pd.Series, ref: pd.Series, cur: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for d, a, b in zip(distance, ref, cur):
            if pd.isna(d) or pd.isna(a) or pd.isna(b):
                out.append(None)
                continue
            key = *sorted((int(a), int(b))), round(d * a * b)
            if key not in known:
                known[key] = path_p(a, b, d)
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return p_value(ks.cast("double"), n_ref.cast("double"), n_cur.cast("double"))


#: Largest sample for which the exact p-value is taken.
EXACT_ROWS = 10_000


def with_best_p_value(ks: DataFrame, largest: int = EXACT_ROWS) -> DataFrame:
    """``p_value``: exact where both samples have at most ``largest`` values, by the limit distribution else."""
    small = F.greatest("n_ref", "n_cur") <= largest
    zero = F.lit(None).cast("double")
    exact = exact_p(F.when(small, F.col("ks")).otherwise(zero), F.col("n_ref"), F.col("n_cur"))
    return ks.withColumn("p_value", F.when(small, exact).otherwise(kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur"))))


def drift_status(psi_value: Column, p_value: Column, psi_threshold: float = C.PSI_THRESHOLD,
                 ks_threshold: float = C.KS_THRESHOLD) -> Column:
    moved, different = psi_value > psi_threshold, p_value < ks_threshold
    return F.when(moved & different, "CRITICAL").when(moved | different, "WARNING").otherwise("STABLE")


def feature_drift_long(long: DataFrame, features: DataFrame, bins: int = BINS) -> DataFrame:
    """Drift per feature from a tagged table; ``features`` (one column ``feature``) lists what to report."""
    counts, edges = counts_and_edges(long, bins)
    stats = side_stats(counts, edges, bins=bins).withColumn("psi", psi_expr(bins))
    ks = with_p_value(ks_of(counts, "feature")).select("feature", "ks", "p_value")
    both = features.join(stats, "feature", "left").join(ks, "feature", "left")
    ok = F.coalesce(F.col("n_cur"), F.lit(0)) > 0
    change = ratio(F.col("current_mean") - F.col("reference_mean"), F.col("reference_mean")) * 100

    def shown(c: Column, digits: int) -> Column:
        return F.when(ok, F.round(c, digits))

    return both.select(
        "feature", F.when(ok, drift_status(F.col("psi"), F.col("p_value"))).otherwise("ERROR").alias("status"),
        shown(F.col("psi"), 4).alias("psi"), shown(F.col("ks"), 4).alias("ks_statistic"),
        shown(F.col("p_value"), 4).alias("ks_pvalue"),
        shown(F.col("reference_mean"), 4).alias("reference_mean"), shown(F.col("current_mean"), 4).alias("current_mean"),
        shown(change, 2).alias("mean_change_pct"),
        shown(F.col("reference_std"), 4).alias("reference_std"), shown(F.col("current_std"), 4).alias("current_std"))


def feature_drift(reference: DataFrame, current: DataFrame, features: Sequence[str] = C.DRIFT_FEATURES,
                  bins: int = BINS) -> DataFrame:
    """Drift of ``current`` against ``reference``. Features absent from the reference are not reported,
    features absent from or empty in the current data are reported as ERROR."""
    known = [f for f in features if f in reference.columns]
    names = reference.sparkSession.createDataFrame([(f,) for f in known], "feature string")
    return feature_drift_long(tag_sides(reference, current, known), names, bins)


def prediction_drift(long: DataFrame, reference_metrics: DataFrame, by: Sequence[str] = ("target",),
                     threshold: float = C.PERFORMANCE_THRESHOLD) -> DataFrame:
    """Current scores against reference scores (columns mae, rmse, r2 per group)."""
    now = regression_metrics(long, by, decimals=9)
    ref = reference_metrics.select(*by, *[F.col(m).alias(f"reference_{m}") for m in ("mae", "rmse", "r2")])
    both = now.join(ref, list(by))

    def rise(m: str) -> Column:
        return ratio(F.col(m) - F.col(f"reference_{m}"), F.col(f"reference_{m}")) * 100

    mae, rmse, r2 = rise("mae"), rise("rmse"), F.col("reference_r2") - F.col("r2")
    bad = (F.abs(mae) > threshold * 100) | (F.abs(rmse) > threshold * 100) | (F.abs(r2) > C.R2_DRIFT_THRESHOLD)
    return both.select(
        *by, F.when(bad, "WARNING").otherwise("STABLE").alias("status"),
        *[F.round(m, 4).alias(m) for m in ("mae", "rmse", "r2")],
        F.round(mae, 2).alias("mae_drift_pct"), F.round(rmse, 2).alias("rmse_drift_pct"),
        F.round(r2, 4).alias("r2_drift"),
        *[F.round(f"reference_{m}", 4).alias(f"reference_{m}") for m in ("mae", "rmse", "r2")])


def _summary_counts() -> list[Column]:
    s = F.col("status")
    return [F.count(F.lit(1)).alias("total_features"), F.count_if(s == "CRITICAL").alias("critical_features"),
            F.count_if(s == "WARNING").alias("warning_features"), F.count_if(s == "STABLE").alias("stable_features")]


def _summary_verdict() -> list[Column]:
    bad = F.col("critical_features") + F.col("warning_features")
    return [F.when(F.col("critical_features") > 0, "CRITICAL").when(F.col("warning_features") > 0, "WARNING")
            .otherwise("STABLE").alias("overall_status"),
            F.round(ratio(bad * 100.0, F.col("total_features")), 2).alias("drift_percentage")]


def drift_summary(drift: DataFrame) -> DataFrame:
    """Counts per status, the worst status and the share of drifted features (NULL without features)."""
    return drift.agg(*_summary_counts()).select("*", *_summary_verdict())


def psi_band(value: Column, documented: bool = False) -> Column:
    """Verbal band of a stability index; the documented variant has a warning and a critical level."""
    if documented:
        return F.when(value > 0.5, "critical").when(value > 0.2, "warning").otherwise("ok")
    return F.when(value > 0.2, "significant").when(value >= 0.1, "slight").otherwise("none")


def report_json(drift: DataFrame, prediction: DataFrame | None = None) -> DataFrame:
    """One JSON document: summary, a map of features, and the prediction drift.

    The report has one entry per monitored feature, which bounds the document.
    """
    body = F.struct(*[F.col(c) for c in drift.columns if c != "feature"])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", body.alias("body")))))
    row = drift.agg(entries.alias("feature_drift"), *_summary_counts()).select("*", *_summary_verdict())
    if prediction is None:
        row = row.withColumn("prediction_drift", F.lit(None).cast("string"))
    else:
        fields = F.struct(*[F.col(c) for c in prediction.columns])
        row = row.withColumn("prediction_drift", prediction.agg(F.array_sort(F.collect_list(fields))).scalar())
    summary = F.struct("overall_status", "total_features", "critical_features", "warning_features", "stable_features",
                       "drift_percentage")
    return row.select(F.to_json(F.struct(summary.alias("summary"), "feature_drift", "prediction_drift")).alias("report"))


def drift_by_window(current: DataFrame, edges: DataFrame, reference_counts: DataFrame, ts: str = "ts",
                    size: str = "1 hour", bins: int = BINS) -> DataFrame:
    """(window_start, feature, n_cur, psi) of the current readings per tumbling window.

    ``reference_counts`` holds r1..rN and n_ref per feature. Works on a batch and,
    with a watermark on ``ts``, on a stream: the window part is a plain count.
    """
    placed = (current.where(F.col("value").isNotNull()).join(edges, "feature")
              .withColumn("__bin", bin_of(F.col("value"), F.col("edges"))))
    counts = placed.groupBy(F.window(ts, size).alias("w"), "feature").agg(
        F.count(F.lit(1)).alias("n_cur"),
        *[F.count_if(F.col("__bin") == j).alias(f"c{j}") for j in range(1, bins + 1)])
    return (counts.join(reference_counts, "feature")
            .select(F.col("w.start").alias("window_start"), "feature", "n_cur", psi_expr(bins).alias("psi")))


def reference_bins(reference_long: DataFrame, edges: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bins, n_ref, r1..rN): the static side of windowed drift."""
    counts = value_counts(reference_long, "feature", "value", F.lit(True))
    return bins_of(counts, edges, bins)


def bins_of(counts: DataFrame, edges: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bins, n_ref, r1..rN) from value counts, which ``counts_and_edges`` has already."""
    return side_stats(counts, edges, bins=bins).select("feature", "bins", "n_ref", *[f"r{j}" for j in range(1, bins + 1)])
