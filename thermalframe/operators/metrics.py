"""Regression metrics as one grouped aggregation over (truth, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.scalars import ratio
from thermalframe.operators.quantiles import grouped_quantiles


def pair_up(actual: DataFrame, predicted: DataFrame, key: str, targets: Sequence[str] = C.TARGETS) -> DataFrame:
    """Join truths and predictions on the row key; predictions get the suffix ``_pred``."""
    pred = predicted.select(key, *[F.col(t).alias(f"{t}_pred") for t in targets])
    return actual.join(pred, key)


def pairs_long(df: DataFrame, keep: Sequence[str] = (), targets: Sequence[str] = C.TARGETS,
               suffix: str = "_pred") -> DataFrame:
    """(kept, target, y, yhat): one row per target; a projection."""
    items = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                               F.col(f"{t}{suffix}").cast("double").alias("yhat")) for t in targets])
    return df.select(*keep, F.inline(items))


def _both(c: Column) -> Column:
    return F.when(F.col("y").isNotNull() & F.col("yhat").isNotNull(), c)


def _r2(sse: Column, n: Column, var: Column) -> Column:
    sst = n * var
    return F.when(n > 1, F.when(sst > 0, 1.0 - sse / sst).when(sse == 0, 1.0).otherwise(0.0))


def regression_metrics(long: DataFrame, by: Sequence[str] = ("target",), decimals: int = 4) -> DataFrame:
    """(by, n, mae, rmse, mape, r2, max_error); pairs with a missing side are skipped.

    A group without pairs stays as a row of NULLs. Sums are combined before the
    shuffle, so one hot group costs no more than a small one.
    """
    e = F.col("y") - F.col("yhat")
    known_y = _both(F.col("y"))
    table = long.groupBy(*by).agg(
        F.count(known_y).alias("n"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"),
        F.avg(F.when(F.col("y") != 0, F.abs(e / F.when(F.col("y") != 0, F.col("y"))))).alias("ape"),
        F.var_pop(known_y).alias("var"), F.max(F.abs(e)).alias("max_error"))
    return table.select(
        *by, "n", F.round("mae", decimals).alias("mae"), F.round(F.sqrt("mse"), decimals).alias("rmse"),
        F.round(F.col("ape") * 100, decimals).alias("mape"),
        F.round(_r2(F.col("sse"), F.col("n"), F.col("var")), decimals).alias("r2"),
        F.round("max_error", decimals).alias("max_error"))


def residual_stats(long: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """(by, mean, std, mae, rmse, r2, max, p95, p99) of the residuals y - yhat; population deviation."""
    known = long.where(F.col("y").isNotNull() & F.col("yhat").isNotNull()).withColumn("e", F.col("y") - F.col("yhat"))
    e = F.col("e")
    moments = known.groupBy(*by).agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        _r2(F.sum(e * e), F.count(e), F.var_pop("y")).alias("r2"), F.max(F.abs(e)).alias("max"))
    tails = grouped_quantiles(known.withColumn("abs_e", F.abs(e)), list(by), "abs_e", (0.95, 0.99))
    return moments.join(tails.select(*by, F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99")), list(by))


def condition_band(value: Column, bands=C.SETPOINT_BANDS) -> Column:
    """Right-closed band label; values outside all bands get none."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        out = F.when((value > low) & (value <= high), F.lit(name)).otherwise(out)
    return out


def tercile_band(value: Column, edges: Sequence[float]) -> Column:
    """Low / Mid / High by right-closed terciles (the fallback where no setpoint exists)."""
    lo, t1, t2, hi = edges
    return (F.when((value >= lo) & (value <= t1), F.lit("Low")).when((value > t1) & (value <= t2), F.lit("Mid"))
            .when((value > t2) & (value <= hi), F.lit("High")))


def metrics_by_condition(long: DataFrame, condition: Column, by: Sequence[str] = ("target",)) -> DataFrame:
    banded = long.withColumn("condition", condition).where(F.col("condition").isNotNull())
    return regression_metrics(banded, [*by, "condition"])


def metrics_shifted_mape(long: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Validation form: percentage error over y + 1e-8, means and population deviations of both sides."""
    known = long.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    e, y = F.col("y") - F.col("yhat"), F.col("y")
    return known.groupBy(*by).agg(
        _r2(F.sum(e * e), F.count(e), F.var_pop("y")).alias("r2"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(ratio(e, y + 1e-8))) * 100).alias("mape"),
        F.avg("y").alias("mean_true"), F.avg("yhat").alias("mean_pred"),
        F.stddev_pop("y").alias("std_true"), F.stddev_pop("yhat").alias("std_pred"))


def verdict(metrics: DataFrame, r2: str = "r2") -> DataFrame:
    """(avg_r2, verdict) over the targets."""
    avg = metrics.agg(F.avg(r2).alias("avg_r2"))
    v = F.col("avg_r2")
    return avg.withColumn("verdict", F.when(v >= 0.75, "EXCELLENT").when(v >= 0.60, "GOOD")
                          .when(v >= 0.40, "ACCEPTABLE").when(v.isNotNull(), "POOR"))


def fold_summary(fold_metrics: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Mean and both deviations (sample and population) of the per-fold scores."""
    aggs = []
    for m in ("r2", "mae"):
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"),
                 F.stddev_pop(m).alias(f"std_pop_{m}")]
    return fold_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *aggs)


def improvement_vs_baseline(metrics: DataFrame, baseline_mape: float = C.BASELINE_MAPE) -> DataFrame:
    return metrics.withColumns({
        "baseline_mape": F.lit(baseline_mape),
        "improvement_pct": (F.lit(baseline_mape) - F.col("mape")) / F.lit(baseline_mape) * 100})


def compare_models(metrics: DataFrame, candidate: str, baseline: str, on: Sequence[str] = ("target", "dataset"),
                   model: str = "model") -> DataFrame:
    """Candidate and baseline rows side by side, with the relative change of each score."""
    cand = metrics.where(F.col(model) == candidate).select(*on, *[F.col(m).alias(f"candidate_{m}")
                                                                  for m in ("r2", "mae", "mape")])
    base = metrics.where(F.col(model) == baseline).select(*on, *[F.col(m).alias(f"baseline_{m}")
                                                                 for m in ("r2", "mae", "mape")])
    both = cand.join(base, list(on))
    return both.withColumns({
        "r2_gain_pct": ratio(F.col("candidate_r2") - F.col("baseline_r2"), F.abs("baseline_r2")) * 100,
        "mape_gain_pct": ratio(F.col("baseline_mape") - F.col("candidate_mape"), F.col("baseline_mape")) * 100})


def best_model_per_target(metrics: DataFrame, by: Sequence[str] = ("target",), score: str = "r2",
                          model: str = "model") -> DataFrame:
    """Best model per group; equal scores are decided by the model name."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), model)   # one row per model
    return metrics.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def prediction_agreement(a: DataFrame, b: DataFrame, key: str, targets: Sequence[str] = C.TARGETS,
                         tolerance: float = 1e-5) -> DataFrame:
    """(target, rows, max_diff, status, r2 of b against a) for two prediction tables of the same rows."""
    long = pairs_long(pair_up(a, b, key, targets), targets=targets)
    e = F.col("y") - F.col("yhat")
    return (long.where(F.col("y").isNotNull() & F.col("yhat").isNotNull()).groupBy("target")
            .agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(e)).alias("max_diff"),
                 _r2(F.sum(e * e), F.count(e), F.var_pop("y")).alias("r2"))
            .withColumn("status", F.when(F.col("max_diff") < tolerance, "PASSED").otherwise("WARNING")))


def target_ranges(df: DataFrame, group: str, targets: Sequence[str] = C.TARGETS) -> DataFrame:
    """(group, target, n, mean, std, min, max) with population deviations."""
    items = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])
    return df.select(group, F.inline(items)).groupBy(group, "target").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"),
        F.min("y").alias("min"), F.max("y").alias("max"))


def latency_stats(df: DataFrame, latency: str, by: Sequence[str], sla_ms: float = C.ACCEPT_MAX_LATENCY_MS) -> DataFrame:
    """Mean, deviation, range, p50/p95/p99, throughput per second and the service-level verdict."""
    moments = df.groupBy(*by).agg(
        F.count(latency).alias("n"), F.avg(latency).alias("mean_ms"), F.stddev_pop(latency).alias("std_ms"),
        F.min(latency).alias("min_ms"), F.max(latency).alias("max_ms"))
    q = grouped_quantiles(df, list(by), latency, (0.5, 0.95, 0.99)).select(
        *by, *[F.col("q")[i].alias(f"p{p}_ms") for i, p in enumerate((50, 95, 99))])
    return (moments.join(q, list(by))
            .withColumn("throughput", ratio(F.lit(1000.0), F.col("mean_ms")))
            .withColumn("meets_sla", F.col("p95_ms") < sla_ms))
