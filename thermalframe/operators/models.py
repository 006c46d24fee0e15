"""One regressor per target: fitting, scoring, refitting on folds, saving.

Least squares and ridge are solved from sums of products, all targets in one
pass over the rows; boosted trees and forests grow on histograms (``boosting``, ``forest``). Forests of more rows than a task
holds are MLlib's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalframe.operators.boosting import TRAIN, WATCH, BoostedTrees, Boosting, fit_boosted
from thermalframe.operators.forest import Forest, ForestTrees, fit_forests
from thermalframe.operators.metrics import pairs_long, regression_metrics
from thermalframe.operators.split import assign_folds, fold_cuts
from thermalframe.session import shared_dir

@dataclass
class LeastSquares:
    """A fitted linear model; scoring is a projection."""
    target: str
    features: list[str]
    intercept: float
    coefficients: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [F.lit(b) * F.col(f) for f, b in zip(self.features, self.coefficients)]
        return df.withColumn(f"{self.target}_pred", reduce(lambda x, y: x + y, terms, F.lit(self.intercept)))


@dataclass
class Linear:
    """Least squares, or ridge: ``alpha`` is added to the sums of squares of the standardised inputs."""
    alpha: float = 0.0


Model = PipelineModel | LeastSquares | BoostedTrees | ForestTrees
Bundle = dict[str, Model]


def linear(target: str, alpha: float = 0.0) -> Linear:
    return Linear(alpha)


def _products(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and sums of centred products."""
    mean = x.mean(axis=0)
    z = x - mean
    return len(x), mean, z.T @ z


def _add(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


_MOMENTS = "target string, n long, mean array<double>, products array<double>"


def _moments(state: dict[str, tuple]) -> pa.RecordBatch:
    rows = [(t, int(n), mean.tolist(), m.ravel().tolist()) for t, (n, mean, m) in state.items()]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["target", "n", "mean", "products"])


def fit_least_squares(train: DataFrame, features: Sequence[str], targets: Sequence[str], alpha: float = 0.0) -> Bundle:
    """All targets from one pass over ``train``; rows without a feature or without that target are left out.

    A task sends one short line for each target; they are merged in a few tasks before the last ones reach the driver,
    where a system of as many equations as features is solved.
    """
    features, targets = list(features), list(targets)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple] = {}
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])
            x = x[~np.isnan(x[:, :len(features)]).any(axis=1)]
            for i, t in enumerate(targets):
                own = x[:, [*range(len(features)), len(features) + i]]
                own = own[~np.isnan(own[:, -1])]
                if len(own):
                    state[t] = _add(state.get(t), _products(own))
        yield _moments(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple] = {}
        for batch in batches:
            for t, n, mean, m in zip(*(c.to_pylist() for c in batch.columns)):
                k = len(mean)
                state[t] = _add(state.get(t), (n, np.array(mean), np.array(m).reshape(k, k)))
        yield _moments(state)

    lines = train.select(*[F.col(c).cast("double").alias(c) for c in [*features, *targets]]).mapInArrow(sums, _MOMENTS)
    total: dict[str, tuple] = {}
    for r in lines.coalesce(32).mapInArrow(merge, _MOMENTS).collect():
        k = len(r["mean"])
        total[r["target"]] = _add(total.get(r["target"]), (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    out: Bundle = {}
    for t in targets:
        if t not in total:
            raise ValueError(f"no row has all features and {t}")
        n, mean, m = total[t]
        scale = np.sqrt(np.diag(m) / n)
        scale[scale == 0] = 1.0
        z = m / np.outer(scale, scale)                      # sums of products of standardised columns
        a, y = z[:-1, :-1] + alpha * np.eye(len(features)), z[:-1, -1]
        b = np.linalg.lstsq(a, y, rcond=1e-10)[0] * scale[-1] / scale[:-1]
        out[t] = LeastSquares(t, features, float(mean[-1] - mean[:-1] @ b), [float(v) for v in b])
    return out


def random_forest(target: str, trees: int = 100, depth: int = 15, seed: int = 42) -> RandomForestRegressor:
    """The parameters of a forest; ``fit_per_target`` grows it itself where its rows fit in a task."""
    return RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol=f"{target}_pred",
                                 numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed,
                                 maxMemoryInMB=1024)


def boosted_trees(target: str, trees: int = 300, depth: int = 8, rate: float = 0.05, subsample: float = 0.8,
                  columns: float = 0.8, min_rows: int = 20, validation: str | None = None, patience: int = 50, l1: float = 0.1,
                  l2: float = 1.0, seed: int = 42) -> Boosting:
    """Boosted trees; with ``validation`` (a boolean column) boosting stops ``patience`` trees after its lowest loss."""
    return Boosting(trees=trees, depth=depth, rate=rate, subsample=subsample, columns=columns, min_rows=min_rows, l1=l1, l2=l2,
                    validation=validation, patience=patience, seed=seed)


def fit_per_target(train: DataFrame, features: Sequence[str], targets: Sequence[str],
                   estimator: Callable[[str], object], extra: Sequence[str] = ()) -> Bundle:
    """Fit one model per target on the rows where the features and that target are known.

    ``extra`` names further columns an estimator reads (a validation mark). The
    rows are kept for the fits because tree training passes over them many times. The targets
    are fitted side by side.
    """
    first = estimator(targets[0])
    if isinstance(first, Linear):
        return fit_least_squares(train, features, targets, first.alpha)
    if isinstance(first, Boosting):
        return fit_boosted(train, features, targets, first)[0]
    if isinstance(first, RandomForestRegressor):
        p = Forest(first.getNumTrees(), first.getMaxDepth(), first.getMinInstancesPerNode(), first.getMaxBins(), first.getSeed())
        if fitted := fit_forests(train, features, targets, p):
            return fitted
    shared_dir(train.sparkSession)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    needed = train.select(*dict.fromkeys([*features, *targets, *extra])).dropna("any", subset=list(features))
    complete = needed.persist()

    @inheritable_thread_target(train.sparkSession)
    def fit(t: str) -> PipelineModel:
        return Pipeline(stages=[assembler, estimator(t)]).fit(complete.where(F.col(t).isNotNull()))

    try:
        with ThreadPoolExecutor(len(targets)) as pool:
            return dict(zip(targets, pool.map(fit, targets)))
    finally:
        complete.unpersist()


def predict_all(df: DataFrame, bundle: Bundle, features: Sequence[str]) -> DataFrame:
    """Adds ``<target>_pred`` for every model; a projection, also on a stream."""
    out = df.dropna("any", subset=list(features))
    for model in bundle.values():
        out = model.transform(out).drop("features")
    return out


def evaluate(df: DataFrame, bundle: Bundle, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scores by target. Rows are dealt out for trees: a small file is one task, and hundreds of trees a row keep it busy."""
    if any(isinstance(m, BoostedTrees | ForestTrees) for m in bundle.values()):
        df = df.select(*dict.fromkeys([*features, *bundle, *by])).dropna("any", subset=list(features)) \
            .repartition(df.sparkSession.sparkContext.defaultParallelism * 2)
    scored = predict_all(df, bundle, features)
    return regression_metrics(pairs_long(scored, keep=list(by), targets=list(bundle)), [*by, "target"])


def compare(df: DataFrame, bundles: dict[str, Bundle], features: Sequence[str], split: str = "split") -> DataFrame:
    """(model, split, target, scores) over all models."""
    parts = [evaluate(df, b, features, [split]).withColumn("model", F.lit(name)) for name, b in bundles.items()]
    return reduce(DataFrame.unionByName, parts)


def tree_importance(bundle: Bundle, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(target, feature, importance) of tree models: one number per feature and target."""
    rows = [(t, f, float(v)) for t, m in bundle.items() for f, v in zip(
        features, m.importance() if isinstance(m, BoostedTrees | ForestTrees) else m.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


def refit_on_folds(df: DataFrame, order: str, features: Sequence[str], targets: Sequence[str],
                   estimator: Callable[[str], object], k: int = 5) -> DataFrame:
    """(fold, role, target, scores): a new model per fold, scored on its own train and test rows.

    Boosted trees of all folds and targets grow together, from one set of bins; each fold watches its test rows and stops
    by patience.
    """
    folded = assign_folds(df, order, k)
    first = estimator(targets[0])
    if isinstance(first, Boosting):
        cuts = fold_cuts(df, order, k)
        key, roles = F.col(order), []
        for i, cut in enumerate(cuts):
            if cut is None:
                roles.append(F.lit(0))
                continue
            end = next((c for c in cuts[i + 1:] if c is not None), None)
            tested = F.lit(True) if end is None else key < end
            roles.append(F.when(key < cut, F.lit(TRAIN)).when(tested, F.lit(WATCH)).otherwise(F.lit(0)))
        bundles = fit_boosted(df, features, targets, first, roles)
    else:
        bundles = [fit_per_target(folded.where((F.col("fold") == i) & (F.col("role") == "train")), features, targets, estimator)
                   for i in range(1, k + 1)]
    return reduce(DataFrame.unionByName, [evaluate(folded.where(F.col("fold") == i), bundle, features, ["fold", "role"])
                                          for i, bundle in enumerate(bundles, 1)])


def over_folds(folds: DataFrame) -> DataFrame:
    """(role, target, mean and population deviation of each score) over the folds."""
    scores = [c for c, t in folds.dtypes if t == "double"]
    return folds.groupBy("role", "target").agg(
        F.count(F.lit(1)).alias("folds"), *[f(c).alias(f"{c}_{n}") for c in scores
                                            for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


_LINEAR = "target string, features array<string>, intercept double, coefficients array<double>"
_BOOSTED = ("target string, features array<string>, edges array<array<double>>, base double, split array<array<int>>, "
            "cut array<array<int>>, leaf array<array<double>>, gain array<array<double>>, losses array<double>")
_FOREST = ("target string, features array<string>, edges array<array<double>>, tree int, split binary, cut binary, leaf binary, "
           "gains array<double>")
_NAMES = "targets array<string>, kinds array<string>, features array<string>"


def save_bundle(bundle: Bundle, path: str, spark: SparkSession, features: Sequence[str]) -> None:
    """One folder per target and a table of the names needed to use them."""
    for t, m in bundle.items():
        if isinstance(m, LeastSquares):
            spark.createDataFrame([(m.target, m.features, m.intercept, m.coefficients)], _LINEAR) \
                .write.mode("overwrite").parquet(f"{path}/{t}")
        elif isinstance(m, BoostedTrees):
            trees = (x.tolist() for x in (m.split, m.cut, m.leaf, m.gain))
            spark.createDataFrame([(m.target, m.features, m.edges, m.base, *trees, m.losses)], _BOOSTED) \
                .write.mode("overwrite").parquet(f"{path}/{t}")
        elif isinstance(m, ForestTrees):
            trees = [(m.target, m.features, m.edges, i, *(bytearray(x.tobytes()) for x in tree), m.gains[i].tolist())
                     for i, tree in enumerate(zip(m.split, m.cut, m.leaf))]
            spark.createDataFrame(trees, _FOREST).write.mode("overwrite").parquet(f"{path}/{t}")
        else:
            m.write().overwrite().save(f"{path}/{t}")
    kinds = [{LeastSquares: "linear", BoostedTrees: "boosted", ForestTrees: "forest"}.get(type(m), "trees") for m in bundle.values()]
    spark.createDataFrame([(list(bundle), kinds, list(features))], _NAMES).write.mode("overwrite").json(f"{path}/_bundle")


def load_bundle(path: str, spark: SparkSession) -> tuple[Bundle, list[str]]:
    names = spark.read.schema(_NAMES).json(f"{path}/_bundle").first()
    def boosted(p: str) -> BoostedTrees:
        r = spark.read.schema(_BOOSTED).parquet(p).first()
        arrays = (np.array(r[c], kind).reshape(len(r["split"]), -1) for c, kind in (
            ("split", np.int16), ("cut", np.int16), ("leaf", float), ("gain", float)))
        return BoostedTrees(r["target"], r["features"], r["edges"], r["base"], *arrays, r["losses"])

    def forest(p: str) -> ForestTrees:
        trees = spark.read.schema(_FOREST).parquet(p).orderBy("tree").collect()
        arrays = ([np.frombuffer(r[c], kind) for r in trees] for c, kind in (("split", np.int16), ("cut", np.uint8), ("leaf", float)))
        return ForestTrees(trees[0]["target"], trees[0]["features"], trees[0]["edges"], *arrays, np.array([r["gains"] for r in trees]))

    load = {"boosted": boosted, "forest": forest, "linear": lambda p: LeastSquares(*spark.read.schema(_LINEAR).parquet(p).first()), "trees": PipelineModel.load}
    return {t: load[k](f"{path}/{t}") for t, k in zip(names["targets"], names["kinds"])}, list(names["features"])


def linear_fit(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """(intercept, slope) of the one-variable least-squares line."""
    row = df.agg(F.regr_intercept(F.col(y), F.col(x)).alias("a"), F.regr_slope(F.col(y), F.col(x)).alias("b")).first()
    return row["a"], row["b"]


def score_with(predict: Callable[[pd.DataFrame], pd.Series], features: Sequence[str]) -> Column:
    """Score a user-supplied model that MLlib cannot express; whole Arrow batches at a time.

    ``predict`` takes a frame with the feature columns and returns one number per row.
    """
    names = list(features)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield predict(batch[names]).astype("float64")

    return run(F.struct(*names))
