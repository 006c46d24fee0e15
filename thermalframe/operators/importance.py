"""Feature importance tables: long form (target, feature, importance)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.operators.profile import _pair_corr


def correlation_importance(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Absolute correlation of each feature with each target, as a model-free importance."""
    pairs = [(f, t) for t in targets for f in features if f != t]
    return _pair_corr(df, pairs).select(F.col("b").alias("target"), F.col("a").alias("feature"),
                                        F.coalesce(F.abs("r"), F.lit(0.0)).alias("importance"))


def importance_mean(importance: DataFrame) -> DataFrame:
    """(feature, mean): mean over the targets that have the feature."""
    return importance.groupBy("feature").agg(F.avg("importance").alias("mean"))


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n features of the largest mean importance; equal ones by name."""
    return importance_mean(importance).orderBy(F.desc("mean"), "feature").limit(n)


def top_features_per_target(importance: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.desc("importance"), "feature")   # one row per feature
    return importance.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def group_table(spark: SparkSession, groups: dict[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(g, f) for g, fs in groups.items() for f in fs], "group string, feature string")


def groups_by_mark(features: Sequence[str], marks: dict[str, Sequence[str]] = C.FEATURE_GROUP_MARKS) -> dict[str, list[str]]:
    """Groups from name patterns; a feature may be in several."""
    return {g: [f for f in features if any(m in f for m in ms)] for g, ms in marks.items()}


def importance_groups(mean: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, mean_importance, sum_importance, n_features); groups without a known feature are left out."""
    return (groups.join(mean, "feature").groupBy("group").agg(
        F.avg("mean").alias("mean_importance"), F.sum("mean").alias("sum_importance"),
        F.count(F.lit(1)).alias("n_features")).orderBy(F.desc("sum_importance"), "group"))


def align_models(tables: dict[str, DataFrame]) -> DataFrame:
    """(feature, one importance per model): full outer alignment by feature."""
    out = None
    for name, table in tables.items():
        one = table.select("feature", F.col("mean").alias(name))
        out = one if out is None else out.join(one, "feature", "full_outer")
    return out


def present_features(importance: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(importance, "feature", "left_semi")


def absent_features(importance: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(importance, "feature", "left_anti")
