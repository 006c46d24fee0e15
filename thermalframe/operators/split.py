"""Splits, folds and samples by row order or by key hash."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.operators.blocks import order_cuts

NAMES = ("train", "val", "test")


def _check(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1.0")


def _label(key: Column, cuts: Sequence[int | None], names: Sequence[str] = NAMES) -> Column:
    """Name of the part a key falls into; a missing cut lies behind the last row."""
    out = None
    for cut, name in zip(cuts, names):
        if cut is None:
            return F.lit(name) if out is None else out.otherwise(F.lit(name))
        out = F.when(key < cut, F.lit(name)) if out is None else out.when(key < cut, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def temporal_cuts(df: DataFrame, order: str, ratios: Sequence[float] = C.SPLIT_RATIOS,
                  width: int | None = None) -> tuple[int, list[int | None]]:
    """(row count, [first key of val, first key of test])."""
    _check(ratios)
    first, second = ratios[0], ratios[0] + ratios[1]
    return order_cuts(df, order, [lambda n: F.floor(n * F.lit(first)), lambda n: F.floor(n * F.lit(second))], width)


def label_parts(df: DataFrame, order: str, cuts: Sequence[int | None], name: str = "split") -> DataFrame:
    """Label rows by comparing their key with the cuts: a projection, nothing moves."""
    return df.withColumn(name, _label(F.col(order), cuts))


def select_parts(df: DataFrame, order: str, cuts: Sequence[int | None], wanted: Sequence[str],
                 name: str = "split") -> DataFrame:
    """Labelled rows of adjacent parts only. The key range is a filter of its own that reaches the scan."""
    at = sorted(NAMES.index(w) for w in wanted)
    low = cuts[at[0] - 1] if at[0] else None
    high = cuts[at[-1]] if at[-1] < len(cuts) else None
    if at[0] and low is None:
        df = df.where(F.lit(False))      # the part lies behind the last row
    if low is not None:
        df = df.where(F.col(order) >= low)
    if high is not None:
        df = df.where(F.col(order) < high)
    return label_parts(df, order, cuts, name)


def temporal_split(df: DataFrame, order: str, ratios: Sequence[float] = C.SPLIT_RATIOS,
                   width: int | None = None, name: str = "split", index: DataFrame | None = None) -> DataFrame:
    """Label rows train / val / test by position, without moving any of them.

    The order keys at the cut positions are looked up first. ``index`` may name a
    cheaper table that holds the same order keys.
    """
    return label_parts(df, order, temporal_cuts(df if index is None else index, order, ratios, width)[1], name)


def random_split(df: DataFrame, key: str, ratios: Sequence[float] = C.SPLIT_RATIOS, seed: int = 42,
                 name: str = "split") -> DataFrame:
    """Parts of the exact sizes in a seeded random order: rows are ordered by a hash of their unique key.

    The hash of a single BIGINT is one-to-one, so the order has no ties.
    """
    _check(ratios)
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    first, second = ratios[0], ratios[0] + ratios[1]
    _, cuts = order_cuts(hashed, "__h", [lambda n: F.floor(n * F.lit(first)), lambda n: F.floor(n * F.lit(second))])
    return hashed.withColumn(name, _label(F.col("__h"), cuts)).drop("__h")


def holdout_split(df: DataFrame, key: str, test_size: float = 0.30, val_share: float = 0.25, seed: int = 42,
                  name: str = "split") -> DataFrame:
    """Test part first, then a validation share of the rest; part sizes are rounded up."""
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))

    def train_end(n: Column) -> Column:
        rest = n - F.ceil(n * F.lit(test_size))
        return rest - F.ceil(rest * F.lit(val_share))

    _, cuts = order_cuts(hashed, "__h", [train_end, lambda n: n - F.ceil(n * F.lit(test_size))])
    return hashed.withColumn(name, _label(F.col("__h"), cuts)).drop("__h")


def fold_cuts(df: DataFrame, order: str, k: int, width: int | None = None) -> list[int | None]:
    """Order keys where the k test blocks begin; every test block has floor(n / (k + 1)) rows."""
    def start(i: int):
        return lambda n: n - (k - i) * F.floor(n / F.lit(k + 1))
    return order_cuts(df, order, [start(i) for i in range(k)], width)[1]


def assign_folds(df: DataFrame, order: str, k: int = 5, width: int | None = None) -> DataFrame:
    """One row per (row, fold it takes part in): ``fold`` 1..k and ``role`` train or test."""
    cuts = fold_cuts(df, order, k, width)
    items = []
    for i, cut in enumerate(cuts):
        if cut is None:
            continue
        end = cuts[i + 1] if i + 1 < k else None
        key = F.col(order)
        in_test = (key >= cut) if end is None else (key >= cut) & (key < end)
        role = F.when(key < cut, F.lit("train")).when(in_test, F.lit("test"))
        items.append(F.struct(F.lit(i + 1).cast("bigint").alias("fold"), role.alias("role")))
    return df.select("*", F.inline(F.array(*items))).where(F.col("role").isNotNull())


def split_manifest(df: DataFrame, features: int, targets: int, split: str = "split") -> DataFrame:
    """(split, rows, pct, features, targets)."""
    whole = Window.partitionBy(F.lit(0))   # three rows
    return (df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("pct", F.round(F.col("rows") / F.sum("rows").over(whole) * 100, 4))
            .withColumn("features", F.lit(features).cast("bigint"))
            .withColumn("targets", F.lit(targets).cast("bigint")))


def sample_rows(df: DataFrame, key: str, n: int, order: str | None = None, seed: int = 42) -> DataFrame:
    """n seeded rows without replacement, in ``order``: the n smallest key hashes (partial top-n per task)."""
    lowest = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).orderBy("__h").limit(n).drop("__h")
    return lowest.orderBy(order or key)


def holdout_sizes(n: int, test_size: float = 0.30, val_share: float = 0.25) -> tuple[int, int, int]:
    test = math.ceil(n * test_size)
    val = math.ceil((n - test) * val_share)
    return n - test - val, val, test
