import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalframe.operators import scale, split


@pytest.fixture(scope="module")
def thousand(spark):
    return spark.range(1000).select((F.col("id") * 3 + 5).alias("k"), (F.col("id") % 10).cast("double").alias("x"),
                                    (F.col("id") * 2.0).alias("y"), F.lit(4.0).alias("flat"),
                                    F.when(F.col("id") < 8, "rare").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("regime"))


def test_temporal_sizes_and_order(thousand):
    parts = split.temporal_split(thousand, "k", width=100)
    r = {x["split"]: x for x in parts.groupBy("split").agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
    assert [r[s]["n"] for s in ("train", "val", "test")] == [700, 150, 150]
    assert r["train"]["hi"] < r["val"]["lo"] and r["val"]["hi"] < r["test"]["lo"]


def test_sizes_are_truncated(spark):
    n = 56211
    _, cuts = split.temporal_cuts(spark.range(n), "id")
    assert [cuts[0], cuts[1] - cuts[0], n - cuts[1]] == [39347, 8432, 8432]


def test_ratios_must_sum_to_one(thousand):
    with pytest.raises(ValueError):
        split.temporal_split(thousand, "k", (0.7, 0.2, 0.2))


def test_random_split_is_exact_and_repeatable(thousand):
    a, b = split.random_split(thousand, "k"), split.random_split(thousand.repartition(7), "k")
    assert a.select("k", "split").exceptAll(b.select("k", "split")).count() == 0
    assert {r["split"]: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 150}
    first = a.where("split = 'train'").agg(F.min("k"), F.max("k")).first()
    assert first[0] < 60 and first[1] > 2900        # mixed over the whole range


def test_holdout_sizes(thousand):
    got = {r["split"]: r["count"] for r in split.holdout_split(thousand, "k").groupBy("split").count().collect()}
    assert (got["train"], got["val"], got["test"]) == split.holdout_sizes(1000) == (525, 175, 300)


@pytest.mark.parametrize("k", [2, 5])
def test_folds(thousand, k):
    rows = split.assign_folds(thousand, "k", k, width=64).select("k", "fold", "role").collect()
    n, size = 1000, 1000 // (k + 1)
    for i in range(1, k + 1):
        start = n - (k - i + 1) * size
        test = sorted((r["k"] - 5) // 3 for r in rows if r["fold"] == i and r["role"] == "test")
        train = sorted((r["k"] - 5) // 3 for r in rows if r["fold"] == i and r["role"] == "train")
        assert test == list(range(start, start + size)) and train == list(range(start))


def test_sample_is_seeded_and_ordered(thousand):
    a = [r["k"] for r in split.sample_rows(thousand, "k", 50).collect()]
    b = [r["k"] for r in split.sample_rows(thousand.repartition(9), "k", 50).collect()]
    assert a == b == sorted(set(a)) and len(a) == 50


@pytest.mark.parametrize("method,center,spread", [
    ("standard", np.mean, np.std), ("minmax", np.min, np.ptp),
    ("robust", np.median, lambda v: np.percentile(v, 75) - np.percentile(v, 25))])
def test_scaler_roundtrip(thousand, method, center, spread):
    params = scale.params_of(scale.fit_scaler(thousand, ["x", "y", "flat"], method))
    assert params["flat"] == (4.0, 1.0)
    y = np.arange(1000) * 2.0
    np.testing.assert_allclose(params["y"], (center(y), spread(y)), rtol=1e-9)
    back = scale.invert_scaler(scale.apply_scaler(thousand, params), params).select("k", "x", "y").toPandas().sort_values("k")
    np.testing.assert_allclose(back["y"], y, rtol=1e-5, atol=1e-9)


def test_unknown_scaler(thousand):
    with pytest.raises(ValueError):
        scale.fit_scaler(thousand, ["x"], "log")


@pytest.mark.parametrize("method", scale.METHODS)
def test_regime_scaler(thousand, method):
    params = scale.fit_regime_scaler(thousand, ["x", "y"], "regime", method)
    assert {r["regime"] for r in params.collect()} == {"even", "odd"}      # eight rows are too few
    out = scale.apply_regime_scaler(thousand, params, ["x", "y"], "regime")
    assert out.where("y_scaled is null").count() == 8
    assert out.count() == 1000


def test_manifest(thousand):
    rows = {r["split"]: r for r in split.split_manifest(split.temporal_split(thousand, "k"), 2, 1).collect()}
    assert rows["train"]["pct"] == 70.0 and rows["val"]["features"] == 2


def test_select_parts(thousand):
    _, cuts = split.temporal_cuts(thousand, "k")
    whole = split.label_parts(thousand, "k", cuts)
    for wanted in (["train"], ["val"], ["test"], ["train", "val"], ["val", "test"], ["train", "val", "test"]):
        got = split.select_parts(thousand, "k", cuts, wanted)
        assert got.exceptAll(whole.where(F.col("split").isin(wanted))).count() == 0
        assert got.count() == whole.where(F.col("split").isin(wanted)).count()
    assert split.select_parts(thousand, "k", [None, None], ["val"]).count() == 0
