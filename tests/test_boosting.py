import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermalframe.operators import boosting as B
from thermalframe.operators import models
from thermalframe.session import work_path


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 2500
    x = rng.normal(size=(n, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["y"] = np.sin(x[:, 0] * 2) + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=n)
    pdf["z"] = np.abs(x[:, 3])
    pdf["noise"] = rng.normal(size=n)
    pdf["id"] = np.arange(n)
    pdf["v"] = np.arange(n) % 5 == 0
    pdf.loc[:50, "z"] = np.nan
    df = spark.createDataFrame(pdf).repartition(4)
    return df.withColumn("z", F.when(~F.isnan("z"), F.col("z"))).cache(), pdf, x


def plain_tree(bins, g, columns, p, node=0, level=0):
    """One tree by recursion: every split of every drawn column tried, sums made anew."""
    soft = lambda v: np.sign(v) * max(abs(v) - p.l1, 0)
    score = lambda v: soft(v.sum()) ** 2 / (len(v) + p.l2)
    best = None
    if level < p.depth:
        for f in columns:
            for b in range(p.bins - 1):
                left = bins[:, f] <= b
                if min(left.sum(), (~left).sum()) < p.min_rows:
                    continue
                gain = (score(g[left]) + score(g[~left]) - score(g)) / 2 - p.least_gain
                if gain > 0 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, b, left
    if best is None:
        return {node: -p.rate * soft(g.sum()) / (len(g) + p.l2)}
    _, f, b, left = best
    return {**plain_tree(bins[left], g[left], columns, p, 2 * node + 1, level + 1),
            **plain_tree(bins[~left], g[~left], columns, p, 2 * node + 2, level + 1)}


@pytest.mark.parametrize("seed, l1, l2, least_gain, min_rows", [(1, 0.1, 1.0, 0.0, 3), (2, 2.0, 0.0, 0.5, 1), (3, 0.0, 5.0, 0.1, 20)])
def test_leaf_weights_equal_plain_version(seed, l1, l2, least_gain, min_rows):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 8, (300, 5)).astype(np.uint8)
    g = rng.normal(size=300) + (bins[:, 2] > 3) - (bins[:, 0] > 5) * 2.0
    p = B.Boosting(depth=4, l1=l1, l2=l2, least_gain=least_gain, min_rows=min_rows, bins=8, rate=0.3)
    columns = np.array([0, 2, 3])
    split, cut, leaf, _ = B.grow(bins, g, columns, p)
    at = B.walk(bins, split, cut)
    want = plain_tree(bins, g, columns, p)
    assert set(at.tolist()) == set(want) and set(split.tolist()) <= {-1, 0, 2, 3}
    assert all(leaf[i] == pytest.approx(w) for i, w in want.items())


@pytest.mark.parametrize("patience", [3, 50])
def test_both_ways_grow_the_same_trees(spark, table, monkeypatch, patience):
    df, pdf, x = table
    p = B.Boosting(trees=12, depth=3, rate=0.4, validation="v", patience=patience, least_gain=0.0)
    monkeypatch.setattr(B, "KEEP", 5)
    near = B.fit_boosted(df, list("abcd"), ["y", "z", "noise"], p)[0]
    monkeypatch.setattr(B, "TASK_ROWS", 10)
    far = B.fit_boosted(df, list("abcd"), ["y", "z", "noise"], p)[0]
    for t in near:
        assert near[t].n_trees == far[t].n_trees and near[t].losses == pytest.approx(far[t].losses)
        assert np.array_equal(near[t].split, far[t].split) and np.allclose(near[t].predict(x), far[t].predict(x))


def test_patience(table):
    df, pdf, x = table
    p = B.Boosting(trees=200, depth=3, rate=0.5, validation="v", patience=4, least_gain=0.0)
    fitted = B.fit_boosted(df, list("abcd"), ["noise"], p)[0]["noise"]
    low = int(np.argmin(fitted.losses))
    assert fitted.n_trees == low + 1 and len(fitted.losses) == low + 1 + 4 < 200
    assert all(v >= fitted.losses[low] for v in fitted.losses[low + 1:])


def test_scores_and_importance(spark, table):
    df, pdf, x = table
    bundle = models.fit_per_target(df.where("not v"), list("abcd"), ["y", "z"], lambda t: models.boosted_trees(t, 60, 5, 0.2))
    scored = models.predict_all(df, bundle, list("abcd")).toPandas().sort_values("id")
    assert np.allclose(scored["y_pred"], bundle["y"].predict(x))
    held = pdf["v"].to_numpy()
    assert 1 - ((scored["y_pred"].to_numpy() - pdf["y"])[held] ** 2).mean() / pdf["y"][held].var() > 0.9
    shares = {(r.target, r.feature): r.importance for r in models.tree_importance(bundle, list("abcd"), spark).collect()}
    assert shares["z", "d"] > 0.9 and sum(v for (t, _), v in shares.items() if t == "y") == pytest.approx(1.0)
    path = work_path(spark, "t-boosted")
    models.save_bundle(bundle, path, spark, list("abcd"))
    loaded, names = models.load_bundle(path, spark)
    assert names == list("abcd") and all(np.array_equal(loaded[t].predict(x), bundle[t].predict(x)) for t in bundle)


def test_folds_equal_fits_made_one_by_one(table):
    df, pdf, x = table
    p = B.Boosting(trees=15, depth=3, rate=0.3, patience=5, least_gain=0.0)
    got = models.refit_on_folds(df.select("id", *"abcd", "y"), "id", list("abcd"), ["y"], lambda t: p, k=3)
    scores = {(r["fold"], r["role"]): r["r2"] for r in got.collect()}
    n = len(pdf)
    test = n // 4
    bins = B.bin_edges(df, list("abcd"), p.bins)
    for fold in (1, 2, 3):
        cut, end = n - (4 - fold) * test, n - (3 - fold) * test
        rows = df.where(F.col("id") < end).withColumn("w", F.col("id") >= cut)
        one = B.fit_boosted(rows, list("abcd"), ["y"], B.Boosting(**{**p.__dict__, "validation": "w"}))[0]["y"]
        y = pdf["y"].to_numpy()[cut:end]
        r2 = 1 - ((one.predict(x[cut:end]) - y) ** 2).mean() / y.var()
        assert scores[fold, "test"] == pytest.approx(r2, abs=0.05) and len(bins) == 4


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, 1.0, None), (1.0, 2.0, None), (1.0, 4.0, None)], "a double, y double, z double")
    got = B.fit_boosted(df, ["a"], ["y", "z"], B.Boosting(trees=3, min_rows=1))[0]
    assert got["z"].n_trees == 0 and got["z"].predict(np.array([[1.0]])).tolist() == [0.0]
    assert got["y"].predict(np.array([[1.0]]))[0] == pytest.approx(3.0, abs=0.2)
    assert B.fit_boosted(df.where("false"), ["a"], ["y"], B.Boosting(trees=2))[0]["y"].base == 0.0


def test_packed_sums_are_exact():
    rng = np.random.default_rng(5)
    n = 70_000
    g, used = rng.standard_t(2, n), rng.random(n) < 0.7
    own = g.copy()
    step = B.packed(own, used)
    near = np.clip(np.rint(g / step), 1 - B.STEPS, B.STEPS - 1) * step
    assert np.abs(near - g)[used].max() <= np.abs(g[used]).max() / (B.STEPS / 2)
    place = rng.integers(0, 9, n)
    place[:B.PIECE] %= 2                                   # nearly all rows in two cells
    rows = np.flatnonzero(used)[:B.PIECE]
    s, h = B.unpacked(np.bincount(place[rows], own[rows], 9), step)
    assert h.tolist() == np.bincount(place[rows], minlength=9).tolist()
    assert s.tolist() == np.bincount(place[rows], near[rows], 9).tolist()
    assert B.unpacked(np.bincount(np.zeros(B.PIECE, int), np.full(B.PIECE, B.ONE + 1 - B.STEPS)), 1.0)[0][0] == B.PIECE * (1 - B.STEPS)


@pytest.mark.parametrize("columns, pair_slots", [([0, 1, 3, 4], 4), ([0, 2, 3], 4), ([2, 4, 1], 0)])
def test_large_trees_are_summed_packed_and_equal_the_exact_ones(monkeypatch, columns, pair_slots):
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 8, (900, 5)).astype(np.uint8)
    g = np.round(rng.normal(size=900) * 64) / 64 + (bins[:, 2] > 3) - (bins[:, 3] > 5) * 2.0
    used, p = rng.random(900) < 0.8, B.Boosting(depth=4, min_rows=5, bins=8, least_gain=0.01)
    grown = lambda: B.grow_columns(bins, np.ascontiguousarray(bins.T), g.copy(), used, np.array(columns), p)
    exact, at = grown()
    for name, value in (("EXACT_ROWS", 10), ("PIECE", 128), ("PAIR_SLOTS", pair_slots)):
        monkeypatch.setattr(B, name, value)
    large, large_at = grown()
    assert np.array_equal(exact[0], large[0]) and np.array_equal(exact[1], large[1]) and np.allclose(exact[2], large[2])
    assert np.array_equal(at, large_at) and np.array_equal(at, B.walk(bins, exact[0], exact[1])) and (exact[0] >= 0).sum() > 5


def test_computed_features_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(v):
        made.add(1)
        return float(v)

    df = spark.range(500).select(costly("id").alias("a")).withColumn("b", F.col("a") + 1).withColumn("y", F.col("a") % 7)
    B.fit_boosted(df, ["a", "b"], ["y"], B.Boosting(trees=1, depth=2))
    assert made.value == 500


def test_a_table_of_some_million_rows_is_fitted_in_a_few_jobs(spark):
    """Beyond a million rows each level of each tree used to be a job."""
    df = spark.range(1_100_000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("y"))
    spark.sparkContext.setJobGroup("boost-many", "")
    try:
        B.fit_boosted(df, ["a"], ["y"], B.Boosting(trees=6, depth=3))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boost-many")) < 15
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
