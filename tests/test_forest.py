import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from thermalframe.operators import forest as R
from thermalframe.operators import models
from thermalframe.plans import queries as q
from thermalframe.session import work_path

SF = "/root/testdata/sf0.001"


def plain_tree(bins, y, w, p, level=0):
    """(column, bin, left, right) or the mean of the leaf, by recursion over all columns and bins."""
    best, mean = (0.0,), (w * y).sum() / w.sum()
    took = lambda m: (w * y)[m].sum() ** 2 / w[m].sum()
    for f in range(bins.shape[1] if level < p.depth else 0):
        for b in range(p.bins - 1):
            left = bins[:, f] <= b
            if min(w[left].sum(), w[~left].sum()) < p.min_rows:
                continue
            gain = took(left) + took(~left) - took(w > 0)
            if gain > best[0] + 1e-9:
                best = gain, f, b, left
    if len(best) == 1:
        return mean
    _, f, b, left = best
    return f, b, plain_tree(bins[left], y[left], w[left], p, level + 1), plain_tree(bins[~left], y[~left], w[~left], p, level + 1)


def plain_predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2 + int(row[tree[0]] > tree[1])]
    return tree


@pytest.mark.parametrize("depth, min_rows, nodes, piece", [(4, 2, 512, 1 << 15), (15, 5, 2, 7), (3, 40, 1, 64), (0, 2, 512, 64)])
def test_tree_equals_plain_version(monkeypatch, depth, min_rows, nodes, piece):
    monkeypatch.setattr(R, "NODES", nodes)
    monkeypatch.setattr(R, "PIECE", piece)
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 8, (300, 4)).astype(np.uint8)
    y = rng.normal(size=300) + 3 * (bins[:, 1] > 4) + (bins[:, 0] > 2)
    drawn = rng.poisson(1.0, 300).astype(np.uint8)
    p = R.Forest(trees=1, depth=depth, min_rows=min_rows, bins=8)
    split, cut, leaf, gains = R.grow(bins, y, drawn, p, rng)
    on = drawn > 0
    want = plain_tree(bins[on], y[on], drawn[on].astype(float), p)
    got = R.mean_of_trees(bins, [R._moves(split, cut, leaf)])
    assert got == pytest.approx([plain_predict(want, r) for r in bins])
    assert (split < 0).sum() == len(leaf) and (gains.sum() > 0) == (depth > 0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 5))
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["y"] = np.sin(x[:, 0] * 2) + (x[:, 1] > 0) * 2 + 0.1 * rng.normal(size=3000)
    pdf["z"] = x[:, 2]
    pdf["v"] = np.arange(3000) % 5 == 0
    df = spark.createDataFrame(pdf).repartition(4)
    return df.withColumn("z", F.when(F.col("a") < 1, F.col("z"))).withColumn("e", F.when(F.col("v") | (F.col("d") < 2), F.col("e")))


def test_forest_is_fitted_in_a_few_jobs_and_as_good_as_that_of_mllib(spark, table, monkeypatch):
    """MLlib makes at least one job a level of the trees."""
    make, names = (lambda t: models.random_forest(t, 30, 12)), list("abcde")
    spark.sparkContext.setJobGroup("forest", "")
    try:
        ours = models.fit_per_target(table.where("not v"), names, ["y", "z"], make)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) < 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(len(m.split) == 30 for m in ours.values())
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    mllib = models.fit_per_target(table.where("not v"), names, ["y", "z"], make)
    assert all(isinstance(m, PipelineModel) for m in mllib.values())
    held = table.where("v")
    a, b = ({r["target"]: r for r in models.evaluate(held, m, names).collect()} for m in (ours, mllib))
    for t in ("y", "z"):
        assert a[t]["n"] == b[t]["n"] and a[t]["r2"] > 0.85 and a[t]["r2"] == pytest.approx(b[t]["r2"], abs=0.03)
    shares = [{(r["target"], r["feature"]): r["importance"] for r in models.tree_importance(m, names, spark).collect()} for m in (ours, mllib)]
    assert shares[0] == pytest.approx(shares[1], abs=0.05) and sum(v for (t, _), v in shares[0].items() if t == "y") == pytest.approx(1.0)


def test_draws_do_not_depend_on_how_rows_are_dealt_out(table):
    names = list("abcde")
    one, two = (R.fit_forests(df, names, ["y"], R.Forest(trees=5, depth=6))["y"] for df in (table.coalesce(1), table.coalesce(1).repartition(3)))
    assert one.edges[0][:3] == pytest.approx(two.edges[0][:3], abs=0.1) and len({s.tobytes() for s in one.split}) == 5
    path = work_path(table.sparkSession, "t-forest")
    models.save_bundle({"y": one}, path, table.sparkSession, names)
    loaded = models.load_bundle(path, table.sparkSession)[0]["y"]
    x = np.random.default_rng(1).normal(size=(50, 5))
    assert np.array_equal(loaded.predict(x), one.predict(x)) and np.array_equal(loaded.importance(), one.importance())


def test_rows_without_a_value(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, 9.0, None), (3.0, 2.0, None)], "a double, y double, z double")
    assert R.fit_forests(df, ["a"], ["y"], R.Forest(trees=3))["y"].predict(np.array([[5.0]])).tolist() == [2.0]
    with pytest.raises(ValueError, match="no row"):
        R.fit_forests(df, ["a"], ["y", "z"], R.Forest(trees=3))


@pytest.mark.parametrize("name, most", [("importance_long", 30), ("importance_mean_trees", 30), ("compare_models", 60)])
def test_registered_forests_make_no_job_a_level(spark, name, most):
    spark.sparkContext.setJobGroup(f"jobs-{name}", "")
    try:
        q.QUERIES[name](spark, SF, trees=4, depth=15)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"jobs-{name}")) <= most
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
