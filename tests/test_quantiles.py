import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalframe.operators import quantiles
from thermalframe.functions.scalars import to_long

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


@pytest.fixture(scope="module")
def skewed(spark):
    """One hot value, a long tail and one group with a third of all rows."""
    rng = np.random.default_rng(3)
    n = 30000
    g = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("g", (np.arange(n) % 7).astype(str)))
    x = np.where(rng.random(n) < 0.4, 5.0, rng.pareto(1.2, n) * 100)
    x[rng.random(n) < 0.05] = np.nan
    rows = [(str(a), None if np.isnan(b) else float(b)) for a, b in zip(g, x)]
    return spark.createDataFrame(rows, "g string, x double").repartition(6).cache(), g, x


@pytest.mark.parametrize("ranges", [1, 8, 60])
def test_grouped_quantiles_are_exact(spark, skewed, ranges):
    df, g, x = skewed
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        table = quantiles.grouped_quantiles(df, ["g"], "x", PROBS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    rows = table.collect()
    assert len(rows) == len(set(g))
    for r in rows:
        known = x[(g == r["g"]) & ~np.isnan(x)]
        assert r["n"] == len(known)
        np.testing.assert_allclose(r["q"], np.percentile(known, np.array(PROBS) * 100), rtol=1e-12, atol=1e-9)


def test_missing_group_all_equal_and_heavy_tails(spark):
    rng = np.random.default_rng(5)
    values = {None: rng.normal(size=999), "same": np.full(5000, 3.25), "tail": 10.0 ** rng.uniform(-300, 300, 2000),
              "one": np.array([7.0]), "ends": np.array([-np.inf, 1.0, 2.0, np.inf])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g string, x double").repartition(7)
    got = {r["g"]: r for r in quantiles.grouped_quantiles(df, ["g"], "x", (0.0, 0.5, 0.9, 1.0)).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k]["n"] == len(v)
        if k != "ends":
            np.testing.assert_allclose(got[k]["q"], np.percentile(v, [0, 50, 90, 100]), rtol=1e-12)
    assert got["ends"]["q"][1] == 1.5


def test_no_window_over_a_whole_group(skewed):
    """Values are ordered inside ranges only; what is ordered by group alone has one line per range."""
    df, _, _ = skewed
    placed = quantiles.ranged(df.where("x is not null").groupBy("g", F.col("x").alias("v")).agg(F.count("*").alias("c")), ["g"])
    hot = placed.where("g = 'hot'").groupBy("__part").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 0.9 * sum(r["count"] for r in hot)


def test_ungrouped_quantiles(skewed):
    df, _, x = skewed
    known = x[~np.isnan(x)]
    r = quantiles.grouped_quantiles(df, [], "x", (0.5, 0.95)).first()
    np.testing.assert_allclose(r["q"], np.percentile(known, [50, 95]), rtol=1e-12)


def test_column_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert quantiles.column_quantiles(df, ["a", "b"], (0.5,)) == {"a": [1.5], "b": [None]}
    assert quantiles.column_quantiles(df, [], (0.5,)) == {}


def test_ks_distance(skewed):
    df, g, x = skewed
    side = df.withColumn("ref", F.xxhash64("x", "g") % 3 != 0)
    pdf = side.toPandas()
    got = {r["g"]: r for r in quantiles.ks_distance(side, "g", "x", F.col("ref")).collect()}
    for name, rows in pdf.dropna().groupby("g"):
        a, b = np.sort(rows.x[rows.ref]), np.sort(rows.x[~rows.ref])
        at = np.concatenate([a, b])
        want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        assert got[name]["n_ref"] == len(a) and got[name]["n_cur"] == len(b)
        assert got[name]["ks"] == pytest.approx(want, abs=1e-12)


def test_ks_without_current_rows(spark):
    df = spark.createDataFrame([("f", 1.0), ("f", 2.0)], "g string, x double")
    assert quantiles.ks_distance(df, "g", "x", F.lit(True)).first()["ks"] is None


def test_kolmogorov_p(spark):
    df = spark.createDataFrame([(0.0, 100, 100), (0.192, 100, 100), (0.9, 100, 100)], "d double, a long, b long")
    p = [r[0] for r in df.select(quantiles.kolmogorov_p(F.col("d"), F.col("a"), F.col("b"))).collect()]
    assert p[0] == 1.0
    assert p[1] == pytest.approx(0.0501, abs=1e-3)     # the usual 5 % point 1.358 * sqrt(2 / n)
    assert p[2] < 1e-12


def test_long_form_is_a_projection(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "k long, a double, b double")
    assert sorted(map(tuple, to_long(df, ["a", "b"], ["k"]).collect()), key=str) == [(1, "a", 2.0), (1, "b", None)]
