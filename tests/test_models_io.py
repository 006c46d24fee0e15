import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermalframe.operators import models, split
from thermalframe.plans import pipeline
from thermalframe.session import work_path
from thermalframe.sources import io
from thermalframe.sources.tables import ORDER, SENSORS, UNIT, sensors


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select("id", (F.col("id") % 13).cast("double").alias("u"), (F.col("id") % 7).cast("double").alias("w"))
    df = df.withColumn("y", 3.0 + 2.0 * F.col("u") - F.col("w")).withColumn("z", F.col("u") * F.col("w"))
    return split.temporal_split(df, "id").cache()


def test_linear_recovers_coefficients(rows):
    m = models.fit_per_target(rows, ["u", "w"], ["y"], models.linear)["y"]
    assert m.intercept == pytest.approx(3.0) and list(m.coefficients) == pytest.approx([2.0, -1.0])


def test_ridge_equals_the_closed_form(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 2)) * [1.0, 20.0] + [5.0, -3.0]
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=5000)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "p double, q double, y double").repartition(7)
    for alpha in (0.0, 1.0, 1000.0):
        m = models.fit_least_squares(df, ["p", "q"], ["y"], alpha)["y"]
        s, t = x.std(axis=0), y.std()
        z, v = (x - x.mean(axis=0)) / s, (y - y.mean()) / t
        b = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ v) * t / s
        assert m.coefficients == pytest.approx(b.tolist(), rel=1e-9) and m.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ b)
    m = models.fit_least_squares(df, ["p", "q"], ["y"])["y"]
    e = m.transform(df).select((F.col("y") - F.col("y_pred")).alias("e"), "p", "q")
    sums = e.agg(F.sum("e"), F.sum(F.col("e") * F.col("p")), F.sum(F.col("e") * F.col("q"))).first()
    assert all(abs(x) < 1e-6 for x in sums)


def test_rows_without_a_value_are_left_out_per_target(spark):
    nan = None
    df = spark.createDataFrame([(1.0, 2.0, nan), (2.0, 4.0, 1.0), (3.0, 6.0, 0.0), (nan, 1.0, 1.0)], "x double, y double, z double")
    m = models.fit_least_squares(df, ["x"], ["y", "z"])
    assert m["y"].coefficients == pytest.approx([2.0]) and m["z"].coefficients == pytest.approx([-1.0])


def test_linear_save_and_load(spark, rows):
    path = work_path(spark, "t-linear")
    bundle = models.fit_per_target(rows, ["u", "w"], ["y", "z"], models.linear)
    models.save_bundle(bundle, path, spark, ["u", "w"])
    assert models.load_bundle(path, spark) == (bundle, ["u", "w"])


def test_trees_save_load_and_score(spark, rows):
    bundle = models.fit_per_target(rows.where("split = 'train'"), ["u", "w"], ["y", "z"], lambda t: models.random_forest(t, 5, 5))
    path = work_path(spark, "t-bundle")
    models.save_bundle(bundle, path, spark, ["u", "w"])
    loaded, names = models.load_bundle(path, spark)
    assert names == ["u", "w"] and set(loaded) == {"y", "z"}
    a, b = (models.predict_all(rows, m, names).select("id", "y_pred", "z_pred") for m in (bundle, loaded))
    assert a.exceptAll(b).count() == 0
    imp = models.tree_importance(bundle, names, spark).groupBy("target").agg(F.sum("importance").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in imp)
    table = models.compare(rows, {"forest": bundle}, names)
    assert table.count() == 6


def test_folds_are_refitted(rows):
    out = models.refit_on_folds(rows.drop("split"), "id", ["u", "w"], ["y"], models.linear, k=2)
    assert out.count() == 4 and all(r["r2"] == pytest.approx(1.0) for r in out.collect())
    over = models.over_folds(out).collect()
    assert len(over) == 2 and all(r["folds"] == 2 and r["r2_std"] == pytest.approx(0.0, abs=1e-9) for r in over)


def test_user_model_scores_in_batches(rows):
    def predict(f: pd.DataFrame) -> pd.Series:
        return 3.0 + 2.0 * f["u"] - f["w"]
    bad = rows.withColumn("p", models.score_with(predict, ["u", "w"])).where("abs(p - y) > 1e-9")
    assert bad.count() == 0


def test_csv_reader_trims_and_drops_empty_rows(spark):
    path = work_path(spark, "t-csv")
    spark.createDataFrame([("a; b",), ("1.5;  2.5",), (";",), ("NaN; 3",)], "value string").coalesce(1).write.text(path)
    got = io.read_sensor_csv(spark, path, io.sensor_schema(["a", "b"])).orderBy("b").collect()
    assert [tuple(r) for r in got] == [(1.5, 2.5), (None, 3.0)]


def test_union_history(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(2, 3.0, 4.0)], "k int, x double, extra double")
    assert io.union_history(a, b).orderBy("k").collect() == [(1, 2.0, None), (2, 3.0, 4.0)]


def test_pipeline_writes_a_pruned_scaled_data_set(spark):
    df = sensors(spark, "/root/testdata/sf0.001").select(ORDER, UNIT, *SENSORS)
    path = pipeline.prepare(df, list(SENSORS), ORDER, [UNIT], work_path(spark, "t-prepared"))
    data = spark.read.parquet(f"{path}/data")
    assert {r["split"]: r["count"] for r in data.groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 150}
    train = data.where("split = 'train'").agg(F.avg("UCWIT"), F.stddev_pop("UCWIT")).first()
    assert train[0] == pytest.approx(0.0, abs=1e-9) and train[1] == pytest.approx(1.0)
    params = {r["column"] for r in spark.read.parquet(f"{path}/scaler").collect()}
    assert "Q_max_water" in params and "UCAIH" not in data.columns
    plan = data.where("split = 'val'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
