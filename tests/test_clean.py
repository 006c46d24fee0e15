import pytest
from pyspark.sql import functions as F

from thermalframe.functions import cleaning
from thermalframe.functions.scalars import nan_to_null
from thermalframe.operators import clean
from thermalframe.sources.tables import ORDER, SENSORS, UNIT, sensors

SF = "/root/testdata/sf0.001"


def test_saturation_becomes_missing(spark):
    df = spark.createDataFrame([(1000.0, 100.0), (65535.0, 200.0), (2000.0, 300.0), (65535.0, 0.0), (3000.0, -999.0)],
                               "UCAF double, UCWF double")
    r = cleaning.sentinel_to_null(df, ["UCAF", "UCWF"]).agg(F.count("UCAF"), F.count("UCWF")).first()
    assert tuple(r) == (3, 3)


def test_negative_flows(spark):
    df = spark.createDataFrame([(100.0, 1000.0, -5.0), (-50.0, -500.0, None)], "UCWF double, UCAF double, UCWIT double")
    rows = cleaning.fix_negative_flows(df, df.columns).collect()
    assert [tuple(r) for r in rows] == [(100.0, 1000.0, -5.0), (0.0, 0.0, None)]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-50.0,), (500.0,), (20.0,)], "UCWIT double")
    assert [r[0] for r in cleaning.clip_physical(df, ["UCWIT"]).collect()] == [None, -10.0, 150.0, 20.0]


def test_one_expression_equals_the_three_steps(spark):
    raw = sensors(spark, SF).select(ORDER, *SENSORS)
    extra = spark.createDataFrame([(-i, *[v] * len(SENSORS)) for i, v in enumerate(
        [-1.0, 0.0, -999.0, -9999.0, 65534.0, 65534.5, 65535.0, 70000.0, 20000.0, 150.5, -10.5, float("inf"), None], 1)],
        raw.schema)
    raw = raw.unionByName(extra)
    steps = cleaning.clip_physical(cleaning.fix_negative_flows(cleaning.sentinel_to_null(raw, SENSORS), SENSORS), SENSORS)
    fused = cleaning.bound(raw, SENSORS)
    assert steps.exceptAll(fused).count() == 0 and fused.exceptAll(steps).count() == 0


def test_name_rules():
    assert cleaning.may_not_be_negative("UCFMS") and not cleaning.is_flow("UCFMS")
    assert cleaning.limits_of("UCAIH") == (0.0, 100.0)
    assert cleaning.limits_of("UCTSP") is None


def test_sparse_columns_strictly_above_limit(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i < 3 else None, 1.0 if i < 2 else None) for i in range(10)],
                               "a double, b double, c double")
    assert clean.drop_sparse_columns(df, ["a", "b", "c"])[1] == ["a", "b"]    # 70 % missing stays


def test_nan_is_missing(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, i int"))
    assert df.where("x is null").count() == 1


@pytest.mark.parametrize("strategy", ["forward_fill", "mean", "median", "interpolate"])
def test_fit_then_apply_gives_the_same_rows(spark, strategy):
    raw = sensors(spark, SF).select(ORDER, UNIT, *SENSORS)
    fitted, stats = clean.fit_clean(raw, list(SENSORS), ORDER, [UNIT], strategy, width=128)
    assert "UCAIH" not in stats.columns
    assert fitted.where(" or ".join(f"{c} is null" for c in stats.columns)).count() == 0
    assert fitted.where("UCWF < 0 or UCAF < 0").count() == 0
    again = clean.CleaningStats.from_table(stats.to_table(spark))
    assert again.as_dict() == stats.as_dict()
    applied = clean.apply_clean(raw, list(SENSORS), ORDER, again, [UNIT])
    assert applied.exceptAll(fitted.select(applied.columns)).count() == 0
    assert applied.count() == fitted.count() == 1000


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        clean._filled(spark.range(1), "nearest", "id", [], [], 10)


def test_physics_flags_and_ranges(spark):
    df = spark.createDataFrame([(10.0, 80.0, 20.0, 21.0, 5.0), (10.0, 20.0, None, 90.0, 11.0)],
                               "UCWIT double, UCWOT double, UCAIT double, UCAOT double, UCWF double")
    rows = cleaning.validate_ranges(cleaning.physics_flags(df)).collect()
    assert [(r["water_delta_T"], r["air_delta_T"]) for r in rows] == [(True, False), (False, False)]
    assert rows[0]["valid"] and rows[1]["failed"] == ["UCAIT", "UCWF"]


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, None)], "AMBT double, UCFS double, UCTSP double")
    assert tuple(cleaning.default_inputs(df).first()) == (20.0, 0.0, 21.0)
