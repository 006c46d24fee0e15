import math

import pytest
from pyspark.sql import functions as F

from thermalframe.functions import features, physics
from thermalframe.operators.blocks import row_index

ROWS = [(0, 20.0, 18.0, 25.0, 23.0, 100.0, 1000.0, 50.0, 22.0, 21.0, 900.0, 2.0),
        (1, 22.0, 20.0, 26.0, 24.0, 150.0, 1500.0, 55.0, 23.0, 21.0, 950.0, 0.0),
        (2, 24.0, 22.0, 27.0, 25.0, 200.0, 2000.0, None, 24.0, 22.0, 990.0, 3.0)]
SCHEMA = ("i long, UCWIT double, UCWOT double, UCAIT double, UCAOT double, UCWF double, UCAF double, UCAIH double, "
          "AMBT double, UCTSP double, UCFS double, UCWDP double")


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_deltas_and_power(df):
    rows = features.static_features(df).orderBy("i").collect()
    assert [r["delta_T_water"] for r in rows] == [2.0, 2.0, 2.0]
    assert [r["delta_T_air"] for r in rows] == [-2.0, -2.0, -2.0]
    r = rows[0]
    mdot = 100.0 * 1000 / 60000
    assert r["Q_water"] == pytest.approx(mdot * 4186 * 2 * 0.001)
    assert 0 <= r["efficiency_HX"] <= 1 and 0 <= r["NTU"] <= 10 and 0 <= r["COP_estimate"] <= 20
    assert r["Re_air_estimate"] == pytest.approx(1001 ** 0.8)
    assert r["effectiveness"] == pytest.approx(2 / (5 + 1e-9))
    assert r["NTU"] == pytest.approx(-math.log(1 - r["effectiveness"] + 1e-6))


def test_full_set_has_33_and_leak_free_19(df):
    full = features.cycle(features.static_features(row_index(df, "i")))
    names = [f for g in features.FULL_GROUPS.values() for f in g]
    assert len(names) == 33 and set(names) <= set(full.columns)
    free = features.cycle(features.leak_free(row_index(df, "i")))
    assert len(features.LEAK_FREE) == 19 and set(features.LEAK_FREE) <= set(free.columns)
    assert not {"UCAOT", "UCWOT", "UCAF"} & set(features.LEAK_FREE)


def test_features_follow_their_inputs(df):
    small = features.static_features(df.select("i", "UCWIT", "UCAIT"))
    assert set(small.columns) == {"i", "UCWIT", "UCAIT", "T_approach"}
    no_pressure = features.leak_free(df.drop("UCWDP")).first()
    assert no_pressure["P_pump_estimate"] == pytest.approx((no_pressure["UCWF"] + 1) * 0.01)


def test_serving_pump_rule(df):
    train = {r["i"]: r["P_pump_estimate"] for r in features.leak_free(df).collect()}
    serve = {r["i"]: r["P_pump_estimate"] for r in features.leak_free(df, serving=True).collect()}
    assert train[0] == serve[0] and train[2] == serve[2]
    assert train[1] == 0.0 and serve[1] == pytest.approx(1.51)


def test_cycle(spark):
    rows = features.cycle(spark.range(0, 2881, 720).withColumnRenamed("id", "time_index")).orderBy("time_index").collect()
    assert [r["cycle_hour"] for r in rows] == [0.0, 12.0, 0.0, 12.0, 0.0]
    assert rows[1]["hour_cos"] == pytest.approx(-1)


def test_zero_divisors_give_missing(spark):
    df = spark.createDataFrame([(-1.0, 5.0)], "UCWF double, UCAF double")
    assert features.ratios(df).first()["flow_ratio"] is None


def test_residuals(spark):
    df = spark.createDataFrame([(60.0, 3600.0, 20.0, 25.0, 19.0, 24.0, 100.0), (60.0, 3600.0, 20.0, 25.0, 21.0, 90.0, -10.0)],
                               "UCWF double, UCAF double, UCWIT double, UCAIT double, UCWOT_pred double, UCAOT_pred double, UCAF_pred double")
    rows = df.select(*[f().alias(n) for n, f in physics.RESIDUALS.items()]).collect()
    qw, qa = 1.0 * 4186 * 1, 1.2 * 1005 * -1
    assert rows[0]["energy"] == pytest.approx((abs(qw - qa) / 1e4 / ((abs(qw) + abs(qa)) / 2e4 + 1e-6)) ** 2)
    assert rows[0]["efficiency"] == pytest.approx((0.3 - abs(qa) / abs(qw)) ** 2, rel=1e-5)
    assert rows[0]["monotonicity"] == pytest.approx(0.5 * 0.4 ** 2)
    assert rows[1]["monotonicity"] == pytest.approx(0.1 ** 2 + 0.5 * 7.0 ** 2)
    assert rows[1]["limits"] == pytest.approx(0.1 * 1.0 + 0.05 * 0.01 ** 2)


def test_served_power(spark):
    q = spark.range(1).select(features.served_thermal_power(F.lit(60.0), F.lit(12.0), F.lit(10.0))).first()[0]
    assert q == pytest.approx(8.372)
