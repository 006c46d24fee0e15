import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalframe.operators import drift, importance, metrics, profile, rules


def psi_brute(ref, cur, bins=10):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, bins + 1)))
    share = [np.histogram(v, bins=edges)[0] / len(v) for v in (ref, cur)] if len(edges) > 1 else [np.array([])] * 2
    r, c = (np.where(s == 0, 0.0001, s) for s in share)
    return float(np.sum((c - r) * np.log(c / r)))


def long_of(spark, data):
    rows = [(f, float(v), ref) for f, (a, b) in data.items() for ref, vs in ((True, a), (False, b)) for v in vs]
    return spark.createDataFrame(rows, "feature string, value double, is_ref boolean").repartition(4)


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(5)
    return {"same": (rng.normal(0, 1, 2000), rng.normal(0, 1, 900)),
            "moved": (rng.normal(0, 1, 2000), rng.normal(1, 2, 900)),
            "ties": (rng.integers(0, 4, 2000), rng.integers(1, 6, 900)),
            "one_value": (np.full(50, 3.0), rng.normal(3, 1, 60)),
            "outside": (rng.normal(0, 1, 500), rng.normal(50, 1, 100))}


def test_psi_equals_numpy(spark, cases):
    got = {r["feature"]: r["psi"] for r in drift.psi(long_of(spark, cases)).collect()}
    for name, (ref, cur) in cases.items():
        assert got[name] == pytest.approx(psi_brute(ref, cur), rel=1e-9, abs=1e-12), name


def test_feature_drift_statuses(spark, cases):
    def table(i):
        n = max(len(c[i]) for c in cases.values())
        cols = {k: [float(v) for v in c[i]] + [None] * (n - len(c[i])) for k, c in cases.items()}
        return spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{k} double" for k in cols))

    ref = table(0).withColumn("gone", F.lit(1.0)).withColumn("empty", F.lit(2.0))
    cur = table(1).withColumn("empty", F.lit(None).cast("double"))
    out = {r["feature"]: r for r in drift.feature_drift(ref, cur, [*cases, "gone", "empty", "never"]).collect()}
    assert out["same"]["status"] == "STABLE" and out["moved"]["status"] == "CRITICAL"
    assert out["gone"]["status"] == out["empty"]["status"] == "ERROR" and "never" not in out
    a, b = cases["moved"]
    assert out["moved"]["reference_std"] == pytest.approx(a.std(ddof=1), abs=1e-4)
    assert out["moved"]["current_std"] == pytest.approx(b.std(), abs=1e-4)
    assert out["moved"]["mean_change_pct"] == pytest.approx((b.mean() - a.mean()) / a.mean() * 100, abs=0.01)
    summary = drift.drift_summary(drift.feature_drift(ref, cur, [*cases, "gone", "empty"])).first()
    assert summary["overall_status"] == "CRITICAL" and summary["total_features"] == 7
    bad = summary["critical_features"] + summary["warning_features"]
    assert summary["drift_percentage"] == round(bad / 7 * 100, 2)


def test_empty_summary_and_report(spark):
    none = spark.createDataFrame([], "feature string, status string")
    assert drift.drift_summary(none).first()["drift_percentage"] is None
    some = spark.createDataFrame([("a", "STABLE"), ("b", "WARNING")], "feature string, status string")
    doc = json.loads(drift.report_json(some).first()["report"])
    assert doc["summary"]["overall_status"] == "WARNING" and doc["feature_drift"]["a"] == {"status": "STABLE"}


def test_report_with_prediction_drift(spark):
    some = spark.createDataFrame([("a", "CRITICAL")], "feature string, status string")
    pred = spark.createDataFrame([("UCAOT", "STABLE", 0.5)], "target string, status string, mae double")
    doc = json.loads(drift.report_json(some, pred).first()["report"])
    assert doc["prediction_drift"] == [{"target": "UCAOT", "status": "STABLE", "mae": 0.5}]
    assert doc["summary"]["drift_percentage"] == 100.0


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(5, 2, 500), rng.normal(5, 2, 500)
    y[3] = 0.0
    rows = [("t", float(a), float(b)) for a, b in zip(y, p)] + [("t", None, 1.0), ("t", 1.0, None), ("void", None, 1.0), ("flat", 2.0, 2.0), ("flat", 2.0, 3.0)]
    out = {r["target"]: r for r in metrics.regression_metrics(spark.createDataFrame(rows, "target string, y double, yhat double")).collect()}
    e = y - p
    r = out["t"]
    assert r["n"] == 500
    assert r["mae"] == pytest.approx(np.abs(e).mean(), abs=1e-4) and r["rmse"] == pytest.approx(np.sqrt((e ** 2).mean()), abs=1e-4)
    assert r["mape"] == pytest.approx(np.abs(e[y != 0] / y[y != 0]).mean() * 100, rel=1e-4)
    assert r["r2"] == pytest.approx(1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)
    assert r["max_error"] == pytest.approx(np.abs(e).max(), abs=1e-4)
    assert out["void"]["n"] == 0 and out["void"]["mae"] is None
    assert out["flat"]["r2"] == 0.0


def test_condition_bands_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (24.0,), (24.1,), (27.0,), (35.0,), (35.1,), (None,)], "v double")
    got = [r[0] for r in df.select(metrics.condition_band(F.col("v"))).collect()]
    assert [g and g.split()[0] for g in got] == [None, "Low", "Mid", "Mid", "High", None, None]


def test_prediction_drift(spark):
    long = spark.createDataFrame([("t", float(i), i + 1.0) for i in range(20)], "target string, y double, yhat double")
    ref = spark.createDataFrame([("t", 1.0, 1.0, 0.9)], "target string, mae double, rmse double, r2 double")
    r = drift.prediction_drift(long, ref).first()
    assert r["status"] == "WARNING" and r["mae_drift_pct"] == 0.0 and r["r2_drift"] == pytest.approx(-0.0699, abs=1e-3)


def test_psi_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (0.3,), (0.6,)], "v double")
    got = [tuple(r) for r in df.select(drift.psi_band(F.col("v")), drift.psi_band(F.col("v"), True)).collect()]
    assert got == [("none", "ok"), ("slight", "ok"), ("slight", "ok"), ("significant", "warning"), ("significant", "critical")]


def test_correlations_equal_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (800, 4)), columns=list("abcd"))
    pdf["c"] = pdf["a"] * 2 + rng.normal(0, 0.1, 800)
    pdf["flat"] = 1.0
    pdf[rng.random((800, 5)) < 0.2] = np.nan
    df = spark.createDataFrame(pdf).repartition(7)
    want = pdf.corr()
    for r in profile.correlation_matrix(df, list(pdf.columns)).collect():
        w = want.loc[r["a"], r["b"]]
        assert (r["r"] is None) if np.isnan(w) else r["r"] == pytest.approx(w, abs=1e-9)
    assert [(r["a"], r["b"]) for r in profile.high_corr_pairs(df, list(pdf.columns)).collect()] == [("a", "c")]


def test_summary_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9, 30)], "x double")
    r = profile.summary_extended(df, ["x"]).first()
    assert r["skew"] == pytest.approx(1.899156, abs=1e-6) and r["kurtosis"] == pytest.approx(3.648456, abs=1e-6)
    assert r["unique"] == 5 and r["q50"] == 4.0


def test_duplicates_count_missing_as_equal(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, None), (2.0, 1.0)], "a double, b double")
    assert profile.duplicate_rows(df, ["a", "b"]).first()[0] == 2


def test_histogram_equals_numpy(spark):
    x = np.random.default_rng(4).normal(0, 1, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r["bin"]: r["n"] for r in profile.histogram(df, ["x"]).collect()}
    want = np.histogram(x, 50)[0]
    assert [got.get(i, 0) for i in range(50)] == list(want)


def test_importance_tables(spark):
    mean = spark.createDataFrame([("Q_water", 0.5), ("delta_T_water", 0.2), ("other", 0.9)], "feature string, mean double")
    groups = importance.group_table(spark, importance.groups_by_mark(["Q_water", "delta_T_water", "Q_imbalance"]))
    got = {r["group"]: (r["n_features"], r["sum_importance"]) for r in importance.importance_groups(mean, groups).collect()}
    assert got == {"thermal_power": (1, 0.5), "temperature_deltas": (1, 0.2)}
    aligned = importance.align_models({"m": mean, "n": mean.where("mean > 0.4")}).orderBy("feature").collect()
    assert [(r["feature"], r["m"], r["n"]) for r in aligned] == [("Q_water", 0.5, 0.5), ("delta_T_water", 0.2, None), ("other", 0.9, 0.9)]


def test_rules(spark):
    kpi = rules.kpi_levels(spark.createDataFrame([("disk_free_pct", 12.0), ("cpu_pct", 60.0), ("drift_psi", 0.3), ("memory_mb", 100.0)],
                                                 "metric string, value double"), rules.kpi_rules(spark))
    assert {r["metric"]: r["level"] for r in kpi.collect()} == {
        "disk_free_pct": "WARNING", "cpu_pct": "WATCH", "drift_psi": "CRITICAL", "memory_mb": "OK"}
    pair = spark.createDataFrame([(0.9, 1.0, 0.8, 2.0, 12.5, 50.0), (0.7, 3.0, 0.8, 2.0, -12.5, -50.0), (0.79, 2.0, 0.8, 2.0, -1.25, 0.0)],
                                 "candidate_r2 double, candidate_mape double, baseline_r2 double, baseline_mape double, r2_gain_pct double, mape_gain_pct double")
    assert [r["decision"] for r in rules.model_acceptance(pair, F.lit(1.0)).collect()] == ["accept", "reject", "review"]
    old = spark.sql("select * from values (timestamp'2024-01-01', 'log'), (timestamp'2024-01-01', 'drift_report'), (timestamp'2024-03-01', 'log') t(ts, kind)")
    assert rules.retention_filter(old, F.col("kind")).count() == 2


def test_path_p_equals_a_count_of_all_paths():
    """All orders of two samples counted cell by cell, for every size up to 12 x 12 and every distance."""
    from fractions import Fraction
    from math import comb

    for m in range(1, 13):
        for n in range(1, 13):
            for far in sorted({abs(i * n - j * m) for i in range(m + 1) for j in range(n + 1)} - {0}):
                inside = [[0] * (n + 1) for _ in range(m + 1)]
                for i in range(m + 1):
                    for j in range(n + 1):
                        if abs(i * n - j * m) < far:
                            inside[i][j] = 1 if i == j == 0 else (inside[i - 1][j] if i else 0) + (inside[i][j - 1] if j else 0)
                want = float(1 - Fraction(inside[m][n], comb(m + n, n)))
                assert drift.path_p(m, n, far / (m * n)) == pytest.approx(want, rel=1e-12, abs=1e-15)
    assert drift.path_p(7, 5, 0.0) == 1.0 and drift.path_p(0, 5, 0.5) == 1.0
    assert 0 < drift.path_p(2000, 1500, 0.5) < 1e-100


def test_exact_p_meets_the_limit_and_keeps_nulls(spark):
    rows = [("a", 3000, 2500, 0.035), ("b", 5, 0, None), ("c", 4, 4, 1.0), ("d", 3, 4, 0.25)]
    ks = spark.createDataFrame(rows, "feature string, n_ref long, n_cur long, ks double")
    got = {r.feature: r.p_value for r in drift.with_best_p_value(ks).collect()}
    far = {r.feature: r.p_value for r in drift.with_best_p_value(ks, largest=2).collect()}
    assert got["a"] == pytest.approx(far["a"], rel=0.05) and got["b"] is None
    assert got["c"] == pytest.approx(2 / 70) and got["d"] == pytest.approx(drift.path_p(4, 3, 0.25))
