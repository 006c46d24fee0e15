"""Plans must keep their shape: what is pushed down, what is shuffled, what never appears."""

import pytest
from pyspark.sql import functions as F

from thermalframe.operators import blocks, split
from thermalframe.plans import queries as q

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_features_need_no_shuffle(spark):
    p = plan(q.QUERIES["feat_temperature"](spark, SF))
    assert "Exchange" not in p and "Window" not in p


def test_only_needed_columns_are_read(spark):
    p = plan(q.bounded(spark, SF).select("AMBT"))
    assert "ReadSchema: struct<event_id:bigint>" in p


def test_split_range_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    _, cuts = split.temporal_cuts(df, "event_id")
    p = plan(split.select_parts(df, "event_id", cuts, ["val"]))
    assert "GreaterThanOrEqual(event_id,700)" in p and "LessThan(event_id,850)" in p


def test_row_index_windows_are_bounded(spark):
    df = q.readings(spark, SF).select("sample_id", "unit_id")
    windows = [line for line in plan(blocks.row_index(df, "sample_id", ["unit_id"])).splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("__block" in w.split("], [")[-2] for w in windows)


@pytest.mark.parametrize("name", ["describe_stats", "feature_drift", "regression_metrics", "correlation_matrix",
                                  "bfill_limit", "ks_two_sample", "make_sequences", "points_write"])
def test_no_cross_product(spark, name):
    p = plan(q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_aggregates_combine_before_the_shuffle(spark):
    p = plan(q.QUERIES["regression_metrics"](spark, SF))
    assert "partial_avg" in p


def test_fill_reuses_its_exchange(spark):
    df = q.bounded(spark, SF)
    out = blocks.neighbours(df, "sample_id", q.S, ["unit_id"])
    out.agg(F.count("UCWIT__pd")).collect()
    assert out.count() == 1000
