import datetime as dt
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermalframe.operators import messages, profile, sketches, topics
from thermalframe.session import work_path
from thermalframe.streaming import jobs

LEVEL = st.sampled_from(["a", "b", "", "a+", "x.y"])
TOPIC = st.lists(LEVEL, min_size=1, max_size=4).map("/".join)
PATTERN = st.tuples(st.lists(st.one_of(LEVEL, st.just("+")), max_size=3), st.booleans()).map(lambda p: "/".join([*p[0], *(["#"] if p[1] or not p[0] else [])]))


@settings(max_examples=8, deadline=None)
@given(st.lists(TOPIC, min_size=1, max_size=30), st.lists(PATTERN, min_size=1, max_size=20))
def test_trie_equals_the_regular_expressions(spark, names, patterns):
    found = topics.match_topics(spark.createDataFrame([(t,) for t in [*names, None]], "topic string"),
                                spark.createDataFrame([(p, f"h{p}") for p in [*patterns, None]], "pattern string, handler string"))
    want = {(t, p, f"h{p}") for t, p in itertools.product(names, patterns) if re.match(messages.topic_regex(p), t)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_trie_with_many_patterns_and_a_hot_topic(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "p/0/x").otherwise(F.concat(F.lit("p/"), "id", F.lit("/x"))).alias("topic"),
                                      F.col("id").alias("pattern"))
    routes = spark.range(50_000).select(F.concat(F.lit("p/"), "id", F.lit("/+")).alias("pattern"), F.col("id").cast("string").alias("handler"))
    out = topics.route_by_trie(rows.withColumnRenamed("pattern", "n"), routes)
    assert out.count() == 30_000 and out.where("handler = '0'").count() == 10_000
    empty = topics.match_topics(rows, routes.limit(0))
    assert empty.count() == 0 and topics.match_topics(rows.limit(0), routes).count() == 0
    with pytest.raises(ValueError):
        topics.match_topics(rows, spark.createDataFrame([("a/#/b", "h")], "pattern string, handler string"))


def test_duplicates_by_digest_also_where_digests_clash(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, 1, "x"), (2, 2, None), (2, 2, None), (2, 2, None), (3, 3, "y")]
    df = spark.createDataFrame(rows, "a long, b long, c string")
    for digest in (None, F.lit(7), F.col("a")):
        assert profile.duplicate_rows_by_digest(df, df.columns, digest).first()[0] == 3
    assert profile.duplicate_rows_by_digest(df.limit(0), df.columns).first()[0] == 0


def test_states_of_days_equal_one_pass(spark):
    path = work_path(spark, "t-states")
    df = spark.range(20_000).select((F.col("id") % 5).alias("day"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 20_011).cast("double")).alias("a"),
                                    F.lit(None).cast("double").alias("b"))
    sketches.keep(df.where("day < 3"), ["a", "b"], "day", path)
    sketches.keep(df.where("day = 2").withColumn("a", F.lit(0.0)), ["a", "b"], "day", path)      # replaced next
    sketches.keep(df.where("day >= 2"), ["a", "b"], "day", path)
    got = {r["column"]: r for r in sketches.profile_of(sketches.merged(spark.read.parquet(path))).collect()}
    one = {r["column"]: r for r in sketches.profile_of(sketches.states(df, ["a", "b"])).collect()}
    exact = sorted(r.a for r in df.where("a is not null").collect())
    for column, name in itertools.product(("a", "b"), ("rows", "missing", "minimum", "maximum", "mean")):
        assert got[column][name] == one[column][name]
    for found in (got["a"], one["a"]):
        assert abs(found["distinct_estimate"] / len(set(exact)) - 1) < 0.07
        for p in (25, 50, 75):
            assert abs(sum(x <= found[f"q{p}"] for x in exact) / len(exact) - p / 100) < 0.02
    assert got["b"]["distinct_estimate"] == 0 and got["b"]["q50"] is None and got["b"]["missing"] == 20_000


def test_late_rows_go_to_their_branch_and_batches_may_repeat(spark):
    path = work_path(spark, "t-branches")
    sink = jobs.split_late_to(path, "ts", "1 hour")

    def at(*hours):
        return spark.createDataFrame([(h, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) if h is not None else None) for h in hours], "h long, ts timestamp")

    batches = [at(0, 10, 2), at(8, 9, 20), at(18, 19, None, 30), at(28)]
    for k, rows in enumerate(batches):
        sink(rows, k)
        sink(rows, k)                      # run again after a failure
    out = spark.read.parquet(f"{path}/rows")
    by = {b: sorted((r.h for r in out.where(F.col("branch") == b).collect()), key=str) for b in ("late", "good", "untimed")}
    assert by == {"late": [18, 28, 8], "good": [0, 10, 19, 2, 20, 30, 9], "untimed": [None]}


def test_counter_with_a_repeated_batch_and_a_null_unit(spark):
    path = work_path(spark, "t-totals")
    sink = jobs.count_rows_to(path, "k", "unit")
    for batch, ks in enumerate([range(5), range(5, 9), range(9, 12)]):
        rows = spark.createDataFrame([(k, None if k % 2 else "u") for k in ks], "k long, unit string")
        sink(rows, batch)
        sink(rows, batch)
    got = {r.k: r.time_index for r in spark.read.parquet(f"{path}/rows").collect()}
    assert got == {k: k // 2 for k in range(12)}
