import datetime as dt

import pytest
from pyspark.sql import functions as F

from thermalframe.operators import messages
from thermalframe.session import check_local, shared_dir, work_path
from thermalframe.streaming import jobs

import __spark_entry__ as entry


def test_topic_patterns():
    import re
    def hit(p, t): return re.match(messages.topic_regex(p), t) is not None
    assert hit("hvac/sensors/#", "hvac/sensors/data") and hit("hvac/sensors/#", "hvac/sensors")
    assert hit("hvac/+/data", "hvac/sensors/data") and not hit("hvac/+", "hvac/sensors/data")
    assert not hit("hvac/status", "hvac/status/x") and hit("#", "anything/at/all")
    with pytest.raises(ValueError):
        messages.topic_regex("a/#/b")


def test_parse_and_route(spark):
    rows = [("hvac/sensors/data", '{"timestamp":"2024-01-01T00:00:00","data":{"UCWIT":7.5}}'), ("hvac/sensors/data", "not json"),
            ("hvac/alerts/warning", '{"type":"drift"}'), ("hvac/status", None)]
    df = spark.createDataFrame(rows, "topic string, payload string")
    parsed = messages.parse_messages(df)
    good, dead = messages.split_valid(parsed)
    assert good.count() == 2 and {r["reason"] for r in dead.collect()} == {"invalid JSON"}
    assert good.where("topic = 'hvac/sensors/data'").first()["data"] == {"UCWIT": 7.5}
    binary = messages.parse_messages(df.withColumn("payload", F.encode("payload", "UTF-8")))
    assert binary.where("valid").count() == 2
    routed = messages.route(df, [("hvac/#", "all"), ("hvac/alerts/+", "alert")])
    assert routed.groupBy("handler").count().orderBy("handler").collect() == [("alert", 1), ("all", 4)]


def test_points_roundtrip(spark):
    pm = messages.point_map(spark)
    tall = spark.createDataFrame([(1, "analogInput", 0, 7.5), (1, "analogInput", 5, 21.0), (1, "analogValue", 0, 99.0)],
                                 "k long, object_type string, instance int, value double")
    row = messages.points_read(tall, pm, "k").first()
    assert row["UCWIT"] == 7.5 and row["UCTSP"] == 21.0 and row["AMBT"] is None and "UCAOT" not in row.asDict()
    pred = spark.createDataFrame([(1, 20.0, 5.0, 1.0)], "k long, UCAOT double, Q_thermal double, UCWIT double")
    out = {r["name"]: r["instance"] for r in messages.points_write(pred, pm, "k", ["UCAOT", "Q_thermal", "UCWIT"]).collect()}
    assert out == {"UCAOT": 0, "Q_thermal": 3}


def test_alert_envelope(spark):
    drift = spark.createDataFrame([("UCWIT", "WARNING"), ("AMBT", "STABLE")], "feature string, status string")
    rows = messages.alerts_from_drift(drift, F.lit(dt.datetime(2024, 1, 1))).collect()
    assert len(rows) == 1 and rows[0]["topic"] == "hvac/alerts/warning" and '"severity":"WARNING"' in rows[0]["payload"]


def test_shared_dir_is_one_place(spark):
    assert shared_dir(spark) == shared_dir(spark) and spark.sparkContext.getCheckpointDir()


def test_counter_over_several_batches_equals_row_index(spark):
    base = work_path(spark, "t-counter")
    df = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 5 == 0, "b").otherwise("hot").alias("unit"))
    out, chk = f"{base}/out", f"{base}/chk"
    for lo in (0, 100, 250):           # three arrivals, one micro-batch each
        df.where(f"k >= {lo} and k < {dict([(0, 100), (100, 250), (250, 400)])[lo]}").write.mode("append").parquet(f"{base}/in")
        stream = jobs.file_stream(spark, f"{base}/in", df.schema)
        jobs.drain(stream, chk, jobs.count_rows_to(out, "k", "unit"))
    got = {(r["unit"], r["k"]): r["time_index"] for r in spark.read.parquet(f"{out}/rows").collect()}
    want = {}
    for k in range(400):
        u = "b" if k % 5 == 0 else "hot"
        want[(u, k)] = sum(1 for (v, _) in want if v == u)
    assert got == want
    assert spark.read.parquet(f"{out}/rows").select("batch").distinct().count() == 3


STREAMED = {"stream_sensor_messages": None, "stream_parse": None, "stream_row_counter": None, "stream_retained_latest": "retained_latest",
            "stream_drift_by_window": None}


@pytest.mark.parametrize("name", STREAMED)
def test_streams_read_a_table_of_several_files(spark, tmp_path, name):
    """The same events as three part files, in several micro-batches, give what one file gives."""
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    q = entry.queries()
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = key(q[STREAMED[name] or name](spark, sf))
    assert want and key(q[name](spark, str(tmp_path))) == want


def test_files_per_batch(spark):
    base = work_path(spark, "t-batches")
    df = spark.range(60).withColumn("unit", F.lit("u"))
    df.repartitionByRange(6, "id").write.parquet(f"{base}/in")
    live = jobs.file_stream(spark, f"{base}/in", df.schema, files_per_batch=2)
    jobs.drain(live, f"{base}/chk", jobs.to_folder(f"{base}/out"))
    assert spark.read.parquet(f"{base}/out").select("batch").distinct().count() == 3


def test_equal_times_are_decided_by_the_tie(spark):
    base = work_path(spark, "t-tie")
    rows = [(i, "hvac/status", f"p{i}", dt.datetime(2024, 1, 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, topic string, payload string, ts timestamp").repartition(5)
    df.write.parquet(f"{base}/in")
    live = jobs.latest_retained(jobs.file_stream(spark, f"{base}/in", df.schema), tie="event_id")
    jobs.drain(live, f"{base}/chk", jobs.to_folder(f"{base}/out"), mode="complete")
    assert [r.payload for r in spark.read.parquet(f"{base}/out").collect()] == ["p19"]


@pytest.mark.parametrize("master, local", [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False),
                                           ("yarn", False), ("spark://h:7077", False), ("k8s://h", False)])
def test_machine_local_folder_only_for_a_local_master(master, local):
    if local:
        check_local(master)
    else:
        with pytest.raises(RuntimeError):
            check_local(master)


def test_late_rows_are_dropped(spark):
    base = work_path(spark, "t-late")
    on_time = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    late = spark.range(5).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    dropped = []
    for rows in (on_time, late):
        rows.write.mode("append").parquet(f"{base}/in")
        live = spark.readStream.schema("ts timestamp").parquet(f"{base}/in")
        q = jobs.drain(jobs.counts_by_window(live, "1 hour"), f"{base}/chk", jobs.to_folder(f"{base}/out"))
        dropped.append(jobs.dropped_late(q))
    assert dropped == [0, 5]
    assert spark.read.parquet(f"{base}/out").agg(F.sum("n")).first()[0] <= 100
