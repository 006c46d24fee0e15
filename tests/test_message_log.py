import os

import pytest
from pyspark.sql import functions as F

from thermalframe.session import work_path
from thermalframe.sources import message_log
from thermalframe.streaming import jobs

FIELDS = "event_id long, topic string, payload string"


def rows(spark, lo, hi):
    payload = F.concat(F.lit('{"text":"'), F.repeat(F.lit("é"), (F.col("id") % 40).cast("int")), F.lit('"}'))
    return spark.range(lo, hi, numPartitions=3).select(F.col("id").alias("event_id"), F.lit("hvac/status").alias("topic"), payload.alias("payload"))


def raw(path, segment, files, done=True):
    folder = message_log.segment_path(path, segment)
    os.makedirs(folder)
    for name, data in {**files, **({message_log.DONE: b""} if done else {})}.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


@pytest.mark.parametrize("range_bytes", [1, 7, 100, 1 << 20])
def test_any_cut_gives_every_line_once(spark, tmp_path, range_bytes, monkeypatch):
    monkeypatch.setattr(message_log, "CHUNK_BYTES", 5)
    lines = [b"a", b"", b"bb" * 20, b"\xff\xfe", b"c\r", b"last without an end"]
    raw(str(tmp_path), 0, {"part-1": b"\n".join(lines), "part-2": b"", "_hidden": b"no\n"})
    log = message_log.Log({"path": str(tmp_path), "rangebytes": str(range_bytes)})
    got = [(p, line) for r in log.ranges(0, 1) for b in log.lines(r) for p, line in zip(b["position"].to_pylist(), b["line"].to_pylist())]
    want, at = [], 0
    for line in lines:
        want += [(at, line)] if line else []
        at += len(line) + 1
    assert got == want


def test_published_messages_come_back(spark):
    path = work_path(spark, "t-log")
    message_log.publish(rows(spark, 0, 300), path, 0)
    message_log.publish(rows(spark, 300, 500), path, 1)
    message_log.publish(rows(spark, 300, 400), path, 1)          # a repeated segment replaces itself
    back = message_log.messages(message_log.read_log(spark, path, range_bytes=512), FIELDS)
    assert back.where("reason IS NOT NULL").count() == 0
    got = sorted(map(tuple, back.select("event_id", "topic", "payload").collect()))
    assert got == sorted(map(tuple, rows(spark, 0, 400).collect()))


def test_bad_lines_are_dead_and_whole(spark, tmp_path):
    good = b'{"event_id":1,"topic":"t","payload":"{}"}'
    bad = {b'{"event_id":2,"topic":"t","payload":"oops"}': "invalid JSON", b"\xff{}": "invalid UTF-8", b"{half": "invalid envelope",
           b"[1]": "invalid envelope", b'{"event_id":3}': "invalid JSON", b"  ": "invalid envelope"}
    raw(str(tmp_path), 0, {"part-0": b"\n".join([good, *bad]) + b"\n"})
    got = message_log.messages(message_log.read_log(spark, f"file:{tmp_path}"), FIELDS).collect()
    assert {bytes(r.line): r.reason for r in got} == {good: None, **bad}
    assert {r.reason: r.event_id for r in got}[None] == 1


def test_incomplete_segments_and_empty_logs(spark, tmp_path):
    assert message_log.read_log(spark, f"{tmp_path}/none").count() == 0
    raw(str(tmp_path), 0, {"part-0": b"a\n"})
    raw(str(tmp_path), 1, {"part-0": b"b\n"}, done=False)
    raw(str(tmp_path), 2, {"part-0": b"c\n"})
    assert [bytes(r.line) for r in message_log.read_log(spark, str(tmp_path)).collect()] == [b"a"]


def test_stream_restarts_exactly_once(spark):
    """A sink that fails after it has written, and segments that come between runs: each message is there once."""
    base = work_path(spark, "t-log-stream")
    log, out = f"{base}/log", jobs.to_folder(f"{base}/out")
    follow = lambda: message_log.messages(message_log.read_log(spark, log, range_bytes=999, stream=True), FIELDS)
    message_log.publish(rows(spark, 0, 100), log, 0)
    jobs.drain(follow(), f"{base}/chk", out)
    message_log.publish(rows(spark, 100, 250), log, 1)

    def fails(batch, batch_id):
        out(batch, batch_id)
        raise RuntimeError("lost")
    with pytest.raises(Exception):
        jobs.drain(follow(), f"{base}/chk", fails)
    message_log.publish(rows(spark, 250, 300), log, 2)
    jobs.drain(follow(), f"{base}/chk", out)
    jobs.drain(follow(), f"{base}/chk", out)
    got = spark.read.parquet(f"{base}/out")
    assert sorted(r.event_id for r in got.select("event_id").collect()) == list(range(300))
    assert sorted(r.segment for r in got.select("segment").distinct().collect()) == [0, 1, 2]
