import gzip
import hashlib
import random

import pytest

from thermalframe.llm import warc
from thermalframe.session import work_path

BIG = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, f"http://h{rng.randrange(5)}.example.com/{rng.randrange(30)}", f"<html>{i}" + "y" * rng.randrange(3000)) for i in range(200)]
    out += [(1000 + i, "http://WWW.hot.example.com:81/a?b=C", BIG) for i in range(50)]
    out += [(2000, None, None), (2001, "", ""), (2002, "not a url", "z" * 999), (2003, "http://[bad", "z" * 999), (2004, "a\r\nWARC-Type: x", "s")]
    out += [(None, "http://n/", BIG), (None, "http://n/", "only null " * 200), (None, "http://n/", "only null " * 200)]
    out += [(3000, "http://x/", "é" * 500), (3001, "http://x/", "é" * 500), (3002, "http://x/", "é" * 499), (3003, "http://x/", "é" * 499)]
    out += [(4000, "http://twice/", "t" * 2000), (4000, "http://twice/", "t" * 2000), (4001, "http://long/", "long " * 2_000_000)]
    return out


def expected(rows):
    owner = {}
    for i, _, html in rows:
        owner.setdefault(html, []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in owner[html] if x is not None]
        top = max(ids, default=None)
        revisit = len(data) >= 1000 and top is not None and (i is None or i < top)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [100_000, 0])
def test_round_trip(spark, rows, monkeypatch, small):
    monkeypatch.setattr(warc, "SMALL_PAYLOADS", small)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, digest string").repartition(5)
    path = work_path(spark, "warc")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path)
    assert rows_of(got) == expected(rows)
    listed = got.collect()
    assert [warc.order_of(r) for r in listed] == sorted(warc.order_of(r) for r in listed)


def test_files_are_plain_archives(spark, rows):
    path = work_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows[:20], "page_id long, url string, html string").coalesce(1), path)
    (name,) = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path").collect()]
    data = gzip.open(name.removeprefix("file:")).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == 20


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(40))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Example.com/A?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("http://a.b.c:80") == "c,b,a:80)/"
    assert warc.hex_digest("sha1:" + "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ") == hashlib.sha1(b"").hexdigest()


def test_damage_is_seen():
    with pytest.raises(ValueError):
        warc.capture("f", 0, {"warc-payload-digest": "sha1:" + "0" * 40, "warc-type": "response", "warc-date": "", "warc-record-id": "<urn:page:1>"},
                     b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
