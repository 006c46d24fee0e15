"""WARC archives of pages, and their index by external merge.

*Writing.* One record a page. Of pages with equal payloads of at least ``min_bytes`` the one with the largest id is
the response; the others are revisits that name it and carry no payload. Spark's own text writer makes the files (a
record a line, the blank lines between records as line separator, gzip), so a lost executor's work is redone and
committed like any other, in any store Spark can write.

*Reading.* Each archive is unpacked as a stream, one record at a time, and checked against its digests. Its captures,
sorted by URL key, timestamp and id, are a run. The runs are written, dealt by ranges of that order, and each
range's pieces of runs go through a k-way loser-tree merge: the ranges one after another are the ordered capture
histories. A range also splits the captures of one URL or host, as the timestamp and id belong to the order.

A null page is an empty payload; a null URL has no target line; a null id is written as such, never refers and is never
referred to while its payload has another id. Rows with the same id and payload are all responses if their id is the
largest. Only page_id, url and html are read. No pages give no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe.llm.store import parts, written
from thermalframe.session import work_path

RECORDS_PER_FILE = 5_000
SMALL_PAYLOADS = 100_000            # repeated payloads up to which their list is broadcast
EPOCH = 1_577_836_800               # pages have no time: a page's is this second plus its id
CRLF = "\r\n"


# --- writing ---------------------------------------------------------------

def with_owner(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, digest, size and owner: the id that a revisit refers to, else null."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    owners = (rows.where(F.col("size") >= min_bytes).groupBy("digest", "size")
              .agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    owners = written(owners, "payloads")
    if owners.count() <= SMALL_PAYLOADS:
        owners = F.broadcast(owners)
    joined = rows.join(owners, ["digest", "size"], "left")
    return joined.withColumn("owner", F.expr("case when page_id is null or page_id < owner then owner end"))


def record(page_id: Column, url: Column, html: Column, digest: Column, size: Column, owner: Column) -> Column:
    """A whole record but for the blank lines after it."""
    revisit = owner.isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    size.cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(html))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    moment = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod(page_id, F.lit(1 << 32)), F.lit(0)))
    target = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(page_id)), line("WARC-Date", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(owner)), line(
            "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Archives of all pages as gzip files in the new folder ``path``."""
    rows = with_owner(pages, min_bytes)
    (rows.select(record(*(F.col(c) for c in ("page_id", "url", "html", "digest", "size", "owner"))).alias("value"))
     .write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


# --- reading ---------------------------------------------------------------

def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record of an unpacked archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a record: {line[:40]!r}")
        offset, header = stream.tell() - len(line), {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            header[name.lower()] = value.strip()
        size = int(header["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record at {offset} ends early")
        yield offset, header, block


def url_key(url: str | None) -> str:
    """Host from its last label on, then path and query: keeps a host's pages together."""
    if not url:
        return ""
    try:
        parts_ = urlsplit(url)
        host, port = parts_.hostname or "", parts_.port
    except ValueError:
        return url.lower()
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return (",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (parts_.path or "/")
            + (f"?{parts_.query}" if parts_.query else "")).lower()


def _id(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def hex_digest(value: str) -> str:
    """Bare hex of a ``sha1:`` value in hex or base 32."""
    text = value.partition(":")[2]
    return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()


CAPTURES = ("url_key string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, "
            "payload_digest string, file string, offset long")
_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]
_TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
Capture = tuple


def order_of(c: Capture) -> tuple:
    """URL key, timestamp, id (null first), place."""
    return c[0], c[1], c[2] is not None, c[2] or 0, c[7], c[8]


def capture(file: str, offset: int, header: dict[str, str], block: bytes) -> Capture:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.partition(": ")[::2] for x in head.decode().split(CRLF)[1:])
    size, digest = int(fields["Content-Length"]), hex_digest(header["warc-payload-digest"])
    kind = header["warc-type"]
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of the record at {file}:{offset} does not have its digest")
    stamp = "".join(x for x in header["warc-date"] if x.isdigit())
    refers = _id(header["warc-refers-to"]) if "warc-refers-to" in header else None
    return url_key(header.get("warc-target-uri")), stamp, _id(header["warc-record-id"]), kind, refers, size, digest, file, offset


def _batch(rows: list[Capture]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of each archive."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            file = path.as_py().rsplit("/", 1)[-1]
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as packed:
                rows = [capture(file, *r) for r in records(io.BufferedReader(packed, 1 << 20))]
            yield _batch(sorted(rows, key=order_of))


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, so one path is replayed for each item."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key = runs, key
        self.heads: list = [None] * len(runs)
        self.ranks: list[tuple] = [()] * len(runs)
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [0] * max(1, len(runs))
        self.winner = self._play(1) if runs else -1

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.ranks[i] = (1,) if self.heads[i] is None else (0, self.key(self.heads[i]), i)

    def _play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.ranks[b] < self.ranks[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self._advance(w)
            node = (w + len(self.runs)) // 2
            while node:
                if self.ranks[self.losers[node]] < self.ranks[w]:
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's captures in order. What comes of one archive in order is a run; a step back begins another."""
    runs: list[list[Capture]] = []
    open_: dict[str, list[Capture]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            run = open_.get(row[7])
            if run is None or order_of(row) < order_of(run[-1]):
                run = open_[row[7]] = []
                runs.append(run)
            run.append(row)
    out: list[Capture] = []
    for row in LoserTree([iter(r) for r in runs], order_of):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def read_archives(spark, path: str) -> DataFrame:
    """Captures of all archives in ``path``, ordered by URL key, timestamp and id through all partitions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = written(files.mapInArrow(_scan, CAPTURES), "runs")
    return runs.repartitionByRange(parts(spark), "url_key", "timestamp", "page_id", "file", "offset").mapInArrow(_merge, CAPTURES)


def archived(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Captures of ``pages``, written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)
