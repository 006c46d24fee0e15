"""A message log in files, with a batch and a stream reader.

A log is a folder of numbered segments, ``segment=0000000007``. A segment is written once, by one Spark write, and counts
from the moment its ``_SUCCESS`` mark is there; a writer that repeats a segment replaces it. A line is one message: a JSON
object of the columns that were published. The reader gives raw lines (segment, file, position, line as bytes); ``messages``
reads them as Spark columns and names what is wrong with the others, so no byte is lost.

The offset of a stream is the number of complete segments, whatever the number of files and messages. Tasks read byte ranges
of the files, a chunk at a time, and a line belongs to the range that its first byte is in. The public data source interface
asks for the newest offset alone, so a micro-batch is all that is there; a task still holds one chunk, or one line, of it.
An empty line is no message.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "message_log"
SCHEMA = "segment long, file string, position long, line binary"
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
DONE = "_SUCCESS"


def segment_path(path: str, segment: int) -> str:
    return f"{path.rstrip('/')}/segment={segment:010d}"


def publish(messages: DataFrame, path: str, segment: int) -> None:
    """Write all columns of ``messages`` as one segment; as a stream's sink its number is that of the micro-batch."""
    line = F.to_json(F.struct(*messages.columns))
    messages.select(line.alias("value")).write.mode("overwrite").text(segment_path(path, segment))


def publish_to(path: str):
    """Sink of a stream that publishes each micro-batch as a segment."""
    return lambda rows, batch_id: publish(rows, path, batch_id)


class Range(InputPartition):
    """The lines of a file that begin in ``start`` to ``stop``."""

    def __init__(self, segment: int, file: str, start: int, stop: int) -> None:
        self.segment, self.file, self.start, self.stop = segment, file, start, stop


class Log:
    """Segments and files of the log that the options name, on any file system that Arrow can open."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def _open(self) -> tuple[fs.FileSystem, str]:
        local = self.path.startswith("file:")           # with one slash or three
        return fs.FileSystem.from_uri("/" + self.path.removeprefix("file:").lstrip("/") if local else self.path)

    def complete(self) -> int:
        """Number of segments from 0 on that are complete; one that is not hides those behind it."""
        files, root = self._open()
        have = {f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))}
        n = 0
        while segment_path("", n)[1:] in have and files.get_file_info(f"{segment_path(root, n)}/{DONE}").type == fs.FileType.File:
            n += 1
        return n

    def ranges(self, start: int, stop: int) -> list[Range]:
        files, root = self._open()
        out = []
        for segment in range(start, stop):
            for f in sorted(files.get_file_info(fs.FileSelector(segment_path(root, segment))), key=lambda f: f.base_name):
                if f.type == fs.FileType.File and f.base_name[0] not in "._":
                    out += [Range(segment, f.base_name, a, min(a + self.range_bytes, f.size)) for a in range(0, f.size, self.range_bytes)]
        return out

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, root = self._open()
        with files.open_input_file(f"{segment_path(root, part.segment)}/{part.file}") as source:
            at = max(0, part.start - 1)             # a line that begins at the start follows the byte before it
            source.seek(at)
            rest, skip = b"", part.start > 0
            while at < part.stop:
                chunk = source.read(CHUNK_BYTES)
                whole = rest + chunk
                pieces = whole.split(b"\n")
                rest = pieces.pop() if chunk else b""
                places, lines = [], []
                for piece in pieces:
                    if at < part.stop and piece and not skip:
                        places.append(at)
                        lines.append(piece)
                    skip = False
                    at += len(piece) + 1
                if lines:
                    n = len(lines)
                    yield pa.record_batch([pa.array([part.segment] * n, pa.int64()), pa.array([part.file] * n),
                                           pa.array(places, pa.int64()), pa.array(lines, pa.binary())],
                                          ["segment", "file", "position", "line"])
                if not chunk:
                    break


class BatchReader(DataSourceReader):
    def __init__(self, log: Log) -> None:
        self.log = log

    def partitions(self) -> list[Range]:
        return self.log.ranges(0, self.log.complete())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.log.lines(partition) if partition else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, log: Log) -> None:
        self.log = log

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        return {"segments": self.log.complete()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.log.ranges(start["segments"], end["segments"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.log.lines(partition)


class MessageLog(DataSource):
    """Format ``message_log``; options ``path`` and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> BatchReader:
        return BatchReader(Log(self.options))

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(Log(self.options))


def read_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, stream: bool = False) -> DataFrame:
    """(segment, file, position, line) of all complete segments, or of those to come as well."""
    spark.dataSource.register(MessageLog)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("rangeBytes", range_bytes).option("path", path).load()


def messages(lines: DataFrame, schema: str) -> DataFrame:
    """The published columns of each line, then ``line`` and ``reason``, which is null for a good message.

    A line is dead if its bytes are no UTF-8 or no JSON object, or if its ``payload`` is no JSON; it keeps what could be read.
    """
    text = F.when(F.is_valid_utf8(F.col("line").cast("string")), F.col("line").cast("string"))
    whole = text.isNotNull() & F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False)) & F.trim(text).startswith("{")
    names = T.StructType.fromDDL(schema).names
    body = F.when(whole, F.from_json(text, schema))
    read = lines.select(body.alias("__body"), text.alias("__text"), whole.alias("__whole"), "segment", "file", "position", "line")
    read = read.select(*[F.col("__body")[n].alias(n) for n in names], "segment", "file", "position", "line", "__text", "__whole")
    reason = F.when(F.col("__text").isNull(), "invalid UTF-8").when(~F.col("__whole"), "invalid envelope")
    if "payload" in names:
        reason = reason.when(~F.coalesce(F.try_parse_json("payload").isNotNull(), F.lit(False)), "invalid JSON")
    return read.withColumn("reason", reason).drop("__text", "__whole")
