"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from thermalframe.session import work_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, safe from lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, when all that was read from them has been written itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


MAX_BITS = 1 << 29               # of a bit table: 64 MB


def bit_table(names: DataFrame) -> bytes:
    """A bit for the leading bits of each 64-bit name in the first column, 32 bits a name.

    At most ``MAX_BITS`` however many names there are, so bounded on the driver and in a broadcast. A name that was put
    in is always found; another one seldom, and whoever asks must bear that.
    """
    size = 1 << 16
    wanted = 32 * names.count()
    while size < min(wanted, MAX_BITS):
        size *= 2
    shift = np.uint64(65 - size.bit_length())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(batch.column(0).to_numpy().view(np.uint64) >> shift)
            chunk = (place >> np.uint64(16)).astype(np.int64)
            for c, a, b in zip(*_runs(chunk)):
                bits = np.zeros(1 << 16, np.uint8)
                bits[(place[a:b] & np.uint64(0xFFFF)).astype(np.int64)] = 1
                yield pa.record_batch([pa.array([c]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(data, np.uint8)
                tables[c] = tables[c] | new if c in tables else new
        for c, table in tables.items():
            yield pa.record_batch([pa.array([c]), pa.array([table.tobytes()], pa.binary())], ["chunk", "bits"])

    rows = names.coalesce(4).mapInArrow(mark, "chunk long, bits binary").mapInArrow(join, "chunk long, bits binary")
    table = np.zeros(size // 8, np.uint8)
    for r in rows.collect():                           # from each of the few tasks a table at most
        table[r["chunk"] << 13:(r["chunk"] + 1) << 13] |= np.frombuffer(r["bits"], np.uint8)
    return table.tobytes()


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """Values, begins and ends of the runs of equal values in sorted ``x``."""
    begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][:len(x)])
    return x[begin].tolist(), begin.tolist(), np.r_[begin[1:], len(x)].astype(np.int64).tolist()[:len(begin)]


def on_used_bits(names: np.ndarray, table: bytes) -> np.ndarray:
    """Whether each name (unsigned) falls on a bit of a bit table."""
    bits = np.frombuffer(table, np.uint8)
    place = names >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
