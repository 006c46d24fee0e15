"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A to Z lower-cased. A key of at least ``min_chars``
code points loses its lines in every document but the one with the smallest id.

Each slice of documents first settles its own repetitions, so that a line held by a third of all documents goes
out once for each slice. The remaining (key hash, document) lines are dealt by hash; a task reads its share in
order of document id. Every batch is merge-anti-joined with the sorted runs of the batches before it, and its new
keys become a run of the lowest level; ``FAN`` runs of a level are compacted into one of the next. A task thus
holds 24 bytes for each distinct key of its share. The verdicts join the documents by id.

Null and empty texts are one empty line and stay so (null comes out empty). A null id counts as the largest id; rows
with one id are one document. Repeated lines inside the keeping document stay. All columns are kept, in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermalframe.llm import text as X
from thermalframe.llm.store import parts, written

FAN = 4
SLICE = 8 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(X.WHITE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


class Runs:
    """Sorted runs of (key, owner), by level."""

    def __init__(self) -> None:
        self.levels: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def owners(self, keys: np.ndarray) -> np.ndarray:
        """Owner of each key of a sorted batch, -1 where no run has it."""
        owner, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for run, holder in (r for level in self.levels for r in level):
            at = np.searchsorted(run, keys)
            at[at == len(run)] = 0
            hit = run[at] == keys
            owner[hit], known[hit] = holder[at[hit]], True
        return np.ma.array(owner, mask=~known)

    def add(self, keys: np.ndarray, owner: np.ndarray, level: int = 0) -> None:
        if not len(keys):
            return
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((keys, owner))
        if len(self.levels[level]) == FAN:
            keys, owner = (np.concatenate([r[i] for r in self.levels[level]]) for i in (0, 1))
            self.levels[level] = []
            order = np.argsort(keys, kind="stable")      # a merge: timsort finds the runs
            self.add(keys[order], owner[order], level + 1)


def _keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, limit=SLICE):
            holders: dict[bytes, set[int]] = {}
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc, text in zip(X.ids_of(batch.column("doc_id")).tolist(), texts):
                for line in (text or b"").split(b"\n"):
                    if (key := line_key(line, min_chars)) is not None:
                        holders.setdefault(key, set()).add(doc)
            rows = [(key, doc, int(i > 0)) for key, docs in holders.items() for i, doc in enumerate(sorted(docs))]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.binary(), pa.int64(), pa.int32()))], ["key", "doc_id", "lost"])
    return keys


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines come in order of document id; those whose key an earlier document has go out."""
    runs = Runs()
    for batch in batches:
        key = np.frombuffer(X.flat(batch.column("key"))[0].tobytes(), "S16")
        doc = batch.column("doc_id").to_numpy()
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        found = runs.owners(key[new])
        owner = np.where(found.mask, doc[new], found.data)
        runs.add(key[new][found.mask], doc[new][found.mask])
        lost = owner[group] != doc
        yield pa.record_batch([pa.array(key[lost].view("V16").tolist(), pa.binary()), pa.array(doc[lost])], ["key", "doc_id"])


def _apply(min_chars: int, columns: list[str]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, limit=SLICE):
            texts, lines, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("__keys").to_pylist()):
                text = text or ""
                every = text.count("\n") + 1
                kept = every
                if keys:
                    gone = set(keys)
                    stay = [x for x in text.split("\n") if line_key(x.encode(), min_chars) not in gone]
                    text, kept = "\n".join(stay), len(stay)
                texts.append(text)
                lines.append(every)
                dropped.append(every - kept)
            out = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.record_batch([*out, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                  [*columns, "__n_lines", "__n_dropped"])
    return apply


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, plus ``__n_lines`` (before) and ``__n_dropped``."""
    n_parts = parts(docs.sparkSession)
    keys = written(docs.select("doc_id", "text").mapInArrow(_keys(min_chars), "key binary, doc_id long, lost int"), "lines")
    late = (keys.where("lost = 0").select("key", "doc_id").repartition(n_parts, "key").sortWithinPartitions("doc_id")
            .mapInArrow(_lost, "key binary, doc_id long"))
    gone = (late.union(keys.where("lost = 1").select("key", "doc_id")).groupBy("doc_id")
            .agg(F.collect_set("key").alias("__keys")).withColumnRenamed("doc_id", "__id"))
    joined = docs.withColumn("__id", F.coalesce("doc_id", F.lit(X.NULL_ID))).join(gone, "__id", "left").drop("__id")
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    return joined.mapInArrow(_apply(min_chars, docs.columns), schema)
