"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds test items of which at least ``percent`` of the distinct word shingles occur in a document. A short item in a
long document has a tiny Jaccard similarity, so items are partitioned by length class (powers of two), and for each
class a document is cut into overlapping windows of twice the class's largest item: an occurrence lies whole in a
window, of which it is at least about a fifth. MinHash signatures of windows and items meet in single slots; with
``SLOTS`` slots such an occurrence is missed with a probability below 1e-4, and one that is spread over the
document is found by its parts. Items with fewer distinct shingles than a quarter of their window (all of less than four,
and repetitive ones) would be a smaller part of it: they are looked up by the shingles themselves, of which a document
must hold one of any ``n - needed + 1``, and are never missed. Every candidate is verified by exact containment in
the whole document.

The items are the query set. They go to the tasks in blocks of about ``BLOCK_BYTES`` of text, one scan of the documents
for each block, so that what is broadcast stays bounded. The documents are not shuffled.

An item of fewer than ``size`` words is one shingle of all its words. Null and empty texts have no words: such an item
is in no document, such a document holds nothing. Repeated rows give repeated results; null ids come out null. Only
(doc_id, text) and (item_id, text) are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalframe.llm import text as X

SLOTS = 48
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20

_factor = X.mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)


def _slot(h: np.ndarray, i: int) -> np.ndarray:
    return (h + np.uint64(i)) * _factor[i]


class Items:
    """Signatures and shingle sets of one block of items, by (shingle size, length class)."""

    def __init__(self, rows: list[tuple[int | None, str | None]], size: int, percent: int) -> None:
        self.ids = [r[0] for r in rows]
        self.sets: list[np.ndarray] = []
        values: dict[int, dict[int, list]] = {}
        few: dict[int, list[tuple[int, int]]] = {}
        w = X.words(pa.array([r[1] for r in rows], pa.string()))
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            if a == b:
                self.sets.append(np.zeros(0, np.uint64))
                continue
            k = min(size, b - a)
            part = X.Words(w.data, w.start[a:b], w.end[a:b], w.first, w.hash[a:b])
            h = X.shingle_hashes(part, k)[:b - a - k + 1]
            own, level = np.unique(h), max(3, len(h).bit_length())
            self.sets.append(own)
            if len(own) < 1 << level - 1:
                needed = max(1, -(-percent * len(own) // 100))
                few.setdefault(k, []).extend((v, i) for v in own[:max(0, len(own) - needed + 1)].tolist())
                continue
            slots = [int(_slot(h, s).min()) for s in range(SLOTS)]
            values.setdefault(k, {}).setdefault(level, []).append((i, slots))
        self.tables: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, classes in values.items():
            for level, entries in sorted(classes.items()):
                value = np.array([s for _, slots in entries for s in slots], np.uint64)
                item = np.repeat([i for i, _ in entries], SLOTS)
                order = np.argsort(value, kind="stable")
                seen = np.zeros(1 << FILTER_BITS, bool)
                seen[value >> np.uint64(64 - FILTER_BITS)] = True
                self.tables.setdefault(k, []).append((level, value[order], item[order], seen))
        self.exact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, entries in few.items():
            value, item = np.array([v for v, _ in entries], np.uint64), np.array([i for _, i in entries], np.int64)
            order = np.argsort(value, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[value >> np.uint64(64 - FILTER_BITS)] = True
            self.exact[k] = value[order], item[order], seen
        self.shingles = sorted({*self.tables, *self.exact})

    def holders(self, h: np.ndarray, first: np.ndarray, k: int) -> set[tuple[int, int]]:
        """(text, item) pairs of texts that hold a looked-up shingle of an item."""
        found: set[tuple[int, int]] = set()
        if k not in self.exact:
            return found
        value, item, seen = self.exact[k]
        maybe = np.flatnonzero(seen[h >> np.uint64(64 - FILTER_BITS)])
        left, right = (np.searchsorted(value, h[maybe], side) for side in ("left", "right"))
        hit = np.flatnonzero(right > left)
        text = np.searchsorted(first, maybe[hit], "right") - 1
        for t, a, b in set(zip(text.tolist(), left[hit].tolist(), right[hit].tolist())):
            found.update((t, i) for i in item[a:b].tolist())
        return found

    def candidates(self, h: np.ndarray, first: np.ndarray, k: int) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window and the item agree in a slot; text ``i`` has ``h[first[i]:first[i + 1]]``."""
        found: set[tuple[int, int]] = set()
        tables = self.tables.get(k)
        if not tables:
            return found
        unit = tables[0][0]
        count = -(-np.diff(first) >> unit)                       # windows' steps of each text
        doc = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[doc] + (step << unit)
        if not len(begin):
            return found
        for s in range(SLOTS):
            low, at, local = np.minimum.reduceat(_slot(h, s), begin), doc, step
            reached = unit
            for level, value, item, seen in tables:
                while reached < level:                           # two steps make one of the next class
                    head = np.flatnonzero(local % 2 == 0)
                    low, at, local = np.minimum.reduceat(low, head), at[head], local[head] >> 1
                    reached += 1
                window = low.copy()
                same = at[1:] == at[:-1]
                window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                maybe = np.flatnonzero(seen[window >> np.uint64(64 - FILTER_BITS)])
                if len(maybe):
                    left, right = (np.searchsorted(value, window[maybe], side) for side in ("left", "right"))
                    for j in np.flatnonzero(right > left):
                        found.update((int(at[maybe[j]]), int(i)) for i in item[left[j]:right[j]])
        return found


def _block(docs: DataFrame, rows: list, size: int, percent: int) -> DataFrame:
    items = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Items(rows, size, percent)))    # by value, as tasks are

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(items.value)
        for batch in X.slices(batches):
            w = X.words(batch.column("text"))
            out = []
            for k in known.shingles:
                every = X.shingle_hashes(w, k)
                count = np.maximum(w.counts - k + 1, 0)
                valid = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                h, first = every[valid], np.concatenate([[0], np.cumsum(count)])
                last, shingles = None, None
                for doc, item in sorted(known.candidates(h, first, k) | known.holders(h, first, k)):
                    if doc != last:
                        last, shingles = doc, np.unique(h[first[doc]:first[doc + 1]])
                    total = len(known.sets[item])
                    shared = len(np.intersect1d(known.sets[item], shingles, assume_unique=True))
                    if 100 * shared >= percent * total:
                        out.append((doc, known.ids[item], total, shared))
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([r[0] for r in out], pa.int64()))
            rest = [pa.array([r[i] for r in out], pa.int64()) for i in (1, 2, 3)]
            yield pa.record_batch([ids, *rest], ["doc_id", "item_id", "n_item", "n_shared"])

    return docs.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, n_item long, n_shared long")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document and item with enough shingles in common."""
    items = items.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        one = _block(docs, rows, size, percent)
        found = one if found is None else found.union(one)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))
