"""Byte-level text kernels for Arrow batches: bounded slices, words, shingles.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; all of these are ASCII, so the cut never falls inside a UTF-8 sequence. Words are named by
64-bit hashes.
"""

from __future__ import annotations

import builtins
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WHITE = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20            # text held as numpy arrays at once; a longer text is taken whole
BASE = 0x9E3779B97F4A7C15        # odd, so it has an inverse modulo 2**64
NULL_ID = (1 << 63) - 1          # a null id counts as the largest id

_space = np.zeros(256, bool)
_space[list(WHITE)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def kept() -> dict:
    """What a Python worker keeps from task to task. Functions travel by value, so a module's own names live for one task."""
    return builtins.__dict__.setdefault("_thermalframe_kept", {})


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[limits[0]:limits[-1]], limits - limits[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES,
           keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of text, or of one row.

    What other operators have left in the worker, but for the power tables and ``keep``, is let go first.
    """
    for name in set(kept()) - {"powers", keep}:
        del kept()[name]
    for batch in batches:
        _, ends = flat(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop
        del batch, ends
    give_back()


def give_back() -> None:
    """Memory that a task has freed goes back to the system, not to the worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # glibc has it
    if trim:
        trim(0)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as int64, nulls as ``NULL_ID``."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    tables = kept().setdefault("powers", {})
    if base not in tables or len(tables[base]) < n:
        table = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        if n > 4 * SLICE_BYTES:
            return table            # not kept: one very long text
        tables[base] = table
    return tables[base][:n]


@dataclass
class Words:
    """Words of consecutive texts; those of text ``i`` are ``first[i]:first[i + 1]``."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, fold: bool = True, between: bytes = WHITE) -> Words:
    """Words of every text; ``fold`` lower-cases A to Z, ``between`` holds the ASCII bytes that are in no word."""
    data, limits = flat(column)
    if fold:
        data = _lower[data]
    n = len(data)
    gap = _space
    if between != WHITE:
        gap = np.zeros(256, bool)
        gap[list(between)] = True
    inside = ~gap[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = limits[:-1] < limits[1:]
    edge = limits[:-1][full]
    begins[edge] = inside[edge]
    edge = limits[1:][full] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, n), out=total[1:])
    value = (total[end] - total[start]) * _power_table(pow(BASE, -1, 1 << 64), n)[start]
    return Words(data, start, end, np.searchsorted(start, limits), mix(value ^ (end - start).astype(np.uint64)))


def shingle_hashes(w: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (those that cross a text's end are meaningless)."""
    n = len(w.hash)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(min(size, n)):
        factor = factor * BASE % (1 << 64)
        total[:n - j] += w.hash[j:] * np.uint64(factor)
    return mix(total)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, a text without words has none."""
    w = words(column)
    every = shingle_hashes(w, size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(every[a:b - size + 1])
        elif b > a:
            short, factor = 0, 1
            for h in w.hash[a:b].tolist():
                factor = factor * BASE % (1 << 64)
                short = (short + h * factor) % (1 << 64)
            yield mix(np.array([short ^ (b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def deal(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash; grows with the hash, so sorted hashes lie part by part."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def binary(pieces: Iterable[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def squeezed(x: np.ndarray) -> bytes:
    """Compressed numbers: their first bytes, their second bytes and so on, as the high bytes of small numbers are alike."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, kind: type, n: int) -> np.ndarray:
    """The ``n`` numbers of type ``kind`` that ``squeezed`` has made ``data`` of."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)
