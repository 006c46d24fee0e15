"""Periodic runs of words: maximal pairs of the LCP-interval tree whose distance fits their length.

A run is a stretch of consecutive words with smallest period q and at least ``max(min_words, min_repeats * q)`` words that no
neighbouring word extends keeping period q. Its first words and the same words q later are a *maximal pair*: two places
that agree for l words (run length less q), differ in the word to the left and in the word to the right. So runs are
exactly the maximal pairs of distance q with l >= max(min_words - q, (min_repeats - 1) * q); nothing is extended.

In a task, the words of a slice of documents are ranked by prefix doubling; equal ranks of the doubling's levels give the
lengths that neighbours of the suffix order have in common. The intervals of that order are then closed from the deepest up.
An interval keeps its places in text order, grouped by the word to the left: where all places of two joined intervals
share one left word there is no pair to look for; else each place of the smaller one meets the nearest places of the larger one.
The nearest place is enough: a nearer one would be a smaller period. Places enter larger lists only, so a place
moves a logarithmic number of times. A document without a stretch of repeated word groups near enough to each other holds no run
and is not ranked at all.

Words are runs of other bytes than space, tab, line feed, vertical tab, form feed and carriage return, told apart by 64-bit
hashes, case kept. Null and empty texts have no words and no run. Every row is worked on by itself, so repeated ids and rows stay;
columns other than ``doc_id`` and ``text`` are not read. ``words_of`` may put other words in place of a document's own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thermalframe.llm import text as X

MIN_WORDS, MIN_REPEATS = 6, 4
CHUNK = 4096                    # places of one sorted list before it is cut in two

RunList = list[tuple[int, int, int]]


class Places:
    """Sorted places of an interval, and the left word they share (None: they differ).

    Kept in lists of bounded length, so that a place enters a set of any size in a bounded move.
    """

    __slots__ = ("lists", "size", "left")

    def __init__(self, place: int, left: int):
        self.lists, self.size, self.left = [[place]], 1, left

    def _list(self, place: int) -> int:
        lists = self.lists
        if len(lists) == 1 or place <= lists[0][-1]:
            return 0
        lo, hi = 0, len(lists) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if lists[mid][-1] < place:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def around(self, place: int) -> tuple[int | None, int | None]:
        """The nearest place before and after."""
        at = self._list(place)
        own = self.lists[at]
        k = bisect_left(own, place)
        before = own[k - 1] if k else self.lists[at - 1][-1] if at else None
        return before, own[k] if k < len(own) else None

    def take(self, other: Places) -> None:
        """All places of a smaller set."""
        for more in other.lists:
            for place in more:
                at = self._list(place)
                own = self.lists[at]
                own.insert(bisect_left(own, place), place)
                if len(own) > CHUNK:
                    self.lists[at:at + 1] = [own[:CHUNK // 2], own[CHUNK // 2:]]
        self.size += other.size
        if self.left != other.left:
            self.left = None


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def neighbours(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the documents' words, and the number of words each suffix shares with the one before it.

    Suffixes end with their document; those of different documents share nothing.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc]
    rank = _dense(X.mix(words) ^ X.mix(doc.astype(np.uint64) + np.uint64(1)))
    # a rank is the place of its group's first suffix in the order
    size = np.bincount(rank)
    rank = (np.cumsum(size) - size)[rank]
    order = np.argsort(rank, kind="stable")
    levels, step = [rank], 1
    while True:
        old = rank[order]
        group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        width = np.diff(np.r_[group, n])
        open_ = np.repeat(width > 1, width)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        rows = order[at]
        after = rows + step
        second = np.where(after < end[rows], rank[np.minimum(after, n - 1)] + 1, 0)
        key = old[at] * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        rows, key = rows[sort], key[sort]
        order[at] = rows                               # groups keep their places
        new = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[rows] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        levels.append(rank)
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks, width = levels[level], 1 << level
        same = (a < end[order[:-1]]) & (b < end[order[1:]])
        same &= ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]
        common += same * width
        a += same * width
        b += same * width
    return order, np.r_[0, common][:n]


def maximal_pairs(words: np.ndarray, first: np.ndarray, min_words: int, min_repeats: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, common words) of the pairs that are runs; the intervals of the suffix order from the deepest up."""
    order, common = neighbours(words, first)
    least = min(max(min_words - q, (min_repeats - 1) * q) for q in range(1, min_words + 1))
    left = np.r_[-1, _dense(words)[:-1]] if len(words) else np.zeros(0, np.int64)
    left[first[:-1][first[:-1] < len(words)]] = -1     # nothing is to the left of a document's first word
    deep = common >= least
    wanted = deep.copy()
    wanted[:-1] |= deep[1:]
    order, common = order[wanted].tolist(), np.where(deep, common, 0)[wanted].tolist()
    left = left.tolist()
    open_: list[tuple[int, Places]] = []               # words shared with the next set, set

    def join(x: Places, y: Places, shared: int) -> Iterator[tuple[int, int, int]]:
        small, large = (x, y) if x.size <= y.size else (y, x)
        if small.left is None or large.left is None or small.left != large.left:
            for places in small.lists:
                for place in places:
                    for other in large.around(place):
                        if other is not None and left[other] != left[place]:
                            q = abs(other - place)
                            if shared >= max(min_words - q, (min_repeats - 1) * q):
                                yield min(place, other), q, shared

    for i, place in enumerate(order):
        if not common[i]:
            open_ = []
        current = Places(place, left[place])
        after = common[i + 1] if i + 1 < len(order) else 0
        while open_ and open_[-1][0] >= after:
            shared, before = open_.pop()
            yield from join(before, current, shared)
            if before.size < current.size:
                before, current = current, before
            before.take(current)
            current = before
        if after:
            open_.append((after, current))


def may_repeat(words: np.ndarray, first: np.ndarray, min_words: int, min_repeats: int) -> np.ndarray:
    """Whether a document may hold a run: no document with one is left out.

    The first words of a run repeat within it. With g the shortest pair of a run, all groups of g words from its start on
    recur later in the document, one group after another, and the nearest recurrence is no farther than a third (for four
    repeats) of the stretch.
    """
    g = min(max(min_words - q, (min_repeats - 1) * q) for q in range(1, min_words + 1))
    n, docs = len(words), len(first) - 1
    if n <= g:
        return np.zeros(docs, bool)
    doc = np.repeat(np.arange(docs), np.diff(first))
    groups = np.zeros(n - g + 1, np.uint64)
    factor = 1
    for j in range(g):
        factor = factor * X.BASE % (1 << 64)
        groups += words[j:n - g + 1 + j] * np.uint64(factor)
    inside = doc[:n - g + 1] == doc[g - 1:]
    groups = X.mix(groups ^ X.mix(doc[:n - g + 1].astype(np.uint64)))
    rows = np.flatnonzero(inside)
    rows = rows[np.argsort(groups[rows], kind="stable")]
    again = groups[rows[1:]] == groups[rows[:-1]]
    far = np.full(n + 1, n, np.int64)
    far[rows[:-1][again]] = (rows[1:] - rows[:-1])[again]
    hit = far < n
    edge = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (np.r_[doc, -1][1:] != np.r_[doc, -1][:-1])])
    if not len(edge):
        return np.zeros(docs, bool)
    length = np.add.reduceat(hit.astype(np.int64), edge)
    nearest = np.minimum.reduceat(far, edge)
    out = np.zeros(docs, bool)
    out[doc[edge[(length + g - 1) >= (min_repeats - 1) * nearest]]] = True
    return out


def runs_of(words: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> dict[int, RunList]:
    """Runs (start, length, period) by document, ordered by start and period; documents without a run are left out."""
    chosen = np.flatnonzero(may_repeat(words, first, min_words, min_repeats))
    if not len(chosen):
        return {}
    sizes = np.diff(first)[chosen]
    own = np.r_[0, np.cumsum(sizes)]
    rows = np.repeat(first[:-1][chosen] - own[:-1], sizes) + np.arange(own[-1])
    found: dict[tuple[int, int], int] = {}
    for start, q, shared in maximal_pairs(words[rows], own, min_words, min_repeats):
        key = start, shared + q
        found[key] = min(q, found.get(key, q))
    out: dict[int, RunList] = {}
    for (start, length), q in sorted(found.items()):
        d = int(np.searchsorted(own, start, "right")) - 1
        out.setdefault(int(chosen[d]), []).append((start - int(own[d]), length, q))
    return {d: sorted(runs, key=lambda r: (r[0], r[2])) for d, runs in out.items()}


def kept_words(n: int, runs: RunList) -> np.ndarray:
    """Numbers of the words that stay when every run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.flatnonzero(np.cumsum(edges)[:n] == 0)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The numbers of the words that a document of ``n`` words is made of, by the checksum of its id; None: its own."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % p
    return at


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, words_of: Callable[[int | None, int], np.ndarray | None] | None = None,
              min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, and its words, joined by one space,
    without those that a run contains after its first period."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            w = X.words(batch.column("text"), fold=False)
            hashes, moved = w.hash, {}
            if words_of:
                hashes = hashes.copy()
                for d, (i, n) in enumerate(zip(ids, w.counts.tolist())):
                    at = words_of(i, n)
                    if at is not None:
                        moved[d] = at
                        hashes[w.first[d]:w.first[d + 1]] = w.hash[w.first[d] + at]
            found = runs_of(hashes, w.first, min_words, min_repeats)
            collapsed = []
            for d, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                own = (text or b"").split()
                at = moved.get(d)
                if d in found:
                    stay = kept_words(len(own), found[d])
                    own = [own[i] for i in (stay if at is None else at[stay]).tolist()]
                elif at is not None:
                    own = [own[i] for i in at.tolist()]
                collapsed.append(b" ".join(own))
            runs = [[dict(zip(("start", "length", "period"), r)) for r in found.get(d, ())] for d in range(batch.num_rows)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(runs, pa.list_(_RUN)),
                                   pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
    return docs.select("doc_id", "text").mapInArrow(work, RUNS)
