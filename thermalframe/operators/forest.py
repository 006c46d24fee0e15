"""Forests of regression trees on histograms, with MLlib's rules, for tables whose bins fit in a task.

The tasks share the trees out: each holds the binned rows (a byte a value) and grows its trees of all targets, so only bins move,
once a task, and whole trees come back. A tree draws its rows with replacement (Poisson counts), every node a third of the columns
(all for a single tree); a split must leave ``min_rows`` drawn rows on both sides and lower the sum of squares. Rows are kept in the
order of their nodes, so a level is summed node block by node block within the processor's caches.

Draws depend on seed, tree and the order of the rows' hashes, not on how the rows are dealt out. Tables of more rows than
``TASK_ROWS`` are left to MLlib (``models``), whose trees and draws are others of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe.operators.boosting import _BLOCK, _blocks, _unpack, bin_edges, to_bins
from thermalframe.session import cut_lineage

TASK_ROWS = 4_000_000
NODES = 512                     # nodes whose sums are held at a time
PIECE = 1 << 15                 # rows that are summed at a time
WALK = 1 << 13                  # rows that walk together


@dataclass
class Forest:
    """What is fitted."""
    trees: int = 100
    depth: int = 15
    min_rows: int = 2
    bins: int = 32
    seed: int = 42


@dataclass
class ForestTrees:
    """A fitted forest. Nodes of a tree stand level by level: the k-th that is split has the nodes 2k + 1 and 2k + 2 as children."""
    target: str
    features: list[str]
    edges: list[list[float]]
    split: list[np.ndarray]     # by tree: a column, or -1 for a leaf
    cut: list[np.ndarray]       # a value in a bin up to this one goes left
    leaf: list[np.ndarray]      # values of the leaves in the order of the nodes
    gains: np.ndarray           # trees x columns: what the splits by a column took off the sum of squares

    def predict(self, values: np.ndarray) -> np.ndarray:
        return mean_of_trees(to_bins(values, self.edges), [_moves(*tree) for tree in zip(self.split, self.cut, self.leaf)])

    def column(self) -> Column:
        model = ForestTrees(self.target, self.features, self.edges, self.split, self.cut, self.leaf, self.gains[:0])

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            moves = [_moves(*tree) for tree in zip(model.split, model.cut, model.leaf)]
            for frame in batches:
                yield pd.Series(mean_of_trees(to_bins(frame.to_numpy(float), model.edges), moves))

        return run(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(f"{self.target}_pred", self.column())

    def importance(self) -> np.ndarray:
        """Mean over the trees of the columns' shares of the gain."""
        total = self.gains.sum(axis=1, keepdims=True)
        shares = np.divide(self.gains, total, out=np.zeros_like(self.gains), where=total > 0).sum(axis=0)
        return shares / shares.sum() if shares.sum() else shares


def _moves(split: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
    """By node: the column asked, the last bin that goes left, the left child, the value; a leaf leads to itself. And the levels."""
    inner = split >= 0
    child = np.where(inner, 2 * np.cumsum(inner) - 1, np.arange(len(split))).astype(np.int32)
    value = np.zeros(len(split))
    value[~inner] = leaf
    levels, first, end = 0, 0, 1                       # nodes first..end are a level
    while inner[first:end].any():
        first, end = end, end + 2 * int(inner[first:end].sum())
        levels += 1
    return np.where(inner, split, 0).astype(np.int16), np.where(inner, cut, 255).astype(np.uint8), child, value, levels


def mean_of_trees(bins: np.ndarray, moves: list[tuple]) -> np.ndarray:
    total = np.zeros(len(bins))
    for a in range(0, len(bins), WALK):
        flat = np.ascontiguousarray(bins[a:a + WALK]).ravel()
        row = np.arange(len(bins[a:a + WALK])) * bins.shape[1]
        own = total[a:a + WALK]
        for column, bound, child, value, levels in moves:
            at = np.zeros(len(row), np.int64)
            for _ in range(levels):
                right = flat.take(column.take(at) + row) > bound.take(at)
                at = child.take(at) + right
            own += value.take(at)
    return total / max(len(moves), 1)


def best_splits(sums: np.ndarray, counts: np.ndarray, min_rows: int) -> tuple[np.ndarray, ...]:
    """(gain, place of the column, bin) of each node from its sums (column, node, bin); gain 0 where nothing may be split."""
    sl, nl = np.cumsum(sums, axis=2), np.cumsum(counts, axis=2)
    s, n = sl[:, :, -1:], nl[:, :, -1:]
    sr, nr = s - sl, n - nl
    may = (nl >= min_rows) & (nr >= min_rows)
    np.maximum(nl, 1, out=nl)
    np.maximum(nr, 1, out=nr)
    whole = s * s / np.maximum(n, 1)
    gain = sl * sl / nl + sr * sr / nr - whole
    gain = np.where(may & (gain > 1e-13 * whole), gain, 0).transpose(1, 0, 2).reshape(sums.shape[1], -1)
    best = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), best], best // sums.shape[2], best % sums.shape[2]


def _sums(bins: np.ndarray, row: np.ndarray, w: np.ndarray, wy: np.ndarray, starts: np.ndarray, columns: np.ndarray,
          width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts by (drawn column, node, bin) of nodes whose rows stand together."""
    k, nodes = columns.shape[1], len(columns)
    sums, counts = np.zeros((k, nodes * width)), np.zeros((k, nodes * width))
    node = np.repeat(np.arange(nodes), np.diff(starts))
    for a in range(0, len(node), PIECE):
        own, at = node[a:a + PIECE], slice(starts[0] + a, min(starts[0] + a + PIECE, starts[-1]))
        flat, offset, start = bins.take(row[at], axis=0).ravel(), np.arange(len(own)) * bins.shape[1], own * width
        for j in range(k):
            place = columns[:, j].take(own)
            place += offset
            place = flat.take(place) + start
            sums[j] += np.bincount(place, wy[at], nodes * width)
            counts[j] += np.bincount(place, w[at], nodes * width)
    return sums.reshape(k, nodes, width), counts.reshape(k, nodes, width)


def grow(bins: np.ndarray, y: np.ndarray, drawn: np.ndarray, p: Forest, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(split, cut, leaf, gains by column) of one tree over rows in memory; ``drawn`` says how often each row was drawn."""
    f = bins.shape[1]
    k = f if p.trees == 1 else max(1, -(-f // 3))
    flat = np.ascontiguousarray(bins).ravel()
    row = np.flatnonzero(drawn)
    w = drawn[row].astype(float)
    wy = w * y[row]
    starts = np.array([0, len(row)])                   # the rows of the level's nodes
    splits, cuts, leaves, gains = [], [], [], np.zeros(f)
    for level in range(p.depth + 1):
        nodes = len(starts) - 1
        n, s = np.add.reduceat(w, starts[:-1]), np.add.reduceat(wy, starts[:-1])
        split, cut = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8)
        splits.append(split)
        cuts.append(cut)
        asked = np.flatnonzero(n >= 2 * p.min_rows) if level < p.depth and f else np.zeros(0, np.int64)
        if len(asked) < nodes:                         # rows of the other nodes are done
            kept = np.zeros(nodes, bool)
            kept[asked] = True
            kept = np.flatnonzero(np.repeat(kept, np.diff(starts)))
            row, w, wy = row.take(kept), w.take(kept), wy.take(kept)
            starts = np.concatenate([[0], np.cumsum(np.diff(starts)[asked])])
        value, column, bound = np.zeros(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for a in range(0, len(asked), NODES):
            b = min(a + NODES, len(asked))
            drawn_columns = np.argpartition(rng.random((b - a, f)), k - 1, axis=1)[:, :k] if k < f else np.tile(np.arange(f), (b - a, 1))
            value[a:b], place, bound[a:b] = best_splits(*_sums(bins, row, w, wy, starts[a:b + 1], drawn_columns, p.bins), p.min_rows)
            column[a:b] = drawn_columns[np.arange(b - a), place]
        good = np.flatnonzero(value > 0)
        split[asked[good]], cut[asked[good]] = column[good], bound[good]
        leaves.append((s / n)[split < 0])
        np.add.at(gains, column[good], value[good])
        if not len(good):
            break
        child = np.full(len(asked), -1)
        child[good] = 2 * np.arange(len(good))
        node = np.repeat(np.arange(len(asked)), np.diff(starts))
        kept = np.flatnonzero(child.take(node) >= 0)
        row, w, wy, node = row.take(kept), w.take(kept), wy.take(kept), node.take(kept)
        new = child.take(node) + (flat.take(row * f + column.take(node)) > bound.take(node))
        order = np.argsort(new.astype(np.uint16) if len(good) < 1 << 15 else new, kind="stable")
        row, w, wy = row.take(order), w.take(order), wy.take(order)
        starts = np.concatenate([[0], np.cumsum(np.bincount(new, minlength=2 * len(good)))])
    return np.concatenate(splits), np.concatenate(cuts), np.concatenate(leaves), gains


_TREES = "target int, tree int, split binary, cut binary, leaf binary, gains binary"


def fit_forests(rows: DataFrame, features: Sequence[str], targets: Sequence[str], p: Forest) -> dict[str, ForestTrees] | None:
    """A forest per target on the rows with all features and that target; None if the rows are too many for a task."""
    features, targets = list(features), list(targets)
    f, t = len(features), len(targets)
    named = cut_lineage(rows.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(targets)],
        F.lit(1).alias("r0"), F.xxhash64(*features, *targets).alias("row"))).dropna("any", subset=[f"x{i}" for i in range(f)])
    if named.count() > TASK_ROWS:
        return None
    edges = bin_edges(named, [f"x{i}" for i in range(f)], p.bins)
    blocks = cut_lineage(_blocks(named, features, targets, 1, edges))
    parts = max(1, min(p.trees, rows.sparkSession.sparkContext.defaultParallelism))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(parts):
                yield pa.record_batch([pa.array(np.full(batch.num_rows, part, np.int32)), *batch.columns], ["part", *batch.schema.names])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, part = [], None
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            cells += [_unpack(batch, i, f, t, 1) for i in range(batch.num_rows)]
        if not cells:
            return
        bins, y, row = (np.concatenate([c[i] for c in cells]) for i in (0, 1, 3))
        cells.clear()
        order = np.argsort(row, kind="stable")
        bins, y = bins.take(order, axis=0), y.take(order, axis=0)
        for i in range(t):
            known = ~np.isnan(y[:, i])
            own, goal = (bins, y[:, i]) if known.all() else (bins[known], y[known, i])
            if not len(goal):
                continue
            mean = float(goal.mean())
            for tree in range(part, p.trees, parts):
                rng = np.random.default_rng((p.seed, tree))
                drawn = rng.poisson(1.0, len(goal)).astype(np.uint8)
                if not drawn.any():
                    drawn[0] = 1
                split, cut, leaf, gains = grow(own, goal - mean, drawn, p, rng)
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([tree], pa.int32()), *(
                    pa.array([x.tobytes()], pa.binary()) for x in (split, cut, leaf + mean, gains))], ["target", "tree", "split", "cut", "leaf", "gains"])

    found: dict[int, list] = {i: [] for i in range(t)}
    dealt = blocks.mapInArrow(deal, "part int, " + _BLOCK).repartitionById(parts, F.col("part"))
    for r in dealt.mapInArrow(fit, _TREES).collect():
        found[r["target"]].append((r["tree"], *(np.frombuffer(r[c], kind) for c, kind in (
            ("split", np.int16), ("cut", np.uint8), ("leaf", float), ("gains", float)))))
    out = {}
    for i, target in enumerate(targets):
        trees = [x[1:] for x in sorted(found[i], key=lambda x: x[0])]
        if not trees:
            raise ValueError(f"no row has all features and {target}")
        out[target] = ForestTrees(target, features, edges, *(list(x) for x in list(zip(*trees))[:3]), np.array([x[3] for x in trees]))
    return out
