"""Regularised boosted regression trees on histograms, all targets and folds together.

Columns are cut into bins once, at quantiles. A tree grows level by level: sums of gradients and counts (the squared error's
second derivative is 1) by (node, column, bin) give every split's gain with L1 and L2 penalties,
``T(g) = sign(g) max(|g| - l1, 0)``, ``gain = (T(gl)^2 / (hl + l2) + T(gr)^2 / (hr + l2) - T(g)^2 / (h + l2)) / 2``, and leaves weigh
``-rate T(g) / (h + l2)``. Each tree draws rows (by a hash of the row) and columns. With watched rows, boosting ends after ``patience``
trees without a lower watched loss and keeps the trees up to the lowest.

A model is a (fold, target). Where the rows of a model are at most ``TASK_ROWS``, one task holds its bins (a byte a value, column by column)
and grows all its trees, the models side by side; only the smaller child of a split is summed, the other is its parent less that.
Trees of more than ``EXACT_ROWS`` drawn rows sum gradients in steps of a 2**19th of the largest, together with the counts: one sum a
column instead of two, exact, and piece by piece within the processor's caches.
Beyond, rows stay where they are and one job makes a level of all models: tasks sum their own rows, sums meet by
model and group of columns, and the driver sees one candidate per node and group. Predictions are written every
``KEEP`` trees; a task adds the trees since, so that no state is lost with an executor. Both ways grow the same trees, up to rounding.

Rows without one of the features are left out; a row without a target is left out of that target's models. A model without any
row predicts 0. Scoring is a vectorised function of the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe.session import cut_lineage

TASK_ROWS = 6_000_000
EXACT_ROWS = 1 << 17            # drawn rows of a tree up to which gradients are summed as they are
PIECE = 1 << 16                 # rows whose packed sums are exact
PAIR_SLOTS = 4                  # nodes up to which packed sums are made for two columns at once
WALK = 1 << 13                  # rows that walk together
STEPS, ONE = 1 << 19, 2.0 ** 36         # a packed row: the gradient in steps, and its count
KEEP = 10
CHUNK_COLUMNS = 8               # columns whose sums meet in one task
TRAIN, WATCH = 1, 2


@dataclass
class Boosting:
    """What is fitted; ``least_gain`` and ``min_rows`` bound splits, ``patience`` needs watched rows."""
    trees: int = 300
    depth: int = 8
    rate: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    min_rows: int = 3
    l1: float = 0.1
    l2: float = 1.0
    least_gain: float = 0.1
    bins: int = 64
    validation: str | None = None
    patience: int = 50
    seed: int = 42


@dataclass
class BoostedTrees:
    """A fitted model. Node i of a tree has the children 2i + 1 and 2i + 2; ``split`` is a column or -1 for a leaf."""
    target: str
    features: list[str]
    edges: list[list[float]]
    base: float
    split: np.ndarray           # trees x nodes
    cut: np.ndarray             # a value in a bin up to this one goes left
    leaf: np.ndarray
    gain: np.ndarray
    losses: list[float] = field(default_factory=list)

    @property
    def n_trees(self) -> int:
        return len(self.split)

    def predict(self, values: np.ndarray) -> np.ndarray:
        return self.base + add_trees(to_bins(values, self.edges), self.split, self.cut, self.leaf)

    def column(self) -> Column:
        model = self

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for frame in batches:
                yield pd.Series(model.predict(frame.to_numpy(float)))

        return run(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(f"{self.target}_pred", self.column())

    def importance(self) -> np.ndarray:
        """Share of the total gain by column."""
        total = np.bincount(self.split[self.split >= 0], self.gain[self.split >= 0], len(self.features))
        return total / total.sum() if total.sum() else total


def to_bins(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    return np.column_stack([np.searchsorted(np.asarray(e, float), values[:, f], "left").astype(np.uint8) for f, e in enumerate(edges)]) \
        if len(edges) else np.zeros((len(values), 0), np.uint8)


def _moves(split: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """By node: the column asked, the last bin that goes left, and the left child; a leaf leads to itself."""
    leaf = split < 0
    return (np.where(leaf, 0, split).astype(np.int64), np.where(leaf, 255, cut).astype(np.uint8),
            np.where(leaf, np.arange(len(split)), 2 * np.arange(len(split)) + 1))


def walk_columns(columns: np.ndarray, split: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node at which each row stops in one tree; bins by column."""
    n = columns.shape[1]
    at = np.zeros(n, np.int64)
    asked = np.flatnonzero(split >= 0)
    if len(asked):
        flat, row = columns.ravel(), np.arange(n)
        column, bound, left = _moves(split, cut)
        column = column * n
        for _ in range(int(asked[-1] + 1).bit_length()):
            right = flat.take(column.take(at) + row) > bound.take(at)
            at = left.take(at)
            at += right
    return at


def walk(bins: np.ndarray, split: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node at which each row stops in one tree."""
    return walk_columns(np.ascontiguousarray(bins.T), split, cut)


def add_trees(bins: np.ndarray, split: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bins))
    for a in range(0, len(bins), WALK):
        columns = np.ascontiguousarray(bins[a:a + WALK].T)
        for s, c, w in zip(split, cut, leaf):
            total[a:a + WALK] += w.take(walk_columns(columns, s, c))
    return total


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_splits(sums: np.ndarray, counts: np.ndarray, p: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, column, bin) of each node from its sums (node, column, bin); gain 0 where nothing may be split."""
    gl, hl = np.cumsum(sums, axis=2), np.cumsum(counts, axis=2)
    g, h = gl[:, :, -1:], hl[:, :, -1:]
    gr, hr = g - gl, h - hl
    score = lambda a, b: _soft(a, p.l1) ** 2 / np.maximum(b + p.l2, 1e-12)
    gain = (score(gl, hl) + score(gr, hr) - score(g, h)) / 2 - p.least_gain
    gain = np.where((hl >= p.min_rows) & (hr >= p.min_rows), gain, 0)
    gain[:, :, -1] = 0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(gain), np.int64)
    value = np.maximum(flat[np.arange(len(gain)), best], 0) if flat.shape[1] else np.zeros(len(gain))
    return value, best // sums.shape[2], best % sums.shape[2]


def histogram(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, slots: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``g`` and counts by (slot, column, bin)."""
    n, f = bins.shape
    sums, counts = np.zeros((slots, f, width)), np.zeros((slots, f, width))
    start = slot * width
    for j in range(f):
        place = start + bins[:, j]
        sums[:, j] = np.bincount(place, g, slots * width).reshape(slots, width)
        counts[:, j] = np.bincount(place, minlength=slots * width).reshape(slots, width)
    return sums, counts


def packed(g: np.ndarray, used: np.ndarray) -> float:
    """Puts gradient, in steps of what is returned, and count of each used row into one number of ``g``."""
    top = float(np.abs(g).max(where=used, initial=0.0))
    step = 2.0 ** (np.ceil(np.log2(top)) - np.log2(STEPS)) if top else 1.0
    for a in range(0, len(g), PIECE):
        own = g[a:a + PIECE]
        np.rint(own / step, out=own)
        np.clip(own, 1 - STEPS, STEPS - 1, out=own)
        own += ONE
    return step


def unpacked(total: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of packed numbers of at most ``PIECE`` rows: whole numbers below 2**53, so nothing is rounded."""
    counts = np.floor((total + ONE / 2) / ONE)
    return (total - counts * ONE) * step, counts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_rows(row: np.ndarray, tree: int, p: Boosting) -> np.ndarray:
    out = np.empty(len(row), bool)
    for a in range(0, len(row), PIECE):
        h = _mix(row[a:a + PIECE].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (tree + 1 + 1000 * p.seed) % (1 << 64)))
        out[a:a + PIECE] = (h >> np.uint64(11)).astype(float) < p.subsample * 2.0 ** 53
    return out


def drawn_columns(n: int, tree: int, p: Boosting) -> np.ndarray:
    return np.sort(np.random.default_rng((p.seed, tree)).permutation(n)[:max(1, round(p.columns * n))])


def _empty(p: Boosting) -> tuple[np.ndarray, ...]:
    size = (1 << p.depth + 1) - 1
    return np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size), np.zeros(size)


def _weigh(g: float | np.ndarray, h: float | np.ndarray, p: Boosting):
    return -p.rate * _soft(np.asarray(g, float), p.l1) / (h + p.l2)


def grow(bins: np.ndarray, g: np.ndarray, columns: np.ndarray, p: Boosting) -> tuple[np.ndarray, ...]:
    """(split, cut, leaf, gain) of one tree over rows in memory."""
    bins = np.ascontiguousarray(bins)
    return grow_columns(bins, np.ascontiguousarray(bins.T), g.astype(float), np.ones(len(g), bool), columns, p)[0]


def _pairs(by_column: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
    """Bins of two columns as one number, for columns two by two."""
    out = np.empty((len(columns) // 2, by_column.shape[1]), np.uint16)
    for a in range(0, by_column.shape[1], PIECE):
        for j, pair in enumerate(out[:, a:a + PIECE]):
            np.multiply(by_column[columns[2 * j], a:a + PIECE], width, out=pair, dtype=np.uint16)
            pair += by_column[columns[2 * j + 1], a:a + PIECE]
    return out


def grow_columns(bins: np.ndarray, by_column: np.ndarray, g: np.ndarray, used: np.ndarray, columns: np.ndarray,
                 p: Boosting) -> tuple[tuple, np.ndarray]:
    """(split, cut, leaf, gain) of one tree grown on the used rows, and the node of every row; ``g`` may be overwritten."""
    split, cut, leaf, gains = _empty(p)
    n, many, width = len(g), int(used.sum()), p.bins
    leaf[0] = _weigh(g[used].sum(), many, p)
    step = packed(g, used) if many > EXACT_ROWS else 0.0
    piece = PIECE if step else max(n, 1)
    pairs = _pairs(by_column, columns, width) if step and width <= 64 else None
    flat, offset = bins.ravel(), np.arange(min(n, piece)) * bins.shape[1]
    at = np.zeros(n, np.int64)

    def advance(moves: tuple | None, slot_of: np.ndarray | None, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows go on to their children; sums and counts of the used rows whose node has a slot."""
        sums, counts = np.zeros((slots, len(columns), width)), np.zeros((slots, len(columns), width))
        two = pairs if pairs is not None and slots <= PAIR_SLOTS else by_column[:0]
        one = columns[2 * len(two):]
        held, most = [0.0] * (len(two) + len(one)), 0

        def flush() -> None:
            for j, total in enumerate(held[:len(two)]):
                total = np.reshape(total, (slots, width, width))
                for i in (0, 1):
                    s, h = unpacked(total.sum(axis=2 - i), step)
                    sums[:, 2 * j + i] += s
                    counts[:, 2 * j + i] += h
            for j, total in enumerate(held[len(two):], 2 * len(two)):
                s, h = unpacked(np.reshape(total, (slots, width)), step)
                sums[:, j] += s
                counts[:, j] += h

        for a in range(0, n, piece):
            here = at[a:a + piece]
            if moves is not None:
                column, bound, left = moves
                place = column.take(here)
                place += offset[:len(here)]
                right = flat[a * bins.shape[1]:].take(place) > bound.take(here)
                here[:] = left.take(here)
                here += right
            if slot_of is None:
                continue
            slot = slot_of.take(here)
            rows = np.flatnonzero((slot >= 0) & used[a:a + piece])
            slot, own = slot.take(rows), g[a:a + piece].take(rows)
            start = slot * width
            if not step:
                for j, c in enumerate(columns):
                    place = start + by_column[c, a:a + piece].take(rows)
                    sums[:, j] = np.bincount(place, own, slots * width).reshape(slots, width)
                    counts[:, j] = np.bincount(place, minlength=slots * width).reshape(slots, width)
                continue
            if most + len(rows) > PIECE:
                flush()
                held, most = [0.0] * len(held), 0
            most += len(rows)
            if len(two):
                begin = start * width
                for j, pair in enumerate(two):
                    held[j] += np.bincount(begin + pair[a:a + piece].take(rows), own, slots * width * width)
            for j, c in enumerate(one, len(two)):
                held[j] += np.bincount(start + by_column[c, a:a + piece].take(rows), own, slots * width)
        if most:
            flush()
        return sums, counts

    ids = np.zeros(1, np.int64)                        # the level's nodes
    slot_of = np.full(len(split), -1)
    slot_of[0] = 0
    sums, counts = advance(None, slot_of, 1)
    for level in range(p.depth):
        value, f, b = best_splits(sums, counts, p)
        good = np.flatnonzero(value > 0)
        if not len(good):
            break
        split[ids[good]], cut[ids[good]], gains[ids[good]] = columns[f[good]], b[good], value[good]
        each = np.arange(len(good))
        hl = np.cumsum(counts[good, f[good]], axis=1)[each, b[good]]
        gl = np.cumsum(sums[good, f[good]], axis=1)[each, b[good]]
        h, s = counts[good, f[good]].sum(axis=1), sums[good, f[good]].sum(axis=1)
        leaf[2 * ids[good] + 1], leaf[2 * ids[good] + 2] = _weigh(gl, hl, p), _weigh(s - gl, h - hl, p)
        moves = _moves(split, cut)
        if level == p.depth - 1:
            advance(moves, None, 0)
            break
        small_right = h - hl < hl
        slot_of = np.full(len(split), -1)
        slot_of[2 * ids[good] + 1 + small_right] = each
        a, c = advance(moves, slot_of, len(good))
        other_a, other_c = sums[good] - a, counts[good] - c
        pick = small_right[:, None, None]
        sums = np.stack([np.where(pick, other_a, a), np.where(pick, a, other_a)], axis=1).reshape(2 * len(good), *a.shape[1:])
        counts = np.stack([np.where(pick, other_c, c), np.where(pick, c, other_c)], axis=1).reshape(2 * len(good), *c.shape[1:])
        ids = np.stack([2 * ids[good] + 1, 2 * ids[good] + 2], axis=1).ravel()
    return (split, cut, leaf, gains), at


def boost(bins: np.ndarray, y: np.ndarray, role: np.ndarray, row: np.ndarray, p: Boosting) -> tuple[float, list, list[float]]:
    """(base, trees, watched losses) of one model whose rows are in memory, in the order of their hashes."""
    train, watch = role == TRAIN, np.flatnonzero(role == WATCH)
    base = float(y[train].mean()) if train.any() else 0.0
    trees, losses = [], []
    if not train.any():
        return base, trees, losses
    pred, by_column = np.full(len(y), base), np.ascontiguousarray(bins.T)
    for t in range(p.trees):
        tree, at = grow_columns(bins, by_column, pred - y, train & drawn_rows(row, t, p), drawn_columns(len(by_column), t, p), p)
        trees.append(tree)
        for a in range(0, len(y), PIECE):
            pred[a:a + PIECE] += tree[2].take(at[a:a + PIECE])
        if len(watch):
            losses.append(float(((pred[watch] - y[watch]) ** 2).mean()))
            if t - int(np.argmin(losses)) >= p.patience:
                break
    if losses:
        trees = trees[:int(np.argmin(losses)) + 1]
    return base, trees, losses


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Distinct quantiles of each feature, at most ``bins`` - 1, of a bounded rank error of a tenth of a bin."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.approxQuantile(list(features), shares, 0.1 / bins)
    return [sorted(set(e)) for e in found]


_BLOCK = "n long, bins binary, y binary, role binary, row binary"


def _blocks(rows: DataFrame, features: list[str], targets: list[str], folds: int, edges: list) -> DataFrame:
    """Binned rows of an Arrow batch as one line: bins, targets, roles of each fold, row hashes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numpy = lambda c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False))
            x = np.column_stack([numpy(f"x{i}").astype(float) for i in range(len(features))])
            y = np.column_stack([numpy(f"y{i}").astype(float) for i in range(len(targets))])
            role = np.column_stack([numpy(f"r{i}") for i in range(folds)]).astype(np.uint8)
            cells = (to_bins(x, edges), y, role, numpy("row").astype(np.int64))
            yield pa.record_batch([pa.array([batch.num_rows]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                                  ["n", "bins", "y", "role", "row"])
    return rows.mapInArrow(pack, _BLOCK)


def _unpack(batch: pa.RecordBatch, i: int, f: int, t: int, k: int) -> tuple[np.ndarray, ...]:
    n = batch.column("n")[i].as_py()
    cell = lambda c, kind, shape: np.frombuffer(batch.column(c)[i].as_py(), kind).reshape(shape)
    return (cell("bins", np.uint8, (n, f)), cell("y", float, (n, t)), cell("role", np.uint8, (n, k)), cell("row", np.int64, (n,)))


def fit_boosted(rows: DataFrame, features: Sequence[str], targets: Sequence[str], p: Boosting,
                roles: Sequence[Column] | None = None) -> list[dict[str, BoostedTrees]]:
    """One bundle per fold. ``roles`` holds a column per fold: 1 trains, 2 is watched, anything else takes no part."""
    features, targets = list(features), list(targets)
    if roles is None:
        roles = [F.lit(TRAIN) if p.validation is None else F.when(F.col(p.validation), F.lit(WATCH)).otherwise(F.lit(TRAIN))]
    f, t, k = len(features), len(targets), len(roles)
    named = rows.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(targets)],
        *[F.coalesce(r.cast("int"), F.lit(0)).alias(f"r{i}") for i, r in enumerate(roles)],
        F.xxhash64(*features, *targets).alias("row")).where(" or ".join(f"r{i} in (1, 2)" for i in range(k)))
    named = cut_lineage(named).dropna("any", subset=[f"x{i}" for i in range(f)])     # a filter before would make computed features twice
    trained = named.where(" or ".join(f"r{i} = 1" for i in range(k)))
    edges = bin_edges(trained, [f"x{i}" for i in range(f)], p.bins)
    blocks = cut_lineage(_blocks(named, features, targets, k, edges))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    fitted = (_in_tasks if total <= TASK_ROWS else _by_levels)(blocks, f, t, k, p)
    out: list[dict[str, BoostedTrees]] = []
    for fold in range(k):
        bundle = {}
        for i, target in enumerate(targets):
            base, trees, losses = fitted[fold * t + i]
            parts = [np.array([tree[j] for tree in trees]) if trees else np.zeros((0, 1)) for j in range(4)]
            bundle[target] = BoostedTrees(target, features, edges, base, parts[0].astype(np.int16), parts[1].astype(np.int16), parts[2], parts[3], losses)
        out.append(bundle)
    return out


def _joined(cells: list) -> tuple[np.ndarray, ...]:
    """(bins, y, role, hash) of one model's blocks, in the order of the hashes; the blocks are let go."""
    y, role, row = (np.concatenate([c[i] for c in cells]).reshape(-1) for i in (1, 2, 3))
    bins = np.concatenate([c[0] for c in cells])
    cells.clear()
    order = np.argsort(row, kind="stable")
    return bins.take(order, axis=0), y[order], role[order], row[order]


_TREES = "model int, base double, trees int, split binary, cut binary, leaf binary, gain binary, losses array<double>"


def _in_tasks(blocks: DataFrame, f: int, t: int, k: int, p: Boosting) -> dict[int, tuple]:
    """Every model in a task of its own; the rows of a model are at most ``TASK_ROWS``."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bins, y, role, row = _unpack(batch, i, f, t, k)
                for m in range(k * t):
                    own = (role[:, m // t] > 0) & ~np.isnan(y[:, m % t])
                    cells = (bins[own], y[own, m % t], role[own, m // t], row[own])
                    yield pa.record_batch([pa.array([m], pa.int32()), pa.array([int(own.sum())]),
                                           *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)],
                                          ["model", "n", "bins", "y", "role", "row"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, m in enumerate(batch.column("model").to_pylist()):
                held.setdefault(m, []).append(_unpack(batch, i, f, 1, 1))
        for m in list(held):
            base, trees, losses = boost(*_joined(held.pop(m)), p)
            packed = [b"".join(tree[j].tobytes() for tree in trees) for j in range(4)]
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([base]), pa.array([len(trees)], pa.int32()),
                                   *(pa.array([x], pa.binary()) for x in packed), pa.array([losses], pa.list_(pa.float64()))],
                                  ["model", "base", "trees", "split", "cut", "leaf", "gain", "losses"])

    dealt = blocks.mapInArrow(deal, "model int, " + _BLOCK)
    out = {m: (0.0, [], []) for m in range(k * t)}
    for r in dealt.repartitionById(k * t, F.lit(k * t - 1) - F.col("model")).mapInArrow(fit, _TREES).collect():   # late folds have most rows
        kinds = zip(("split", "cut", "leaf", "gain"), (np.int16, np.int16, float, float))
        arrays = [np.frombuffer(r[c], kind).reshape(r["trees"], -1) for c, kind in kinds] if r["trees"] else [[]] * 4
        out[r["model"]] = r["base"], list(zip(*arrays)), list(r["losses"])
    return out


def _by_levels(blocks: DataFrame, f: int, t: int, k: int, p: Boosting) -> dict[int, tuple]:
    """One job a level, for all models that are still growing."""
    spark = blocks.sparkSession
    models = range(k * t)
    means = blocks.mapInArrow(_moments(f, t, k), "model int, role int, n long, total double").groupBy("model", "role").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    base = {m: next((r["total"] / r["n"] for r in means if r["model"] == m and r["role"] == TRAIN and r["n"]), 0.0) for m in models}
    watched = {r["model"] for r in means if r["role"] == WATCH and r["n"]}
    growing = {r["model"] for r in means if r["role"] == TRAIN and r["n"]}
    trees: dict[int, list] = {m: [] for m in models}
    losses: dict[int, list[float]] = {m: [] for m in models}
    kept, at = blocks.withColumn("pred", F.lit(None).cast("binary")), 0
    for tree in range(p.trees + 1):
        current = {m: _empty(p) for m in growing}
        level_nodes = {m: np.zeros(1, np.int64) for m in growing}
        columns = drawn_columns(f, tree, p)
        for level in range(p.depth):
            asked = {m: ids for m, ids in level_nodes.items() if len(ids)}
            if not asked:
                break
            since = {m: trees[m][at:] for m in asked}
            sums = kept.mapInArrow(_sum_level(f, t, k, p, base, since, current, asked, tree, columns, level == 0), _SUMS)
            found = sums.repartition("model", "chunk").mapInArrow(_best_of(p, columns), _FOUND).collect()
            best: dict[tuple[int, int], tuple] = {}
            for r in found:
                if r["chunk"] < 0:
                    losses[r["model"]] += [r["gain"] / r["h"]] if tree else []
                    continue
                key = r["model"], r["node"]
                if key not in best or (r["gain"], -r["split"]) > (best[key][0], -best[key][1]):
                    best[key] = r["gain"], r["split"], r["cut"], r["g"], r["h"], r["gl"], r["hl"]
            for m in list(asked):
                if level == 0 and tree and m in watched and (
                        tree == p.trees or tree - 1 - int(np.argmin(losses[m])) >= p.patience):
                    growing.discard(m)
                    asked.pop(m)
                    level_nodes[m] = np.zeros(0, np.int64)
            if tree == p.trees:
                break
            for m, ids in asked.items():
                split, cut, leaf, gain = current[m]
                more = []
                for node in ids.tolist():
                    value, s, c, g, h, gl, hl = best[m, node]
                    if not level:
                        leaf[0] = _weigh(g, h, p)
                    if value > 0:
                        split[node], cut[node], gain[node] = s, c, value
                        leaf[2 * node + 1], leaf[2 * node + 2] = _weigh(gl, hl, p), _weigh(g - gl, h - hl, p)
                        more += [2 * node + 1, 2 * node + 2]
                level_nodes[m] = np.array(more, np.int64)
        if tree == p.trees:
            break
        for m in growing:
            trees[m].append(current[m])
        if not growing:
            break
        if (tree + 1) % KEEP == 0:
            kept, at = cut_lineage(kept.mapInArrow(_predict(f, t, k, base, {m: trees[m][at:] for m in models}), _BLOCK + ", pred binary")), tree + 1
    for m in watched:
        if losses[m]:
            trees[m] = trees[m][:int(np.argmin(losses[m])) + 1]
    return {m: (base[m], trees[m], losses[m]) for m in models}


def _moments(f: int, t: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, y, role, _ = _unpack(batch, i, f, t, k)
                lines = [(m, r, int(own.sum()), float(y[own, m % t].sum())) for m in range(k * t) for r in (TRAIN, WATCH)
                         if (own := (role[:, m // t] == r) & ~np.isnan(y[:, m % t])).any()]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64())
                yield pa.record_batch([pa.array([x[j] for x in lines], kind) for j, kind in enumerate(kinds)], ["model", "role", "n", "total"])
    return work


def _predictions(batch: pa.RecordBatch, i: int, bins: np.ndarray, base: dict, since: dict, models: int) -> np.ndarray:
    """Predictions of the kept trees and those since, rows x models."""
    n = len(bins)
    old = batch.column("pred")[i].as_py()
    pred = np.tile([base[m] for m in range(models)], (n, 1)) if old is None else np.frombuffer(old, float).reshape(n, models).copy()
    by_column = np.ascontiguousarray(bins.T)
    for m, trees in since.items():
        for split, cut, leaf, _ in trees:
            pred[:, m] += leaf[walk_columns(by_column, split, cut)]
    return pred


def _predict(f: int, t: int, k: int, base: dict, since: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bins = _unpack(batch, i, f, t, k)[0]
                pred = _predictions(batch, i, bins, base, since, k * t)
                yield pa.record_batch([*batch.slice(i, 1).columns[:5], pa.array([pred.tobytes()], pa.binary())],
                                      ["n", "bins", "y", "role", "row", "pred"])
    return work


_SUMS = "model int, chunk int, nodes binary, g binary, h binary"
_FOUND = "model int, chunk int, node long, gain double, split int, cut int, g double, h double, gl double, hl double"


def _sum_level(f: int, t: int, k: int, p: Boosting, base: dict, since: dict, current: dict, asked: dict, tree: int,
               columns: np.ndarray, first: bool):
    """A task's sums by (node, column, bin) of the asked nodes, in groups of columns; with the first level the watched loss."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        loss: dict[int, list[float]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                bins, y, role, row = _unpack(batch, i, f, t, k)
                pred = _predictions(batch, i, bins, base, since, k * t)
                drawn = drawn_rows(row, tree, p)
                for m, ids in asked.items():
                    known = ~np.isnan(y[:, m % t])
                    watch = known & (role[:, m // t] == WATCH)
                    if first and watch.any():
                        one = loss.setdefault(m, [0.0, 0.0])
                        one[0] += float(((pred[watch, m] - y[watch, m % t]) ** 2).sum())
                        one[1] += int(watch.sum())
                    used = np.flatnonzero(known & (role[:, m // t] == TRAIN) & drawn)
                    node = walk(bins[used], current[m][0], current[m][1])
                    slot = np.full(len(current[m][0]), -1)
                    slot[ids] = np.arange(len(ids))
                    slot = slot[node]
                    used, slot = used[slot >= 0], slot[slot >= 0]
                    both = histogram(bins[used][:, columns].astype(np.int64), slot, pred[used, m] - y[used, m % t], len(ids), p.bins)
                    if m not in total:
                        total[m] = list(both)
                    else:
                        total[m][0] += both[0]
                        total[m][1] += both[1]
        for m, (g, h) in total.items():
            for chunk in range(-(-len(columns) // CHUNK_COLUMNS)):
                own = slice(chunk * CHUNK_COLUMNS, (chunk + 1) * CHUNK_COLUMNS)
                yield pa.record_batch([pa.array([m], pa.int32()), pa.array([chunk], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                    asked[m], np.ascontiguousarray(g[:, own]), np.ascontiguousarray(h[:, own])))], ["model", "chunk", "nodes", "g", "h"])
        for m, (s, n) in loss.items():
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([-1], pa.int32()), *(pa.array([np.array([x], float).tobytes()], pa.binary())
                                                                                          for x in (0, s, n))], ["model", "chunk", "nodes", "g", "h"])
    return work


def _best_of(p: Boosting, columns: np.ndarray):
    """Sums of all tasks added up, and each node's best split in a group of columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for m, chunk, nodes, g, h in zip(*(c.to_pylist() for c in batch.columns)):
                g, h = np.frombuffer(g, float), np.frombuffer(h, float)
                if (m, chunk) in total:
                    total[m, chunk][1] += g
                    total[m, chunk][2] += h
                else:
                    total[m, chunk] = [nodes, g.copy(), h.copy()]
        lines = []
        for (m, chunk), (nodes, g, h) in total.items():
            if chunk < 0:
                lines.append((m, -1, 0, float(g[0]), 0, 0, 0.0, float(h[0]), 0.0, 0.0))
                continue
            ids = np.frombuffer(nodes, np.int64)
            own = columns[chunk * CHUNK_COLUMNS:(chunk + 1) * CHUNK_COLUMNS]
            g, h = g.reshape(len(ids), len(own), p.bins), h.reshape(len(ids), len(own), p.bins)
            value, s, b = best_splits(g, h, p)
            for j, node in enumerate(ids.tolist()):
                one_g, one_h = g[j, s[j]], h[j, s[j]]
                lines.append((m, chunk, node, float(value[j]), int(own[s[j]]), int(b[j]), float(one_g.sum()), float(one_h.sum()),
                              float(one_g[:b[j] + 1].sum()), float(one_h[:b[j] + 1].sum())))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4)
        yield pa.record_batch([pa.array([x[i] for x in lines], kind) for i, kind in enumerate(kinds)],
                              ["model", "chunk", "node", "gain", "split", "cut", "g", "h", "gl", "hl"])
    return work
