"""N-gram Jaccard join by token-group matrix.

Links two documents when ``100 * |A and B| >= percent * |A or B|`` over their distinct word shingles, exactly,
and labels every document with the smallest id that it reaches.

1. *Tokens.* From ``CELLS_FROM`` percent on, a set of n shingles is cut by hash into so many cells that two linked sets
   of about that size must have an equal cell: their symmetric difference has at most d shingles, and there are d + 1
   cells. A token names one cell with its content. Size classes make the number of cells agree: a set is cut for its
   own class and, if a set of the next larger one can be linked with it, for that too. A class is ``STEPS`` times as wide
   as links reach, so that few sets are cut twice. A passage that many documents share does not fill a cell, so it makes no
   hot token. At lower thresholds cells would be small and often empty; there the tokens are the first shingles of
   the set in one order for all: two linked sets have ``needed`` of them in common, a twentieth of the set. The order puts
   shingles that are frequent in many documents last, which changes the work and never the result. The holders of a token
   are parted where the next larger set is too large to be linked with the one before, so a token joins like sizes only.
2. *Groups.* Documents with enough shared tokens are similar; each joins the group of the smallest id that it shares (most)
   tokens with, and is compared with that id. The links that hold make components, so copies of one text are settled at once.
3. *Matrix.* Token by group: each group's union of tokens. A document with a token of a group that holds other
   components is a query to it (of two groups the smaller asks).
4. *Bound and open.* A group is cut into blocks of bounded size, and these into leaves. The query's overlap with the
   union of a block's shingles bounds its overlap with every member; only a block, then a leaf, that reaches the
   threshold is opened. Many variants of one text that are just too unlike are so refused at once, not pair by pair.

Links inside a component need no test, as they change nothing; links between components are all found: none of the
steps drops, samples or caps. Equal sets meet as one class. Rows with one id are one document with several texts;
a null id counts as the largest id and comes out null. A null or empty text, or one without words, has no
shingles and is linked with nothing. Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe.llm import text as X
from thermalframe.llm.components import components
from thermalframe.llm.store import bit_table, forget, on_used_bits, parts, written

CELLS_FROM = 88                # percent from which cells are used
STEPS = 3                      # of a class: from one size to the largest that a link reaches, so many times over
NEED, NEED_OF = 3, 20          # first shingles that linked sets have in common: one of 20, and 3 at least (or all a link needs)
HOT_SHINGLES = 262_144         # frequent shingles that are put last, at most
HOT_COUNT = 8                  # documents of one task from which a shingle may be one of them
HELD_TOKENS = 1_000_000        # tokens that a task gathers before it deals them out
BLOCK_SHINGLES = 1_000_000     # shingles in one block of a group, but one document at least
LEAF = 32                      # documents in one leaf of a block
QUERIES = 2_000                # queries to one copy of a block
HEAVY = 2_000                  # documents of a group from which it is dealt over several tasks


def size_classes(percent: int, upto: int) -> list[tuple[int, int, int]]:
    """(largest size, number of cells, largest size without links into the next) of each class up to the one that holds ``upto`` and the next."""
    classes, low = [], 1
    while True:
        high = low
        for _ in range(STEPS):
            high = high * 100 // percent
        classes.append((high, 2 * high * (100 - percent) // (100 + percent) + 1, (percent * (high + 1) - 1) // 100))
        if len(classes) > 1 and classes[-2][0] >= upto:
            return classes
        low = high + 1


def _half_sums(h: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
    high = np.bincount(cell, (h >> np.uint64(32)).astype(float), cells).astype(np.uint64)
    return low + (high << np.uint64(32))


def tokens_of(shingles: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
    """Tokens of one set in its own size class and, if a larger set there can be linked with it, in the next."""
    own = next(k for k, (high, _, _) in enumerate(classes) if high >= len(shingles))
    scrambled, found = X.mix(shingles ^ np.uint64(0x5DEECE66D)), []
    for k in (own, own + 1) if len(shingles) > classes[own][2] else (own,):
        cells = classes[k][1]
        content = _half_sums(scrambled, (shingles % np.uint64(cells)).astype(np.int64), cells)
        found.append(X.mix(content ^ X.mix(np.arange(cells, dtype=np.uint64) + np.uint64(k << 40))))
    return np.concatenate(found)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set that it is linked with."""
    return -(-percent * n // 100)


def needed(n: int) -> int:
    return max(NEED, n // NEED_OF)


def first_shingles(shingles: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The first shingles by (frequent or not, hash), so many that two linked sets have ``needed`` (smaller set) of them in common."""
    count = min(len(shingles), len(shingles) - least_overlap(len(shingles), percent) + needed(len(shingles)))
    if not len(hot):
        return shingles[:count]
    late = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles
    return np.concatenate([shingles[~late], shingles[late]])[:count]


def hot_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that the tasks' documents repeat most: at most ``HOT_SHINGLES``, sorted.

    A task forgets what it has seen in one document only whenever it holds ``HELD_TOKENS`` shingles.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge() -> None:
            nonlocal found, times
            before = len(found)
            found, at = np.unique(np.concatenate([found, *held]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, np.ones(len(at) - before, np.int64)]), len(found)).astype(np.int64)
            found, times = found[times > 1], times[times > 1]
            held.clear()

        for batch in X.slices(batches):
            held += X.shingle_sets(batch.column("text"), size)
            if sum(map(len, held)) >= HELD_TOKENS:
                merge()
        merge()
        often = times >= HOT_COUNT
        yield pa.record_batch([pa.array(found[often].view(np.int64)), pa.array(times[often])], ["shingle", "times"])

    top = (docs.select("text").mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
           .orderBy(F.desc("times"), "shingle").limit(HOT_SHINGLES))
    return np.sort(np.array([r["shingle"] for r in top.select("shingle").collect()], np.int64).view(np.uint64))


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, d1, d2, tokens) of every row: set size, digests of the set, packed tokens."""
    cells = percent >= CELLS_FROM
    hot = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if cells else hot_shingles(docs, size))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(percent, 1)
        for batch in X.slices(batches):
            n, d1, d2, packed = [], [], [], []
            for s in X.shingle_sets(batch.column("text"), size):
                n.append(len(s))
                d1.append(int(X.mix(s ^ np.uint64(11)).sum().view(np.int64)))
                d2.append(int(X.mix(s ^ np.uint64(23)).sum().view(np.int64)))
                if not cells:
                    packed.append(first_shingles(s, percent, hot.value).tobytes())
                    continue
                if len(s) > classes[-2][0]:
                    classes = size_classes(percent, len(s))
                packed.append(tokens_of(s, classes).tobytes() if len(s) else b"")
            yield pa.record_batch([pa.array(X.ids_of(batch.column("doc_id"))), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                                   pa.array(d2, pa.int64()), X.binary(packed)], ["doc_id", "n", "d1", "d2", "tokens"])
    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, d1 long, d2 long, tokens binary")


_DEALT = "part int, count int, sets int, tokens binary, row binary, doc_id binary, digest binary, size binary"


def _deal(spread: int):
    """Tokens by part: one line for each part and ``HELD_TOKENS`` tokens; equal sets go once. Sorted tokens go as their distances."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        count = 0

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            token = np.concatenate([np.frombuffer(v[1], np.uint64) for _, v in rows])
            row = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(v[1]) // 8 for _, v in rows])
            order = np.argsort(token)
            token, row = token[order], row[order]
            cut = np.searchsorted(X.deal(token, spread), np.arange(spread + 1))
            ids = np.array([v[0] for _, v in rows], np.int64)
            digest = np.array([k[1] for k, _ in rows], np.int64)
            size = np.array([k[0] for k, _ in rows], np.uint32)
            lines = []
            for p in np.flatnonzero(np.diff(cut)):
                a, b = cut[p], cut[p + 1]
                used, local = np.unique(row[a:b], return_inverse=True)
                gaps = np.diff(token[a:b], prepend=np.uint64(0))
                lines.append((int(p), int(b - a), len(used), X.squeezed(gaps), X.squeezed(local.astype(np.uint32)),
                              X.squeezed(ids[used]), digest[used].tobytes(), X.squeezed(size[used])))
            types = [pa.int32()] * 3 + [pa.binary()] * 5
            return pa.record_batch([pa.array([x[i] for x in lines], t) for i, t in enumerate(types)],
                                   ["part", "count", "sets", "tokens", "row", "doc_id", "digest", "size"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "d1", "d2", "tokens")]
            for doc, n, d1, d2, packed in zip(*columns):
                if not n:
                    continue
                if (key := (n, d1, d2)) in held:
                    held[key][0] = min(held[key][0], doc)
                    continue
                held[key] = [doc, packed]
                count += len(packed) // 8
                if count >= HELD_TOKENS:
                    yield out()
                    held.clear()
                    count = 0
        if held:
            yield out()
    return deal


def _share(percent: int):
    """(token, doc_id, lead, n) of each token in several sets of like size: its members and the smallest of them."""
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for count, sets, token, row, doc, digest, size in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                row = X.unsqueezed(row, np.uint32, count)
                got[0].append(np.cumsum(X.unsqueezed(token, np.uint64, count)))
                got[1].append(X.unsqueezed(doc, np.int64, sets)[row])
                got[2].append(np.frombuffer(digest, np.int64)[row])
                got[3].append(X.unsqueezed(size, np.uint32, sets)[row])
        if not got[0]:
            return
        token = np.concatenate(got[0])
        order = np.argsort(token)
        again = token[order][1:] == token[order][:-1]
        several = np.zeros(len(token), bool)
        several[1:] |= again
        several[:-1] |= again
        order = order[several]
        token, doc, digest, n = token[order], *(np.concatenate(x)[order] for x in got[1:])
        got.clear()
        order = np.lexsort((n, token))                 # a set too large for the one before begins another token
        token, doc, digest, n = token[order], doc[order], digest[order], n[order].astype(np.int64)
        new = _changes(token)
        new[1:] |= n[1:] * percent > n[:-1] * 100
        run = np.cumsum(new) - 1
        token = X.mix(token ^ X.mix(n[np.flatnonzero(new)][run].astype(np.uint64)))
        order = np.lexsort((doc, digest, run))
        run, token, doc, digest, n = run[order], token[order], doc[order], digest[order], n[order]
        keep = _changes(run, digest)                   # equal sets: the smallest id stands for them
        run, token, doc, n = run[keep], token[keep], doc[keep], n[keep]
        order = np.lexsort((doc, run))
        run, token, doc, n = run[order], token[order], doc[order], n[order]
        begin = np.flatnonzero(_changes(run))
        length = np.diff(np.append(begin, len(run)))
        member = np.repeat(length > 1, length)
        lead = np.repeat(doc[begin], length)
        yield pa.record_batch([pa.array(token[member].view(np.int64)), *(pa.array(x[member]) for x in (doc, lead, n))],
                              ["token", "doc_id", "lead", "n"])
    return share


def _changes(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _verify(percent: int):
    """The lead of a group comes first, then the documents that are compared with it."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leads = None, []
        for batch in batches:
            found = []
            for group, salt, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("group", "salt", "doc_id", "shingles"))):
                if at != (group, salt):
                    at, leads = (group, salt), []
                shingles = np.frombuffer(packed, np.uint64)
                if doc == group:
                    leads.append(shingles)
                elif any(_linked(x, shingles, percent) for x in leads):
                    found.append((group, doc))
            yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
    return verify


class Block:
    """Members of a block in leaves, with the union of shingles of each leaf and of all."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int, np.ndarray]]] = []
        self.unions: list[np.ndarray] = []

    def add(self, doc: int, component: int, shingles: np.ndarray) -> None:
        if not self.leaves or len(self.leaves[-1]) == LEAF:
            self.leaves.append([])
        self.leaves[-1].append((doc, component, shingles))

    def links(self, doc: int, component: int, own: bool, shingles: np.ndarray, percent: int) -> Iterator[int]:
        """One linked member of each component other than the query's; in its own group among smaller ids."""
        if not self.unions:
            self.unions = [np.unique(np.concatenate([m[2] for m in leaf])) for leaf in self.leaves]
            self.whole = np.unique(np.concatenate(self.unions)) if self.unions else shingles[:0]
        least = percent * len(shingles)
        if 100 * len(np.intersect1d(shingles, self.whole, assume_unique=True)) < least:
            return
        done = {component}
        for leaf, union in zip(self.leaves, self.unions):
            if 100 * len(np.intersect1d(shingles, union, assume_unique=True)) < least:
                continue
            for member, other, held in leaf:
                if other not in done and not (own and member >= doc) and _linked(shingles, held, percent):
                    done.add(other)
                    yield member


def _open(percent: int):
    """Members of a block come first, then its queries."""
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block()
        for batch in batches:
            found = []
            for *key, asks, doc, component, packed in zip(*(batch.column(c).to_pylist() for c in (
                    "group", "block", "salt", "asks", "doc_id", "component", "shingles"))):
                if at != key:
                    at, block = key, Block()
                shingles = np.frombuffer(packed, np.uint64)
                if asks:
                    found += [(m, doc) for m in block.links(doc, component, asks == 2, shingles, percent)]
                else:
                    block.add(doc, component, shingles)
            yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
    return opened


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ``ids``, and a few others: a bit table keeps most out before anything is shuffled."""
    used = rows.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64("doc_id"))))
    names = rows.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = on_used_bits(batch.column("__name").to_numpy().view(np.uint64), used.value)
            yield batch.filter(pa.array(keep)).select(names)
    return rows.withColumn("__name", F.xxhash64("doc_id")).mapInArrow(pick, rows.schema)


def _sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` with ``shingles``. Its ids meet the texts, which are shorter than their sets."""
    names = [c for c in wanted.columns if c != "doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            sets = X.binary(s.tobytes() for s in X.shingle_sets(batch.column("text"), size))
            yield pa.record_batch([batch.column("doc_id"), *(batch.column(c) for c in names), sets], ["doc_id", *names, "shingles"])
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(X.NULL_ID)).alias("doc_id"), "text")
    kinds = ", ".join(f"{c} {t}" for c, t in wanted.dtypes if c != "doc_id")
    joined = _only(rows, wanted).join(wanted, "doc_id").select("doc_id", *names, "text")
    return joined.mapInArrow(pack, f"doc_id long, {kinds}, shingles binary").where("length(shingles) > 0")


def _by_group(rows: DataFrame, groups: DataFrame, count: str) -> DataFrame:
    """``rows`` with the columns of their group (one row a group; ``count`` its size). Groups of more than ``HEAVY`` rows are joined
    by themselves: there are few of them, so Spark sends their table to the rows and no task gets such a group whole."""
    large = written(groups.where(F.col(count) > HEAVY), "heavy")
    small = rows.join(large.select("group"), "group", "left_anti").join(groups.where(F.col(count) <= HEAVY), "group")
    return rows.join(large, "group").unionByName(small)


def enough(percent: int) -> Column:
    """Tokens that a set of ``least`` shingles, or more, shares with any set that it is linked with."""
    other = F.ceil(F.col("least") * percent / 100)
    if percent >= CELLS_FROM:
        return F.lit(1)
    return F.least(F.greatest(F.lit(NEED), F.floor(other / NEED_OF)), other)


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest id with the same shingle set. ``percent`` is the whole-number threshold, 1 to 100.
    Tables in the shared folder are deleted as soon as what was read from them is written.
    """
    spark = docs.sparkSession
    sketch = written(sketches(docs, size, percent), "sketches")
    classes = sketch.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    member = written(sketch.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
                     .select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    n_parts = parts(spark)
    dealt = sketch.select("doc_id", "n", "d1", "d2", "tokens").mapInArrow(_deal(n_parts), _DEALT)
    holders = written(dealt.repartitionById(n_parts, "part").mapInArrow(
        _share(percent), "token long, doc_id long, lead long, n long"), "tokens")
    forget(sketch)
    leads = holders.groupBy("doc_id", "lead").agg(F.count("*").alias("shares"), F.min("n").alias("least"))
    most = F.struct("shares", -F.col("lead")) if percent < CELLS_FROM else -F.col("lead")
    similar = written(leads.groupBy("doc_id").agg(F.max_by("lead", most).alias("group"), F.max_by("shares", most).alias("shares"),
                                                  F.sum("shares").alias("all"), F.min("least").alias("least"))
                      .where(F.col("all") >= enough(percent)).drop("all"), "groups")
    compared = similar.where((F.col("group") != F.col("doc_id")) & (F.col("shares") >= enough(percent)))
    sizes = written(compared.groupBy("group").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / HEAVY).alias("salts")), "sizes")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    asking = _by_group(compared.select("group", "doc_id"), sizes, "rows").select(
        "group", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"), "doc_id")
    checks = written(asking.union(sizes.select("group", upto(F.col("salts")).alias("salt"), F.col("group").alias("doc_id"))), "checks")
    checked = (_sets(docs, size, checks).repartition(n_parts, "group", "salt")
               .sortWithinPartitions("group", "salt", F.col("doc_id") != F.col("group"))
               .mapInArrow(_verify(percent), "a long, b long"))
    several = member.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z")
    same_id = several.select("doc_id", "a").join(member, "doc_id").select("a", F.col("class_id").alias("b"))
    first = components(checked.union(same_id), "components")

    placed = written(similar.join(first.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
                     .select("doc_id", "group", F.coalesce("root", "doc_id").alias("component"), "least"), "placed")
    width = placed.groupBy("group").agg(F.count("*").alias("members"), F.sum("least").alias("total"),
                                        F.min("component").alias("lo"), F.max("component").alias("hi"))
    width = written(width, "widths")
    wide = _by_group(placed, width.drop("total"), "members")
    located = holders.select("token", "doc_id").join(wide, "doc_id")
    mixed = located.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    matrix_rows = written(located.join(mixed.select("token"), "token", "left_semi"), "matrix")
    forget(holders, similar)
    matrix = matrix_rows.select("token", F.col("group").alias("g"), F.col("members").alias("m"), F.col("lo").alias("glo"),
                                F.col("hi").alias("ghi")).distinct()
    asked = (matrix_rows.join(matrix, "token")
             .where("case when group = g then glo <> ghi else (members, group) < (m, g) and (glo <> ghi or glo <> component) end")
             .groupBy("doc_id", "component", "least", F.col("g").alias("group"),
                      F.when(F.col("g") == F.col("group"), 2).otherwise(1).alias("asks"))
             .agg(F.count("*").alias("shares"))        # of the query's tokens, those in the group's union
             .where(F.col("shares") >= enough(percent)).drop("least", "shares"))
    asked = written(asked, "queries")
    forget(matrix_rows)

    load = asked.groupBy("group").agg(F.count("*").alias("queries"))
    shape = written(load.join(width, "group").select(
        "group", F.greatest("members", "queries").alias("rows"), F.ceil(F.col("total") / BLOCK_SHINGLES).alias("blocks"),
        F.ceil(F.col("queries") / QUERIES).alias("salts")), "shapes")
    lines = (_by_group(placed.select("group", "doc_id", "component"), shape, "rows")
             .select("group", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), upto(F.col("salts")).alias("salt"),
                     F.lit(0).alias("asks"), "doc_id", "component"))
    queries = (_by_group(asked, shape, "rows")
               .select("group", upto(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "salts").alias("salt"),
                       "asks", "doc_id", "component"))
    work = written(lines.union(queries), "work")
    opened = (_sets(docs, size, work)
              .repartition(n_parts, "group", "block", "salt").sortWithinPartitions("group", "block", "salt", "asks", "doc_id")
              .mapInArrow(_open(percent), "a long, b long"))
    stars = first.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    final = components(stars.union(opened), "joined")
    forget(sizes, checks, placed, width, asked, shape, work)
    known = lambda c: F.expr(f"nullif({c}, {X.NULL_ID})")
    return (member.join(final.select(F.col("id").alias("class_id"), "root"), "class_id", "left")
            .select(known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    known("coalesce(root, class_id)").alias("component_id"), known("class_id").alias("class_id")))
