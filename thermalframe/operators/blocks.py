"""Order-dependent operators that never put a whole series into one task.

A series (one unit, or the whole table) may hold any number of rows, so no
window here is partitioned by the series alone. The integer order key is cut
into blocks of equally many rows, about ``BLOCK_ROWS``: the edges are quantiles
of the key, so neither a stray key nor a burst makes a heavy block. Windows run
inside (series, block); what crosses a block edge (row counts, last and next
known values) is carried by a summary with one row per block, which is run
through in two levels once there are more than ``SUPER`` blocks.

A missing series key is a series of its own. A missing order key, or one that
occurs twice in a series, has no place in the order and raises.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
SEGMENTS = 1 << 10          # quantiles of the key, at most; more blocks cut the segments between them
SUPER = 1 << 12             # blocks that are run through together

_BLOCK, _RN, _START = "__block", "__rn", "__start"


class Blocks:
    """Blocks of an integer key: equal-depth segments, each cut into ``within`` blocks of equal width.

    ``lows`` holds the first key of every segment but the first, whose own is the smallest key.
    """

    def __init__(self, low: int, high: int, lows: Sequence[int] = (), within: int = 1) -> None:
        self.lows = [low, *(x for x in sorted(set(lows)) if low < x <= high)]
        self.high, self.within = high, within
        ends = [*self.lows[1:], high + 1]
        self.widths = [max(1, -(-(end - first) // within)) for first, end in zip(self.lows, ends)]

    @property
    def count(self) -> int:
        return len(self.lows) * self.within

    def number(self, order: str) -> Column:
        """Block number of a key; a missing key raises."""
        key = f"CAST(`{order}` AS BIGINT)"

        def segment(a: int, b: int) -> str:
            if b - a == 1:
                if self.within == 1:
                    return f"{a}L"
                inside = f"CAST((CAST({key} AS DECIMAL(20,0)) - {self.lows[a]}) div {self.widths[a]} AS BIGINT)"
                return f"({a * self.within}L + greatest(0L, least({self.within - 1}L, {inside})))"
            mid = (a + b) // 2
            return f"CASE WHEN {key} < {_long(self.lows[mid])} THEN {segment(a, mid)} ELSE {segment(mid, b)} END"

        return F.expr(f"CASE WHEN `{order}` IS NULL THEN CAST(raise_error('order key {order} is missing') AS BIGINT) "
                      f"ELSE {segment(0, len(self.lows))} END")

    def keys(self, number: int) -> tuple[int, int]:
        """First and last key of a block; the outermost ones are open."""
        at, inside = divmod(number, self.within)
        ends = [*self.lows[1:], self.high + 1]
        first = self.lows[at] + inside * self.widths[at]
        last = ends[at] - 1 if inside == self.within - 1 else first + self.widths[at] - 1
        return -TOP - 1 if not number else min(first, TOP), TOP if number == self.count - 1 else min(last, TOP)


TOP = (1 << 63) - 1


def _long(x: int) -> str:
    return f"{x}L" if x > -TOP else f"({x + 1}L - 1L)"


def equal_blocks(df: DataFrame, order: str, width: int | None = None) -> Blocks:
    """Blocks of about ``BLOCK_ROWS`` rows, or of ``width`` key values. Up to ``SEGMENTS`` edges are quantiles of the key."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if row["lo"] is None:
        return Blocks(0, 0)
    low, high = int(row["lo"]), int(row["hi"])
    if width:
        return Blocks(low, high, within=max(1, -(-(high - low + 1) // width)))
    wanted = -(-row["n"] // BLOCK_ROWS)
    segments = min(wanted, SEGMENTS)
    if segments < 2:
        return Blocks(low, high)
    key = df.select(F.col(order).cast("bigint").alias("k"))
    cuts = key.approxQuantile("k", [i / segments for i in range(1, segments)], 0.1 / segments)
    return Blocks(low, high, [min(int(c), TOP) for c in cuts], -(-wanted // segments))


def named_series(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that name each row's series and are never missing, for windows and joins alike."""
    kinds, names, made = dict(df.dtypes), [], {}
    for i, k in enumerate(keys):
        numeric = kinds[k] in ("tinyint", "smallint", "int", "bigint", "float", "double")
        value = F.coalesce(F.col(k), F.lit(0).cast(kinds[k])) if numeric else F.coalesce(F.col(k).cast("string"), F.lit(""))
        made |= {f"__s{i}": value, f"__z{i}": F.col(k).isNull()}
        names += [f"__s{i}", f"__z{i}"]
    return df.withColumns(made) if made else df, names


def _by(keys: Sequence[str]) -> list:
    return [F.col(k) for k in keys] or [F.lit(0)]


def _numbered(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Adds the row number inside each block; equal keys raise."""
    inside = Window.partitionBy(*group).orderBy(order)
    twice = F.lag(order).over(inside) == F.col(order)
    stop = F.raise_error(F.lit(f"order key {order} occurs twice in a series")).cast("bigint")
    return df.withColumn(_RN, F.when(twice, stop).otherwise(F.row_number().over(inside).cast("bigint")))


def _run(lines: DataFrame, keys: Sequence[str], level: str, sums: Sequence[str], last: Sequence[str], first: Sequence[str],
         tail: str) -> DataFrame:
    """Adds ``<name><tail>``: over the lines before (``sums``, ``last`` known) or after (``first`` known) each, in the order of ``level``."""
    ahead = Window.partitionBy(*_by(keys)).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*_by(keys)).orderBy(F.col(level).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("*", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c + tail) for c in sums],
                        *[F.last(c, ignorenulls=True).over(ahead).alias(c + tail) for c in last],
                        *[F.last(c, ignorenulls=True).over(behind).alias(c + tail) for c in first])


def carried(lines: DataFrame, keys: Sequence[str], blocks: Blocks, sums: Sequence[str], last: Sequence[str] = (),
            first: Sequence[str] = ()) -> DataFrame:
    """``lines`` (one per series and block) with ``<name>__c``: the sum of the blocks before, the nearest known value of the blocks
    before (``last``) or after (``first``). More than ``SUPER`` blocks are run through in groups, and the groups likewise."""
    if blocks.count <= SUPER:
        return _run(lines, keys, _BLOCK, sums, last, first, "__c")
    lines = lines.withColumn("__super", F.floor(F.col(_BLOCK) / F.lit(SUPER)))
    groups = lines.groupBy(*keys, "__super").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_BLOCK))).alias(c) for c in last],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(_BLOCK))).alias(c) for c in first])
    groups = _run(groups, keys, "__super", sums, last, first, "__g").drop(*sums, *last, *first)
    inside = _run(lines, [*keys, "__super"], _BLOCK, sums, last, first, "__i").join(groups, [*keys, "__super"])
    return inside.withColumns({**{c + "__c": F.col(c + "__g") + F.col(c + "__i") for c in sums},
                               **{c + "__c": F.coalesce(c + "__i", c + "__g") for c in [*last, *first]}}).drop(
        "__super", *[c + tail for c in [*sums, *last, *first] for tail in ("__g", "__i")])


def row_index(df: DataFrame, order: str, keys: Sequence[str] = (), name: str = "time_index",
              width: int | None = None) -> DataFrame:
    """0-based position of each row in its series."""
    blocks = equal_blocks(df, order, width)
    placed, series = named_series(df.withColumn(_BLOCK, blocks.number(order)), keys)
    group = [*series, _BLOCK]
    lines = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    starts = carried(lines, series, blocks, ["__n"]).withColumnRenamed("__n__c", _START).drop("__n")
    return (_numbered(placed, group, order).join(starts, group)
            .withColumn(name, (F.col(_START) + F.col(_RN) - 1).cast("bigint"))
            .select(*df.columns, name))


def order_cuts(df: DataFrame, order: str, ranks: Sequence[Callable[[Column], Column]],
               width: int | None = None) -> tuple[int, list[int | None]]:
    """Order keys found at global ranks, as ``(row count, [key or None])``.

    Each entry of ``ranks`` maps the row-count column to a 0-based rank. Only one
    line per block is shuffled, so a split costs no shuffle of the data itself.
    The blocks that hold a rank (at most one per rank) are then read again.
    """
    cut = equal_blocks(df, order, width)
    key = F.col(order)
    lines = df.groupBy(cut.number(order).alias(_BLOCK)).agg(F.count(F.lit(1)).alias("__n"))
    blocks = carried(lines, [], cut, ["__n"]).withColumnRenamed("__n__c", _START)
    total = df.count()
    wanted_ranks = F.array(*[r(F.lit(total)).cast("bigint") for r in ranks])
    holds = (F.col("r") >= F.col(_START)) & (F.col("r") < F.col(_START) + F.col("__n"))
    hits = (blocks.select("*", F.posexplode(wanted_ranks).alias("i", "r")).where(holds)
            .select("i", (F.col("r") - F.col(_START)).alias("p"), _BLOCK).collect())
    cuts: list[int | None] = [None] * len(ranks)
    if not hits:
        return total, cuts
    inside = F.lit(False)
    for b in {h[_BLOCK] for h in hits}:
        inside = inside | key.between(*cut.keys(b))
    rows = _numbered(df.where(inside).select(order).withColumn(_BLOCK, cut.number(order)), [_BLOCK], order)
    pick = F.lit(False)
    for h in hits:
        pick = pick | ((F.col(_BLOCK) == h[_BLOCK]) & (F.col(_RN) == h["p"] + 1))
    found = {(r[_BLOCK], r[_RN]): r[order] for r in rows.where(pick).collect()}
    for h in hits:
        cuts[h["i"]] = found[(h[_BLOCK], h["p"] + 1)]
    return total, cuts


def neighbours(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (),
               width: int | None = None, position: str | None = None) -> DataFrame:
    """Nearest known value on both sides of every row, however far away.

    Adds ``<c>__pv``/``<c>__pd`` (previous known value and its distance in rows,
    0 on a known value) and ``<c>__nv``/``<c>__nd`` for the next one, and under the
    name ``position`` the 0-based place of the row in its series.
    """
    blocks = equal_blocks(df, order, width)
    base, series_names = named_series(df.withColumn(_BLOCK, blocks.number(order)), keys)
    group = [*series_names, _BLOCK]
    base = base.where(F.col(_BLOCK).isNotNull())      # in both branches below, so that one exchange serves both
    base = _numbered(base, group, order)
    first = {c: F.min(F.when(F.col(c).isNotNull(), F.col(_RN))) for c in columns}
    last = {c: F.max(F.when(F.col(c).isNotNull(), F.col(_RN))) for c in columns}
    at_first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(_RN))) for c in columns}
    at_last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_RN))) for c in columns}
    summary = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"),
        *[first[c].alias(f"{c}__fr") for c in columns], *[at_first[c].alias(f"{c}__fv") for c in columns],
        *[last[c].alias(f"{c}__lr") for c in columns], *[at_last[c].alias(f"{c}__lv") for c in columns])

    starts = carried(summary, series_names, blocks, ["__n"]).withColumnRenamed("__n__c", _START)

    def edge(c: str, kind: str) -> Column:
        row = F.col(f"{c}__{kind}r")
        return F.when(row.isNotNull(), F.struct(F.col(f"{c}__{kind}v").alias("v"),
                                                (F.col(_START) + row).alias("r")))

    edges = starts.select(*group, _START, *[edge(c, "l").alias(f"{c}__p") for c in columns], *[edge(c, "f").alias(f"{c}__n") for c in columns])
    near = carried(edges, series_names, blocks, [], [f"{c}__p" for c in columns], [f"{c}__n" for c in columns]).select(
        *group, _START, *[F.col(f"{c}__p__c").alias(f"{c}__cp") for c in columns], *[F.col(f"{c}__n__c").alias(f"{c}__cn") for c in columns])

    up = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*group).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    # Value and row number apart: two plain columns are cheaper to carry than a struct per row.
    place = {c: F.when(F.col(c).isNotNull(), F.col(_RN)) for c in columns}
    seen = base.select("*", *[F.last(c, ignorenulls=True).over(up).alias(f"{c}__iv") for c in columns],
                       *[F.last(place[c], ignorenulls=True).over(up).alias(f"{c}__ir") for c in columns])
    seen = seen.select("*", *[F.last(c, ignorenulls=True).over(down).alias(f"{c}__jv") for c in columns],
                       *[F.last(place[c], ignorenulls=True).over(down).alias(f"{c}__jr") for c in columns])

    joined = seen.join(near, group)
    pos = F.col(_START) + F.col(_RN)
    out = []
    for c in columns:
        iv, ir, jv, jr, cp, cn = (F.col(f"{c}__{s}") for s in ("iv", "ir", "jv", "jr", "cp", "cn"))
        out += [
            F.coalesce(iv, cp["v"]).alias(f"{c}__pv"),
            F.coalesce(F.col(_RN) - ir, pos - cp["r"]).alias(f"{c}__pd"),
            F.coalesce(jv, cn["v"]).alias(f"{c}__nv"),
            F.coalesce(jr - F.col(_RN), cn["r"] - pos).alias(f"{c}__nd"),
        ]
    place_in_series = [(pos - 1).cast("bigint").alias(position)] if position else []
    return joined.select(*df.columns, *out, *place_in_series)


def sequences(df: DataFrame, order: str, features: Sequence[str], targets: Sequence[str],
              length: int = 10, horizon: int = 1, keys: Sequence[str] = (),
              width: int = BLOCK_ROWS) -> DataFrame:
    """Sliding windows of ``length`` rows with the label ``horizon`` rows after the window.

    A series of n rows gives n - length - horizon + 1 rows; window i is labelled
    by row i + length + horizon - 1, and where that row does not exist the window
    is dropped. Rows near a block edge are copied to the next block, so a window
    is built inside one task of at most ``width`` + ``length`` + ``horizon`` rows.
    """
    reach = length + horizon - 1
    if reach >= width:
        raise ValueError("a sequence must be shorter than a block")
    pos = row_index(df, order, keys, "__pos")
    home = F.floor(F.col("__pos") / F.lit(width)).cast("bigint")
    copies = F.when(F.pmod(F.col("__pos"), F.lit(width)) >= width - reach, F.array(home, home + 1)) \
        .otherwise(F.array(home))
    placed, names = named_series(pos.withColumn("__seg", F.explode(copies)), keys)
    series = Window.partitionBy(*names, "__seg").orderBy("__pos")
    window = series.rowsBetween(-(length - 1) - horizon, -horizon)
    built = placed.select(
        *keys,
        F.col("__seg"), F.col("__pos"), home.alias("__home"),
        (F.col("__pos") - reach).cast("bigint").alias("seq_index"),
        F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(window).alias("x"),
        F.col(order).alias("label_key"),
        *[F.col(t).alias(f"y_{t}") for t in targets])
    return (built.where((F.col("__seg") == F.col("__home")) & (F.col("seq_index") >= 0))
            .select(*keys, "seq_index", "x", "label_key", *[f"y_{t}" for t in targets]))
