"""Connected components of an edge table, by alternating stars; nothing of it reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalframe.llm.store import forget, written

CHUNK = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, at most ``CHUNK`` at a time, as stars around each local component's smallest id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(top, x) for x, top in pairs if x != top]
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    held = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= CHUNK:
            yield stars()
            parent.clear()
            held = 0
    yield stars()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): root is the smallest id of its component.

    Null ends and loops are left out; repeated edges count once. Each round is written to the shared
    folder. Local forests shorten the paths; large and small stars then converge in a logarithmic
    number of rounds for any size of component.
    """
    seed = edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = written(seed.mapInArrow(_forest, "a long, b long"), name)
    state = None
    while True:
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.least("a", "low").alias("a"), "b").where("a <> b").distinct())
        down = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (large.join(down, "b").select(F.col("low").alias("x"), F.when(F.col("a") == F.col("low"), F.col("b"))
                                              .otherwise(F.col("a")).alias("y"), "b"))
        kept = small.select(F.col("x").alias("a"), F.col("y").alias("b")).union(
            small.select("x", "b")).where("a <> b").distinct()
        before, current = current, written(kept, name)
        forget(before)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    child = current.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return child.union(child.select(F.col("root"), F.col("root")).distinct())
