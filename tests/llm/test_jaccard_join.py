import random

import pytest

import brute
from thermalframe.llm.jaccard_join import jaccard_components, size_classes, tokens_of


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_equals_all_pairs(docs, texts, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, size, percent).collect()}
    assert got == brute.components(texts, size, percent)


def test_chains_and_near_misses(spark):
    """Chains of slow change, in which the ends are unlike each other, beside pairs just below the threshold."""
    rng = random.Random(3)
    rows, text = [], [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(60):
        text[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(text)))
    for i in range(60, 120):
        base = [f"k{j}" for j in range(150)]
        for _ in range(rng.randrange(1, 8)):
            base[rng.randrange(150)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute.components(rows, 3, 90)


def test_linked_sets_share_a_token():
    import numpy as np
    rng = np.random.default_rng(1)
    for percent in (80, 90, 100):
        classes = size_classes(percent, 3000)
        for n in (1, 2, 9, 10, 33, 400, 1999):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            same = len(a)
            while 100 * (same - 1) >= percent * (len(a) + (len(a) - same + 1)):     # replace as many as the threshold allows
                same -= 1
            b = np.unique(np.concatenate([a[:same], rng.integers(0, 1 << 62, len(a) - same).astype(np.uint64)]))
            assert np.intersect1d(tokens_of(a, classes), tokens_of(b, classes)).size
            longer = np.unique(np.concatenate([a, rng.integers(0, 1 << 62, len(a) * 100 // percent - len(a)).astype(np.uint64)]))
            assert np.intersect1d(tokens_of(a, classes), tokens_of(longer, classes)).size


def test_null_and_repeated_ids(spark):
    body = " ".join(f"t{i}" for i in range(50))
    rows = [(None, body), (None, "other words entirely"), (5, body), (5, body), (9, "other words entirely"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 7), (9, 5), (None, 5), (None, 5)]


def test_empty(empty):
    assert jaccard_components(empty).count() == 0


def test_linked_sets_share_first_shingles():
    """Whatever is put last, two linked sets have the needed number of first shingles in common."""
    import numpy as np
    from thermalframe.llm.jaccard_join import first_shingles, least_overlap, needed
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 8, 20, 101, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            same = next(s for s in range(len(a) + 1) if 100 * s >= 80 * (2 * len(a) - s))
            b = np.unique(np.concatenate([rng.permutation(a)[:same], rng.integers(0, 1 << 62, len(a) - same).astype(np.uint64)]))
            hot = np.sort(rng.permutation(np.concatenate([a, b]))[:rng.integers(0, n + 1)])
            shared = len(np.intersect1d(first_shingles(a, 80, hot), first_shingles(b, 80, hot)))
            assert shared >= min(needed(min(len(a), len(b))), least_overlap(len(a), 80))


def test_templates_below_and_above_the_threshold(spark):
    """Many variants of one text around the threshold, and a passage that all documents share."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(150):
        base = [f"k{j}" for j in range(100)]
        for _ in range(rng.randrange(1, 7)):
            base[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    for i in range(150, 300):
        rows.append((i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, 5, 80).collect()}
    assert got == brute.components(rows, 5, 80)


def test_few_sets_are_cut_twice():
    """A set is cut for the next class only where a link reaches into it; what is dealt out takes less than its plain numbers."""
    import numpy as np
    from thermalframe.llm import text as X
    from thermalframe.llm.jaccard_join import _deal
    import pyarrow as pa
    rng = np.random.default_rng(4)
    classes = size_classes(90, 20_000)
    sizes = np.unique(np.geomspace(1, 10_000, 200).astype(int))
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in sizes]
    tokens = [tokens_of(s, classes) for s in sets]
    assert sum(map(len, tokens)) < 0.2 * sizes.sum()
    assert all(len(t) == 1 for t, n in zip(tokens, sizes) if n < 9)
    ids = np.arange(len(sets))
    batch = pa.record_batch([pa.array(x) for x in (ids, sizes, ids, ids)] + [pa.array([t.tobytes() for t in tokens])],
                            ["doc_id", "n", "d1", "d2", "tokens"])
    lines = [r for b in _deal(5)([batch]) for r in b.to_pylist()]
    assert sorted(r["part"] for r in lines) == list(range(5))
    got = np.concatenate([np.cumsum(X.unsqueezed(r["tokens"], np.uint64, r["count"])) for r in lines])
    assert np.array_equal(got, np.sort(np.concatenate(tokens)))
    assert sum(len(v) for r in lines for v in r.values() if isinstance(v, bytes)) < 10 * len(got)
