import random

import pytest

import brute
from thermalframe.llm import decontaminate


def rows_of(df):
    return sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def cases(texts):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 9, 14, 20, 37, 59, 64, 130, 400, 1500] * 3)]
    items += [(90, None), (91, ""), (92, "one two"), (93, "Three"), (None, items[4][1]), (94, items[4][1]), (95, "same " * 30)]
    docs = list(texts)
    for i, (_, text) in enumerate(items[:33]):
        w = text.split()
        noise = [word() for _ in range(rng.choice([0, 3, 800, 9000]))]
        at = rng.randrange(len(noise) + 1)
        docs.append((1000 + i, " ".join(noise[:at] + w + noise[at:])))
        docs.append((2000 + i, " ".join(noise[:at] + w[:max(1, len(w) * 17 // 20)] + noise[at:]).upper()))     # part, other case
        half = len(w) // 2
        docs.append((3000 + i, " ".join(w[:half + 4] + noise + w[half:])))                                       # in two places
    docs += [(None, items[4][1]), (7777, items[4][1]), (7777, items[4][1]), (7778, "zero ONE\ttwo three")]
    return docs, items


def test_equals_plain_version(spark, cases):
    docs, items = cases
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, n_item string").repartition(4)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = sorted(brute.contained(docs, items), key=str)
    assert len(want) > 60
    assert rows_of(decontaminate.contaminated(d, b)) == want


def test_blocks_of_items(spark, cases, monkeypatch):
    docs, items = cases
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = rows_of(decontaminate.contaminated(d, b))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 15_000)
    assert rows_of(decontaminate.contaminated(d, b)) == want


def test_items_of_few_distinct_shingles_are_never_missed(spark):
    rng = random.Random(6)
    texts = [" ".join(f"i{i}x{j}" for j in range(5 + i % 3)) for i in range(600)]                   # one to three shingles
    texts += [" ".join([f"i{i}x0 i{i}x1"] * 20) for i in range(600, 700)]                             # many, but two different ones
    noise = lambda: [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
    docs = [(i, " ".join([*noise(), t, *noise()])) for i, t in enumerate(texts)]
    docs += [(1000 + i, " ".join([*noise(), *t.split()[:4], *noise()])) for i, t in enumerate(texts)]  # not a whole shingle
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    want = [(i, i, 2, 2) if i >= 600 else (i, i, 1 + i % 3, 1 + i % 3) for i in range(700)]
    assert rows_of(decontaminate.contaminated(d, b)) == sorted(want, key=str)
    half = {(r[0], r[1]) for r in rows_of(decontaminate.contaminated(d, b, percent=50))}
    assert half == {(i, i) for i in range(700)}


def test_empty(spark, empty, docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
