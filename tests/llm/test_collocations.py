import random
import re
from collections import Counter

import numpy as np
import pytest

from thermalframe.llm import collocations, store
from thermalframe.llm.queries import QUERIES

_lower = {c: c + 32 for c in range(65, 91)}


def plain(rows, top=2000, longest=5, least=100, percent=100):
    """All phrases counted one by one, all cuts, all longer phrases."""
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    longer = Counter()
    for (lang, *g), a in frequent.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                longer[(lang, *g[i:i + k])] = max(longer[(lang, *g[i:i + k])], a)
    out = []
    for (lang, *g), a in frequent.items():
        if longer[(lang, *g)] and 100 * longer[(lang, *g)] >= percent * a:
            continue
        cuts = [(1000 * a * total[lang] // (f[(lang, *g[:k])] * f[(lang, *g[k:])]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, f[(lang, *g[:k])], f[(lang, *g[k:])], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    ranked = []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], *rest))
    return ranked


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"{a}{b}" for a in "xyzéZ" for b in ("", "1", "\x1c", "'", "-")]
    rows = []
    for i in range(120):
        words = [rng.choice(pool[:rng.choice([3, 8, 25])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! "])
                 for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "en", "de", "", None]), "".join(words)))
    return rows + [("en", None), (None, ""), ("de", " .,; "), ("fr", "a b c d e f " * 30), ("fr", "Only Once")]


@pytest.mark.parametrize("seed, least, percent, longest, top", [(1, 3, 100, 5, 2000), (2, 5, 60, 5, 7), (3, 2, 100, 3, 50), (4, 4, 90, 2, 2000)])
def test_equals_plain_version(spark, seed, least, percent, longest, top):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, phrase string, name int, a int").repartition(4)
    got = [tuple(r) for r in collocations.mine_phrases(df, top, longest, least, percent).collect()]
    assert sorted(got) == sorted(plain(rows, top, longest, least, percent))


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_ENTRIES", 50)
    monkeypatch.setattr(collocations, "PART_WORDS", 100)
    monkeypatch.setattr(store, "MAX_BITS", 1 << 16)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert sorted(map(tuple, collocations.mine_phrases(df, least=3).collect())) == sorted(plain(rows, least=3))


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, n = 3 * 10 ** 12, 9 * 10 ** 12
    row = spark.createDataFrame([(a, n, [a + 1], [a + 2])], "a long, n long, before array<long>, after array<long>")
    got = row.select(collocations._lowest_cut(2).alias("c")).first()["c"]
    assert 1000 * a * n > 2 ** 64 and got["score"] == 1000 * a * n // ((a + 1) * (a + 2))


def test_stripes_round_trip():
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    n = rng.integers(1, 400, 500)
    back = collocations.unpack_stripes(collocations.pack_stripes(left, right, n))
    assert sorted(zip(*map(np.ndarray.tolist, back))) == sorted(zip(left.tolist(), right.tolist(), n.tolist()))


def test_equal_names_stay_apart(monkeypatch):
    monkeypatch.setattr(collocations, "name_of", lambda left, right: left ^ right)
    left, right = np.array([1, 2, 1, 2], np.uint64), np.array([2, 1, 2, 1], np.uint64)
    _, a, b, n = collocations.merged(left, right, np.array([1, 10, 2, 20]))
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 2, 3), (2, 1, 30)]


def test_empty_table(empty):
    assert collocations.mine_phrases(empty).collect() == []


def test_fixture_texts(docs, texts):
    want = plain([("en", t) for _, t in texts], least=20)
    assert sorted(map(tuple, collocations.mine_phrases(docs, least=20).collect())) == sorted(want)


def test_query(spark):
    got = [tuple(r) for r in QUERIES["op12_phrase_mining"](spark, "/root/testdata/sf0.001").collect()]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()
    assert sorted(got) == sorted(plain([(r.lang, r.text) for r in rows]))
