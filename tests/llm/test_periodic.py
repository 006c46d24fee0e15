import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from thermalframe.llm import periodic, text as X
from thermalframe.llm.queries import QUERIES


def plain_runs(words, min_words=6, min_repeats=4):
    """Every period in turn: longest stretches of words that equal the word one period later."""
    found = {}
    for q in range(1, len(words) // min_repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_repeats * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("min_words, min_repeats", [(6, 4), (2, 2), (1, 3), (9, 2)])
def test_small_texts(seed, min_words, min_repeats):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        letters, words = rng.choice([1, 2, 3, 5]), []
        while len(words) < rng.randint(0, 40):
            words += [rng.randrange(letters) for _ in range(rng.randint(1, 4))] * rng.randint(1, 8)
        texts.append(words)
    first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    hashes = X.mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(7))
    got = periodic.runs_of(hashes, first, min_words, min_repeats)
    assert got == {d: r for d, t in enumerate(texts) if (r := plain_runs(t, min_words, min_repeats))}


@pytest.mark.parametrize("words, runs", [
    (np.zeros(40_000, np.uint64), [(0, 40_000, 1)]), (np.arange(40_000, dtype=np.uint64) % 7, [(0, 40_000, 7)]),
    (np.arange(40_000, dtype=np.uint64), []), (np.r_[np.arange(9), np.arange(8_000) % 2_000].astype(np.uint64), [(9, 8_000, 2_000)])])
def test_long_texts(words, runs):
    assert periodic.runs_of(X.mix(words), np.array([0, len(words)])).get(0, []) == runs


def test_lists_are_cut():
    a = periodic.Places(0, 1)
    for i in range(1, 3 * periodic.CHUNK):
        a.take(periodic.Places((i * 7919) % (3 * periodic.CHUNK), 1))
    flat = [x for part in a.lists for x in part]
    assert len(a.lists) > 2 and flat == sorted(flat) and a.size == len(flat) and a.left == 1
    assert a.around(5) == (4, 5) and a.around(0) == (None, 0) and a.around(10 ** 6)[1] is None


def test_every_row(spark, docs, texts):
    rows = docs.union(docs.where("doc_id in (1, 19)")).union(docs.where("doc_id = 19").selectExpr(
        "cast(null as long)", "text", "lang", "source", "n_chars", "n_words", "key", "tokens", "n"))
    want = [(i, t) for i, t in texts] + [(i, t) for i, t in texts if i in (1, 19)] + [(None, t) for i, t in texts if i == 19]
    got = periodic.find_runs(rows.withColumn("runs", rows.doc_id), periodic.planted).collect()
    plain = {(i, t): plain_row(i, t if i not in (7, 8) else "") for i, t in want}
    for r in got:
        if r.doc_id in (7, 8):
            continue                                # too long for the plain version
        row = next(v for (i, t), v in plain.items() if i == r.doc_id)
        assert len(r.runs) == row[1] and hashlib.sha256(r.collapsed.encode()).hexdigest() == row[-1]
    assert sorted((r.doc_id or -1) for r in got) == sorted((i or -1) for i, _ in want)


def test_empty_table(empty):
    assert periodic.find_runs(empty).collect() == []


def test_query_equals_plain_version(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(5000 + i, "a b " * (i + 3)) for i in range(60)] + [(6000, None), (6001, ""), (6002, "x " * 30), (6003, " \n\t")]
    small = docs.where("n_chars < 4000").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    small.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect())
    assert sorted(map(str, got)) == sorted(str(plain_row(r.doc_id, r.text)) for r in small.collect())
    assert sum(1 for r in got if r[1]) > 30
