import numpy as np
import pytest

import brute
from thermalframe.llm import lm_score


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def close(got, want):
    want = sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block, order, stretch", [(2_000_000, 2, 512), (700, 2, 3), (2_000_000, 3, 512), (700, 3, 5), (2_000_000, 4, 4), (700, 1, 1)])
def test_equals_plain_version(spark, texts, monkeypatch, block, order, stretch):
    """Blocks of any size, models of any order, and documents walked whole or in short stretches."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_score, "STRETCH", stretch)
    rows = [r for r in texts if r[0] != 8] + [(None, "a b a b"), (13, "one"), (13, "one")] + [(400 + i, "the cat sat on the mat " * 200) for i in range(9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, tokens int, score string").repartition(4).persist()
    got = rows_of(lm_score.score_documents(df, order=order))
    close(got, brute.lm(rows, lm_score.MU, order=order))
    if order > 1:
        assert sum(r[6] for r in got) > sum(r[5] for r in got)


def test_probabilities_add_up(spark):
    """Over the known tokens and one unknown, each context's probabilities make 1."""
    train = [(i, "a b c a b d") for i in range(5)]
    vocabulary = ["a", "b", "c", "d", "zzz"]
    rows = train + [(100 + i, f"a {w}") for i, w in enumerate(vocabulary)] + [(200, "a")]
    held = [(i, t) for i, t in rows if i >= 100]
    import zlib
    ids = iter(i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 5 == 1)
    held = [(next(ids), t) for _, t in held]
    train = [(i, t) for i, (_, t) in zip((i for i in range(999) if zlib.crc32(str(i).encode()) % 5 != 1), train)]
    df = spark.createDataFrame(train + held, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in lm_score.score_documents(df).collect()}
    want = {r[0]: r[6] for r in brute.lm(train + held, lm_score.MU, order=3)}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
    from collections import Counter
    one, mu = Counter("abcabd" * 5), lm_score.MU
    n, v = 35, 5
    p = {w: (one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in "abcd?"} | {"end": 5.5 / (n + 3)}
    two = {"b": 10}
    assert abs(sum((two.get(w, 0) + mu * q) / (10 + mu) for w, q in p.items()) - 1) < 1e-12


@pytest.mark.parametrize("values", [[], [7], [0, 2**64 - 1], [5, 6, 300, 2**40, 2**63, 2**63 + 1], range(1000)])
def test_sorted_values_as_steps(values):
    h = np.array(list(values), np.uint64)
    assert lm_score.unpack_sorted(lm_score.pack_sorted(h)).tolist() == h.tolist()


def test_squeeze():
    x = np.array([0, 1, 254, 255, 256, 10**6, 3])
    assert lm_score.unsqueeze(lm_score.squeeze(x), len(x)).tolist() == x.tolist()


@pytest.mark.parametrize("order", [1, 3])
def test_other_orders(spark, order):
    rows = [(i, "a b c a b d a b c") for i in range(30)] + [(99, "a b c x"), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = lm_score.score_documents(df, order=order).collect()
    assert len(got) == 32 and all(r.score < 0 for r in got)
    if order == 1:
        assert all(abs(r.score - r.base_score) < 1e-9 for r in got)
    else:
        assert sum(r.score for r in got) > sum(r.score for r in lm_score.score_documents(df, order=2).collect())


def test_states_and_arcs():
    """The automaton of "a b a c" and "a b": which contexts are states, and where arcs and failure arcs lead."""
    import pyarrow as pa
    batch = pa.record_batch([pa.array([2, 3]), pa.array(["a b a c", "a b"])], ["doc_id", "text"])
    block, = lm_score.blocks(iter([batch]), 5, -1)
    m = lm_score.Automaton(block, lambda k, gram: np.bincount(lm_score._distinct(block, k)[1]), 3, 8, 4, 10.0)
    assert len(m.fail_to) == 1 + 5 + 6                  # the empty context, begin a b c end, six pairs
    assert len(m.arc) == 6 + 5 + 1 and (np.diff(m.arc) > 0).all()
    begin, a, b = m.word[block.first[0]], m.word[block.first[0] + 1], m.word[block.first[0] + 2]
    s = m.root_to[begin]
    s, _ = m.step(np.array([s]), np.array([a]))
    assert m.fail_to[s[0]] == m.root_to[a]              # the pair (begin, a) fails to a
    s, w = m.step(s.copy(), np.array([b]))
    assert m.fail_to[s[0]] == m.root_to[b]
    p1 = 2.5 / (8 + 2.5)
    p2 = (2 + 10 * p1) / (3 + 10)
    assert abs(w[0] - np.log10((2 + 10 * p2) / (2 + 10))) < 1e-12
    _, w = m.step(s.copy(), np.array([b]))              # no arc in (a, b), nor in b: two failure arcs
    assert abs(w[0] - np.log10(10 / 12 * 10 / 12 * p1)) < 1e-12


def test_empty(empty):
    assert lm_score.score_documents(empty).count() == 0
