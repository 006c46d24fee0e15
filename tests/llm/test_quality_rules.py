import random

import pyarrow as pa

import brute
from thermalframe.llm.quality_rules import RULES, Counts, cascade, judged


def test_equals_plain_version(docs, texts):
    got = {r[0]: tuple(r)[1:] for r in judged(docs).collect()}
    assert got == {i: brute.quality(t) for i, t in texts}


def own_texts():
    """Texts that one of the rules with counts of its own decides, just below and just above its limit, and random ones."""
    words = [f"word{i}" for i in range(60)]
    out = [" ".join(words[:n]) for n in (19, 20, 21)]
    for same in (17, 18, 25, 26):                       # of 60 words: 30 % are 18
        out.append(" ".join(x for i, w in enumerate(words[:60 - same]) for x in ([w, "same"] if i < same else [w])))
    for bullets in (8, 9, 10):                          # of ten lines
        out.append("\n".join((" - " if i < bullets else "") + " ".join(words[6 * i:6 * i + 6]) for i in range(10)))
    for dots in (2, 3, 4):
        out.append("\n".join(" ".join(words[6 * i:6 * i + 6]) + ("... \r" if i % 2 else "\u2026") * (i < dots) for i in range(10)))
    rng = random.Random(5)
    alphabet = ["- ", "* ", "\u2022", "...", "\u2026", "\n", " ", "\r", "\t", "a", "b", "\u00e9", "##", "word ", "\n- "]
    out += ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(300)]
    out += [" ".join(rng.choices(words, k=rng.randrange(18, 80))) + rng.choice(["", "\n- x", "\n"]) for _ in range(100)]
    return out + ["", None, "\n" * 30]


def test_rules_with_counts_of_their_own(spark):
    rows = list(enumerate(own_texts()))
    got = {r[0]: tuple(r)[1:] for r in judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute.quality(t) for i, t in rows}
    column = pa.array([t for _, t in rows])
    rejected = {name: int(RULES[name](Counts(column)).sum()) for name in RULES}
    assert all(rejected[name] for name in ("one_word", "bullet_lines", "ellipsis_lines"))


def test_order_changes_nothing(texts):
    column = pa.array([t for _, t in texts] + own_texts())
    want = [i for i, t in enumerate(column.to_pylist()) if brute.quality(t)[-1]]
    assert want
    for order in (list(RULES), list(RULES)[::-1], sorted(RULES)):
        asked = {}
        assert cascade(Counts(column), RULES, order, asked).tolist() == want
        assert asked[order[0]] == len(column) and asked[order[-1]] < len(column)


def test_some_of_the_texts(texts):
    """Words and counts kept for some texts are those that these texts have alone."""
    import numpy as np
    column = pa.array([t for _, t in texts] + own_texts())
    counts = Counts(column)
    counts.words, counts.n_words, counts.n_symbols
    for step in (1, 2, 7):
        keep = np.arange(len(column)) % step == 0
        some, alone = counts.of(keep).of(np.ones(int(keep.sum()), bool)), Counts(column.filter(pa.array(keep)))
        for name in ("n_words", "word_chars", "n_symbols", "n_top_word", "n_repeat_words", "n_wordlike", "n_bullets", "n_ellipses", "n_dup_lines"):
            assert getattr(some, name).tolist() == getattr(alone, name).tolist(), name


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, None), (1, "a " * 30), (1, "a " * 30)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in judged(df).collect()) == [(0, 0, False), (1, 30, False), (1, 30, False)]


def test_empty(empty):
    assert judged(empty).count() == 0


def test_few_words_in_all():
    for n in range(12):
        column = pa.array([" ".join("abcdefghijkl"[:n]), None, "x"])
        assert Counts(column).n_repeat_words.tolist() == [0, 0, 0]
