import collections
import gc
import itertools
import types
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from thermalframe.llm import packing
from thermalframe.llm import text as X

import public_tokenizers

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's we'll I'd", "don't.Stop!!", "a1b22 3.14", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "é x ́y", "a b c　d\x85e", "x\x1cy \x1f",
       "<|endoftext|> a<|startoftext|>b", "日本語 テキスト", "😀 👍🏽x", "..., ;;:", "word.,", "ﬁ Å ẛ̣", "ǅ ʰ", "Ⅷ ½ x²"]


@pytest.fixture(scope="module")
def rows(texts, spark):
    more = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return texts + [(300 + i, t) for i, t in enumerate(ODD)] + more + [(None, "a b"), (4, "one")]


def check(got, capacity=2048):
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece int, ids string").repartition(4)
    got = packing.pack_documents(df, PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got), key=str) == \
        sorted(brute.pieces(rows, PATH), key=str)
    n, least = check(got), -(-sum(r.length for r in got) // 2048)
    assert n <= least * 1.01 + 1


def test_windows(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 20_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack_documents(df, PATH, cache=300).collect()
    assert len(got) == len(brute.pieces(rows, PATH))
    check(got)


def test_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])
    bins = packing.pack(lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(10))
    assert len(bins) == 4 and all(lengths[b].sum() <= 10 for b in bins)
    poor = packing.Search([[0], [1], [2, 3], [4, 5], [6, 7], [8, 9]], lengths, 10)
    before = sum(f * f for f in poor.fill)
    poor.run()
    assert sum(f * f for f in poor.fill) > before and sum(1 for b in poor.bins if b) <= 5
    assert poor.fill.tolist() == [sum(lengths[i] for i in b) for b in poor.bins]


@pytest.mark.parametrize("seed", range(3))
def test_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(np.maximum(rng.lognormal(6, 1, 5000).astype(int), 2), 2048)
    bins = packing.pack(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(5000))
    assert len(bins) <= -(-lengths.sum() // 2048) * 1.003 + 1


def has_step(bins, lengths, capacity):
    """Whether any move, one-for-one or two-for-one exchange raises the sum of squared fills."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    for s, source in enumerate(bins):
        outs = [lengths[i] for i in source] + [lengths[i] + lengths[j] for i, j in itertools.combinations(source, 2)]
        for t, target in enumerate(bins):
            for out, back in itertools.product(outs, [0, *(lengths[j] for j in target)]):
                d = out - back
                if s != t and 0 < d <= capacity - fills[t] and d * (fills[t] - fills[s] + d) > 0:
                    return True
    return False


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25))
def test_no_step_is_left(lengths):
    sizes = np.array(lengths)
    search = packing.Search([[i] for i in range(len(sizes))], sizes, 30)
    search.run()
    assert sorted(i for b in search.bins for i in b) == list(range(len(sizes)))
    assert all(f <= 30 for f in search.fill)
    assert not has_step([b for b in search.bins if b], lengths, 30)


@pytest.mark.parametrize("seed", range(3))
def test_search_saves_sequences_where_best_fit_leaves_room(seed):
    lengths = np.random.default_rng(seed).integers(520, 1025, 3000)
    plain = len(packing.best_fit(lengths, 2048))
    assert len(packing.pack(lengths, 2048)) <= plain * 0.97


def test_empty(empty):
    assert packing.pack_documents(empty, PATH).count() == 0


def test_common_words_stay_known():
    """Words that every batch has are encoded once, however many others come and go; what is remembered is bounded."""
    encoder, made = packing.WordTokenizer(PATH, cache=200), collections.Counter()
    merged = encoder.merged
    encoder.merged = lambda word: made.update([word]) or merged(word)
    letters = [chr(97 + i) for i in range(26)]
    rare = iter(["qz" + "".join(x) for x in itertools.product(letters, repeat=3)])
    common = ["the" + a + b for a in "abcde" for b in "xyz"]
    for _ in range(40):
        encoder.encode([" ".join([*common, *(w.title() + "###" for w in common), *itertools.islice(rare, 40)])])
    assert all(made[w] == 1 for w in common)
    assert len(encoder.words) + len(encoder.words.before) <= 400


def test_closing_symbols():
    texts = ["word### (word) Word.*** it's#& ΟΔΟΣ, ΟΔΟΣ%% é*** naïve#. *** a*b 7## x<|endoftext|>## <|endoftext|>", "a.,;:!?#$%&*"]
    got = packing.WordTokenizer(PATH).encode(texts)
    whole = packing.WordTokenizer(PATH).tokenizer
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizer_goes_at_once():
    """A worker that lets its tokenizer go has its words' memory back without waiting for the garbage collector."""
    gc.disable()
    try:
        encoder = packing.WordTokenizer(PATH)
        encoder.encode(["some words. more Words!"])
        gone = weakref.ref(encoder)
        del encoder
        assert gone() is None
    finally:
        gc.enable()


def test_tokenizer_kept_over_tasks_outlives_its_methods():
    """Classes travel by value, so a later task puts new functions into the class of a tokenizer that a worker has kept."""
    def fresh():
        old = packing.WordTokenizer._ids
        return types.FunctionType(old.__code__, old.__globals__, "_ids")

    kind = type("Sent", (packing.WordTokenizer,), {"_ids": fresh()})
    encoder = kind(PATH)
    want = encoder.encode(["first words."])
    kind._ids = fresh()
    gc.collect()
    assert encoder.encode(["first words.", "other."]) == [*want, packing.WordTokenizer(PATH).encode(["other."])[0]]


@pytest.mark.parametrize("keep", [True, False])
def test_worker_holds_nothing_between_tasks(monkeypatch, keep):
    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, work, schema):
            self.work = work
            raise StopIteration

    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    docs, batch = Docs(), pa.record_batch([pa.array([1, 2]), pa.array(["a b", None])], ["doc_id", "text"])
    X.kept().clear()
    try:
        with pytest.raises(StopIteration):
            packing.pack_documents(docs, PATH, keep=keep)
        X.words(batch.column("text"))
        out = [r for b in docs.work(iter([batch])) for r in b.to_pylist()]
        assert sorted((r["doc_id"], r["length"]) for r in out) == [(1, 3), (2, 1)]
        assert set(X.kept()) == ({"powers", "tokenizers"} if keep else set())
    finally:
        X.kept().clear()
