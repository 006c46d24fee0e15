"""Language-model scores by a weighted backoff automaton over n-grams.

The model counts the n-grams of the training documents and smooths each order by the one below it:
``p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu)``, with h' the context h without its first word, and for single tokens
``p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))``. As an automaton: every counted context is a state, every counted n-gram an
arc ``log10 p``, and a state's failure arc ``log10(mu / (c(h) + mu))`` leads to the next shorter one when no arc has
the token. A text is scored in one walk from left to right, starting in the state of its begin mark: each token is read
by an arc of the carried state, or after as many failure arcs as it takes, and the weights on the way add up.

The automaton of a large corpus fits nowhere, so each block of documents gets the part that it needs, and counting
and asking are one exchange: a block sends its distinct n-grams, with their training counts, to the parts that own
their hashes; a part adds up and sends back the totals in the same order. The blocks are then formed once more from
the documents, meet their totals, build their automaton, and all documents of a block walk it at once. What is sent is in
proportion to the documents and the same for a frequent n-gram as for a rare one. Blocks are named by their content; the
documents must come in the same order in both passes, as they do from files (else the job stops with an error).

Null and empty texts are the end token alone. A document trains unless ``crc32(doc_id as text) mod folds`` is ``fold``;
a null id counts as empty text. Repeated rows all count. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalframe.llm import text as X
from thermalframe.llm.store import parts, written

BLOCK_TOKENS = 1_000_000        # tokens of one block, or one document
STRETCH = 512                   # tokens that one walk reads of a document
MU = 1000.0                     # weight of the shorter context
BEGIN, END = np.uint64(0xB0A7_0000_0000_0001), np.uint64(0xE0D0_0000_0000_0003)


def squeeze(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more as 4 bytes at the end."""
    large = counts[counts >= 255].astype(np.uint32)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.uint32, -1, n)
    return counts


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 64-bit values: width of a step, the first value, then the bytes of all steps, plane by plane."""
    if not len(h):
        return b""
    steps = np.diff(h).astype("<u8")
    width = (int(steps.max(initial=1)).bit_length() + 7) // 8
    return bytes([width]) + h[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(data, np.uint8, -1, 9).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :len(planes)] = planes.T
    return np.cumsum(np.append(np.frombuffer(data, np.uint64, 1, 1), steps.view("<u8")[:, 0]), dtype=np.uint64)


@dataclass
class Block:
    """Token hashes of some documents, each from its begin mark to its end token."""
    doc_ids: list
    held_out: np.ndarray
    first: np.ndarray           # begin mark of each document
    tokens: np.ndarray

    @property
    def name(self) -> int:
        where = zlib.crc32(repr(self.doc_ids).encode())
        return int((X.mix(self.tokens ^ np.arange(len(self.tokens), dtype=np.uint64)).sum() ^ np.uint64(where)).view(np.int64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k tokens up to each position."""
        if k == 1:
            return self.tokens
        total, factor = np.zeros(len(self.tokens), np.uint64), k
        for j in range(k):
            factor = factor * X.BASE % (1 << 64)
            total[j:] += self.tokens[:len(self.tokens) - j] * np.uint64(factor)
        return X.mix(total)

    @property
    def depth(self) -> np.ndarray:
        """Tokens of the same document before each position, the begin mark included."""
        size = np.diff(np.append(self.first, len(self.tokens)))
        return np.arange(len(self.tokens)) - np.repeat(self.first, size)


def blocks(batches: Iterator[pa.RecordBatch], folds: int, fold: int) -> Iterator[Block]:
    ids: list = []
    pieces: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    count = 0

    def out() -> Block:
        size = np.concatenate(sizes)
        held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids])
        return Block(ids, held, np.cumsum(size) - size, np.concatenate(pieces))

    for batch in X.slices(batches):
        w = X.words(batch.column("text"))
        size = w.counts + 2
        first = np.cumsum(size) - size
        tokens = np.empty(int(size.sum()), np.uint64)
        inner = np.ones(len(tokens), bool)
        tokens[first], tokens[first + size - 1] = BEGIN, END
        inner[first] = inner[first + size - 1] = False
        tokens[inner] = w.hash
        ids += batch.column("doc_id").to_pylist()
        pieces.append(tokens)
        sizes.append(size)
        count += len(tokens)
        if count >= BLOCK_TOKENS:
            yield out()
            ids, pieces, sizes, count = [], [], [], 0
    if ids:
        yield out()


def _distinct(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct k-grams, number of each valid position's k-gram, and the valid positions."""
    at = np.flatnonzero(block.depth >= k - 1).astype(np.int32)
    gram, inverse = np.unique(block.grams(k)[at], return_inverse=True)
    return gram, inverse.astype(np.int32), at


def _names(order: int) -> list[str]:
    return [f"{kind}{k}" for k in range(1, order + 1) for kind in ("gram", "count")]


def _ask(order: int, spread: int, folds: int, fold: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, folds, fold):
            name = block.name
            trains = np.repeat(~block.held_out, np.diff(np.append(block.first, len(block.tokens))))
            columns: list[list[bytes]] = []
            for k in range(1, order + 1):
                gram, inverse, at = _distinct(block, k)
                count = np.bincount(inverse, trains[at], len(gram)).astype(np.int64)
                cut = np.searchsorted(X.deal(gram, spread), np.arange(spread + 1))
                columns.append([pack_sorted(gram[a:b]) for a, b in zip(cut[:-1], cut[1:])])
                columns.append([squeeze(count[a:b]) for a, b in zip(cut[:-1], cut[1:])])
            yield pa.record_batch([pa.array(np.arange(spread, dtype=np.int32)), pa.array([name] * spread, pa.int64()),
                                   *map(X.binary, columns)], ["part", "block", *_names(order)])
    return ask


def _answer(order: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple] = []
        for batch in batches:
            asked += zip(*(c.to_pylist() for c in batch.columns))
        if not asked:
            return
        totals: list[list[bytes]] = []
        tokens = types = 0
        for k in range(order):
            grams = [unpack_sorted(r[2 + 2 * k]) for r in asked]
            counts = np.concatenate([unsqueeze(r[3 + 2 * k], len(g)) for r, g in zip(asked, grams)])
            gram, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(inverse, counts, len(gram)).astype(np.int64)
            if k == 0:
                real = gram != BEGIN
                tokens, types = int(total[real].sum()), int((total[real] > 0).sum())
            ends = np.cumsum([len(g) for g in grams])
            totals.append([squeeze(x) for x in np.split(total[inverse], ends[:-1])])
        n = len(asked)
        yield pa.record_batch([pa.array([r[1] for r in asked], pa.int64()), pa.array([r[0] for r in asked], pa.int32()),
                               *map(X.binary, totals), pa.array([tokens] + [0] * (n - 1), pa.int64()),
                               pa.array([types] + [0] * (n - 1), pa.int64())],
                              ["block", "part", *(f"total{k}" for k in range(1, order + 1)), "tokens", "types"])
    return answer


def _pack_block(order: int, folds: int, fold: int):
    """Blocks for the second exchange: documents, distinct tokens and each position's token."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, folds, fold):
            vocabulary, number = np.unique(b.tokens, return_inverse=True)
            planes = number.astype("<u4").view(np.uint8).reshape(-1, 4).T[:4 if len(vocabulary) > 1 << 24 else 3]
            yield pa.record_batch(
                [pa.array([b.name], pa.int64()), pa.array([-1], pa.int32()), X.binary([vocabulary.tobytes()]),
                 X.binary([np.ascontiguousarray(planes).tobytes()]), pa.array([b.doc_ids], pa.list_(pa.int64())),
                 X.binary([b.first.astype(np.int64).tobytes()]), *([pa.nulls(1, pa.binary())] * order)],
                ["block", "part", "vocabulary", "numbers", "doc_ids", "first", *(f"total{k}" for k in range(1, order + 1))])
    return pack


class Automaton:
    """The part of the model that a block meets, as states joined by arcs and failure arcs.

    State 0 is the empty context and has an arc for every token of the block. Every other counted context of up to
    ``order - 1`` tokens is a state; its arcs are the counted n-grams that begin with it, sorted by (state, token).
    ``totals`` gives the training counts of the block's sorted distinct k-grams.
    """

    def __init__(self, block: Block, totals: Callable[[int, np.ndarray], np.ndarray], order: int, tokens: int, types: int,
                 mu: float) -> None:
        self.block, self.order = block, order
        fail_to, fail_weight = [np.zeros(1, np.int32)], [np.zeros(1)]
        arc, arc_weight, arc_to = [], [], []
        number = count = p = state = None
        n_states = 1
        for k in range(1, order + 1):
            gram, inverse, at = _distinct(block, k)
            total = totals(k, gram)
            last = np.zeros(len(gram), np.int32)                # a position where the n-gram ends
            last[inverse] = at
            counted = np.flatnonzero(total > 0).astype(np.int32)
            shorter = (number, count, p, state)
            if k < order:
                number = np.full(len(block.tokens), -1, np.int32)   # of the n-gram that ends at each position
                number[at] = inverse
            elif k == 1:
                number = inverse
            count, state = total, np.zeros(len(gram), np.int32)
            del inverse, at
            if k < self.order:
                state[counted] = n_states + np.arange(len(counted))
                n_states += len(counted)
                fail_weight.append(np.log10(mu / (total[counted] + mu)))
            if k == 1:
                self.word, self.n_words = number, len(gram)
                p = (total + 0.5) / (tokens + 0.5 * (types + 1))
                self.known, self.root_weight, self.root_to = total > 0, np.log10(p), state
                if self.order > 1:
                    fail_to.append(np.zeros(len(counted), np.int32))
                continue
            number_1, count_1, p_1, state_1 = shorter
            here = last[counted]
            context, suffix = number_1[here - 1], number_1[here]    # both are counted if the n-gram is
            p = np.zeros(len(gram))
            p[counted] = (total[counted] + mu * p_1[suffix]) / (count_1[context] + mu)
            arc.append(state_1[context].astype(np.int64) * self.n_words + self.word[here])
            arc_weight.append(np.log10(p[counted]))
            arc_to.append(state[counted] if k < self.order else state_1[suffix])
            if k < self.order:
                fail_to.append(state_1[suffix])
        self.fail_to, self.fail_weight = np.concatenate(fail_to), np.concatenate(fail_weight)
        self.arc = np.concatenate([*arc, [np.iinfo(np.int64).max]])     # the last one is beyond all others and never asked for
        by = np.argsort(self.arc)
        self.arc = self.arc[by]
        self.arc_weight = np.concatenate([*arc_weight, [0.0]])[by]
        self.arc_to = np.concatenate([*arc_to, np.zeros(1, np.int32)])[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and weight of each walk that reads ``word`` in ``state``, failure arcs included."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int32)
        open_ = np.arange(len(state))                           # walks that have not read their token yet
        while len(open_):
            s, w = state[open_], word[open_]
            root = s == 0
            done = open_[root]
            weight[done] += self.root_weight[w[root]]
            to[done] = self.root_to[w[root]]
            open_, s, w = open_[~root], s[~root], w[~root]
            key = s.astype(np.int64) * self.n_words + w
            place = np.searchsorted(self.arc, key)
            hit = self.arc[place] == key
            done, place = open_[hit], place[hit]
            weight[done] += self.arc_weight[place]
            to[done] = self.arc_to[place]
            open_, s = open_[~hit], s[~hit]
            weight[open_] += self.fail_weight[s]
            state[open_] = self.fail_to[s]
        return to, weight

    def walk(self) -> np.ndarray:
        """log10 probability of each document: the weights on its way from the state of its begin mark to its end token.

        All documents walk at once, a token a step. Long ones walk in stretches of ``STRETCH`` tokens; a later stretch
        starts in state 0 ``order - 1`` tokens early, which leads to the state that the one before it ends in.
        """
        first = self.block.first
        size = np.diff(np.append(first, len(self.block.tokens))) - 1        # without the begin mark
        pieces = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(first)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[doc] + 1 + piece * STRETCH
        stop = np.minimum(start + STRETCH, first[doc] + 1 + size[doc])
        early = np.where(piece > 0, self.order - 1, 0)
        state = np.where(piece > 0, 0, self.root_to[self.word[first[doc]]])
        by = np.argsort(-(stop - start + early), kind="stable")
        at, early, state = (start - early)[by], early[by], state[by]
        steps = (stop - start + np.where(piece > 0, self.order - 1, 0))[by]
        total = np.zeros(len(doc))
        walking = len(doc)
        for j in range(int(steps[0]) if len(steps) else 0):
            walking = int(np.searchsorted(-steps[:walking], -j))            # those with more than j steps come first
            to, weight = self.step(state[:walking], self.word[at[:walking] + j])
            state[:walking] = to
            total[:walking] += np.where(early[:walking] <= j, weight, 0)
        return np.bincount(doc[by], total, len(first))

    def scores(self) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each document."""
        first = self.block.first
        token = np.ones(len(self.block.tokens), bool)
        token[first] = False                                    # the begin mark is no token
        add = lambda x: np.add.reduceat(np.where(token, x[self.word], 0), first)
        return (add(np.ones(self.n_words, np.int64)), add(self.known.astype(np.int64)), add(self.root_weight), self.walk())


def _score(order: int, tokens: int, types: int, mu: float, folds: int, fold: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, totals = None, [], []

        def total(k: int, gram: np.ndarray) -> np.ndarray:
            if not totals:
                raise RuntimeError("the documents came in another order in the second pass")
            cut = np.bincount(X.deal(gram, len(totals)), minlength=len(totals)).tolist()
            return np.concatenate([unsqueeze(t[k - 1], c) for t, c in zip(totals, cut)])

        def finish() -> Iterator[pa.RecordBatch]:
            for vocabulary, numbers, ids, first in waiting:
                hashes, first = np.frombuffer(vocabulary, np.uint64), np.frombuffer(first, np.int64)
                planes = np.frombuffer(numbers, np.uint8).reshape(4 if len(hashes) > 1 << 24 else 3, -1)
                number = np.zeros((planes.shape[1], 4), np.uint8)
                number[:, :len(planes)] = planes.T
                held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids])
                block = Block(ids, held, first, hashes[number.view("<u4")[:, 0]])
                n_tokens, known, base, value = Automaton(block, total, order, tokens, types, mu).scores()
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held), pa.array(n_tokens), pa.array(known),
                                       pa.array([tokens] * len(ids), pa.int64()), pa.array(base), pa.array(value)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "part", "vocabulary", "numbers", "doc_ids", "first")]
            for i, (name, part, *body) in enumerate(zip(*columns)):
                if name != at:
                    yield from finish()
                    at, waiting, totals = name, [], []
                if part < 0:
                    waiting.append(body)
                elif part == len(totals):              # equal blocks have equal totals
                    totals.append([batch.column(f"total{k}")[i].as_py() for k in range(1, order + 1)])
        yield from finish()
    return score


def score_documents(docs: DataFrame, order: int = 3, mu: float = MU, folds: int = 5, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10."""
    n_parts = parts(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    spread = 4 * n_parts
    kinds = ", ".join(f"{n} binary" for n in _names(order))
    asked = rows.mapInArrow(_ask(order, spread, folds, fold), f"part int, block long, {kinds}")
    totals = ", ".join(f"total{k} binary" for k in range(1, order + 1))
    answers = written(asked.repartition(n_parts, "part").mapInArrow(
        _answer(order), f"block long, part int, {totals}, tokens long, types long"), "totals")
    sums = answers.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = (int(x or 0) for x in sums)
    body = "block long, part int, vocabulary binary, numbers binary, doc_ids array<long>, first binary, " + totals
    packed = rows.mapInArrow(_pack_block(order, folds, fold), body)
    both = packed.unionByName(answers.drop("tokens", "types"), allowMissingColumns=True)
    return (both.repartition(n_parts, "block").sortWithinPartitions("block", "part")
            .mapInArrow(_score(order, tokens, types, mu, folds, fold),
                        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
