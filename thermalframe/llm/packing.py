"""Best-fit packing of tokenized documents by swap-based local search.

A document is its token ids and an end id; one longer than a sequence is cut into pieces of full length, the last
may be shorter. A task packs the pieces of a window of its documents: best fit by falling length, then a local search
among underfull bins. It moves a document, exchanges one for one, or two for one, whenever that raises the sum of
squared fills, so that the emptiest bins lose what they hold until they are empty. Bins that stay below ``CLOSED`` of
the capacity are opened again and their pieces packed anew with those of the other windows.

Ids are packed where they are made: only the few open pieces are read again, and no id is shuffled. A window bounds
what a task holds (one document longer than it is held whole).

Null and empty texts are one piece with the end id alone. Every row is packed for itself, repeated rows and null ids
included. Only ``doc_id`` and ``text`` are read. No rows give no rows.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import weakref
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalframe.llm import text as X
from thermalframe.llm.store import written

WINDOW = 6_000_000          # token ids packed together
CLOSED = 0.995              # fill from which a bin is left as it is
CACHE_WORDS = 400_000       # words whose ids a worker remembers, and as many of those before

_blank = re.compile(r"[\t-\r ]+")
_control = re.compile(r"[\x1c-\x1f]")
PUNCTUATION = ".,;:!?#$%&*"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class WordIds(dict):
    """Ids of words, made when first asked for. Beyond ``cache`` words those not asked for since the last time go."""

    def __init__(self, owner: WordTokenizer, cache: int) -> None:
        super().__init__()
        self.owner, self.cache = weakref.ref(owner), cache      # no cycle: all words go with the owner at once
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.owner()._ids(word)
        if len(self) >= self.cache:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file that lower-cases, drops white space and encodes words by bytes.

    A text's ids are those of its words, so each distinct word is encoded once. A word of letters, but for closing
    punctuation, is one entry for the vocabulary's merges and is looked up apart from the punctuation; any
    other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        letters = byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.words = WordIds(self, cache)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _ids(self, word: str) -> bytes:
        """Ids of letters apart from those of closing punctuation, unless lower case or composition changes more than letters."""
        stem = word.rstrip(PUNCTUATION)
        if not stem.isalpha():
            return self._whole(word)
        if stem.isascii():
            known = plain = stem.lower()
        else:
            known, plain = stem, unicodedata.normalize("NFC", stem)
            if "Σ" in plain or not (plain := plain.lower()).isalpha():
                return self._whole(word)
            plain = codecs.charmap_decode(plain.encode(), "strict", self.letters)[0]
        if known == word:
            return array("I", [t.id for t in self.merged(plain)]).tobytes()
        ids = self.words[known]
        return ids + self.words[word[len(stem):]] if len(stem) < len(word) else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian uint32."""
        split = [[w for w in _blank.split(t) if w] if _control.search(t) else t.split() for t in texts]
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def tokenizer(path: str, cache: int) -> WordTokenizer:
    """The worker's tokenizer of this file, with the words that it knows by now."""
    known = X.kept().setdefault("tokenizers", {})
    if (path, cache) not in known:
        known[path, cache] = WordTokenizer(path, cache)
    return known[path, cache]


# --- packing ---------------------------------------------------------------

def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: by falling length, each piece goes where least room is left."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0                                        # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - need].append(b)
        rooms |= 1 << (room - need)
    return bins


class Search:
    """Underfull bins under moves and exchanges that raise the sum of squared fills.

    A step takes one or two pieces out of a source and puts one piece of the target, or none, back. All underfull bins
    are targets, all pieces and pairs of the source are tried against all their pieces at once, and the step of
    largest gain is made. Every step raises an integer sum that is bounded, so the search ends; it ends only when no
    underfull bin has a step left.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
        self.size, self.capacity, self.bins = np.asarray(lengths, np.int64), capacity, bins
        self.fill = np.array([self.size[b].sum() for b in bins], np.int64)
        self.open = [b for b, f in enumerate(self.fill.tolist()) if f < capacity]
        inside = np.array([i for b in self.open for i in bins[b]], np.int64)
        home = np.array([b for b in self.open for _ in bins[b]], np.int64)
        # one slot a piece, and one empty slot a bin (size 0), which stands for a move
        self.piece = np.r_[inside, np.full(len(self.open), -1)]
        self.owner = np.r_[home, np.array(self.open, np.int64)]
        self.held = np.r_[self.size[inside], np.zeros(len(self.open), np.int64)]
        self.slot = dict(zip(inside.tolist(), range(len(inside))))

    def improve(self, source: int) -> bool:
        """The best step that takes tokens from ``source`` to a bin which it leaves fuller than the source was."""
        sizes: dict[int, list[int]] = {}
        for i in self.bins[source]:
            sizes.setdefault(int(self.size[i]), []).append(i)
        outs: dict[int, list[int]] = {}                     # tokens out -> pieces out, single pieces first
        for x, same in sizes.items():
            outs[x] = same[:1]
        distinct = list(sizes)
        for k, x in enumerate(distinct):
            if len(sizes[x]) > 1:
                outs.setdefault(2 * x, sizes[x][:2])
            for y in distinct[k + 1:]:
                outs.setdefault(x + y, [sizes[x][0], sizes[y][0]])
        fill = self.fill[self.owner]
        room, edge = self.capacity - fill, fill - self.fill[source]
        room[self.owner == source] = 0
        totals = np.array(list(outs), np.int64)
        best, step = 0, None
        rows = max(1, (1 << 20) // len(self.held))
        for at in range(0, len(totals), rows):
            moved = totals[at:at + rows, None] - self.held
            gain = np.where((moved > 0) & (moved <= room), moved * (edge + moved), 0)
            top = int(gain.argmax())
            if gain.flat[top] > best:
                best, step = gain.flat[top], (int(totals[at + top // len(self.held)]), top % len(self.held))
        if step is None:
            return False
        total, slot = step
        target, back, out = int(self.owner[slot]), int(self.piece[slot]), outs[total]
        self._hand_over(out, source, target)
        if back >= 0:
            self._hand_over([back], target, source)
        return True

    def _hand_over(self, pieces: list[int], source: int, target: int) -> None:
        for i in pieces:
            self.bins[source].remove(i)
            self.bins[target].append(i)
            self.owner[self.slot[i]] = target
        moved = self.size[pieces].sum()
        self.fill[source] -= moved
        self.fill[target] += moved

    def run(self) -> None:
        """Drains the emptiest bins first, over and over, until no underfull bin has a step."""
        again = len(self.open) > 1
        while again:
            again = False
            for b in sorted(self.open, key=lambda b: (self.fill[b], b)):
                while self.bins[b] and self.improve(b):
                    again = True
            gone = {b for b in self.open if not self.bins[b]}
            if gone:                                        # an emptied bin is no target any more
                self.open = [b for b in self.open if b not in gone]
                stay = ~np.isin(self.owner, list(gone))
                self.piece, self.owner, self.held = self.piece[stay], self.owner[stay], self.held[stay]
                self.slot = {i: at for at, i in enumerate(self.piece.tolist()) if i >= 0}


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Non-empty bins of piece numbers, each of at most ``capacity`` tokens."""
    search = Search(best_fit(lengths, capacity), lengths, capacity)
    search.run()
    return [b for b in search.bins if b]


PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _packed(pieces: list[tuple], capacity: int, least: float, number: Iterator[int]) -> Iterator[pa.RecordBatch]:
    """Pieces (doc, piece, start, ids) with their places; of a bin filled below ``least`` with none."""
    lengths = np.array([len(p[3]) // 4 for p in pieces], np.int64)
    rows = []
    for b in pack(lengths, capacity):
        closed = lengths[b].sum() >= least
        sequence, offset = next(number) if closed else None, 0
        for i in b:
            doc, piece, start, ids = pieces[i]
            rows.append((doc, piece, start, int(lengths[i]), ids, sequence, offset if closed else None))
            offset += int(lengths[i])
    for k in range(0, len(rows), 2000):
        yield pa.record_batch([pa.array([r[i] for r in rows[k:k + 2000]], t) for i, t in enumerate(_TYPES)], _NAMES)


def _numbers(base: int) -> Iterator[int]:
    first = (TaskContext.get().partitionId() << 32) * 2 + base
    return iter(range(first, first + (1 << 33), 2))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cache: int = CACHE_WORDS,
                   keep: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece; ids are little-endian uint32.

    ``cache`` bounds the words whose ids a worker remembers: fewer take less memory and more time. Without ``keep`` a
    task lets go what a worker holds, other operators' tables before it and its own words after it, so that workers that wait hold nothing.
    """
    step, end = 4 * capacity, np.array([end_id], np.uint32).tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            X.kept().clear()
        yield from windows(batches)
        if not keep:
            X.kept().clear()
        X.give_back()                       # what the windows held

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, held, count = tokenizer(tokenizer_path, cache), _numbers(0), [], 0
        for batch in X.slices(batches, keep="tokenizers"):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), ids):
                tokens += end
                held += [(doc, k, k * capacity, tokens[a:a + step]) for k, a in enumerate(range(0, len(tokens), step))]
                count += len(tokens) // 4
            if count >= WINDOW:
                yield from _packed(held, capacity, CLOSED * capacity, number)
                held, count = [], 0
        yield from _packed(held, capacity, CLOSED * capacity, number)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from open_windows(batches)
        X.give_back()

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = _numbers(1), [], 0
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids"))))
            held += rows
            count += sum(len(r[3]) for r in rows) // 4
            if count >= WINDOW:
                yield from _packed(held, capacity, 0, number)
                held, count = [], 0
        yield from _packed(held, capacity, 0, number)

    first = written(docs.select("doc_id", "text").mapInArrow(make, PIECES), "pieces")
    left = first.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    return first.where("sequence_id is not null").union(left.coalesce(max(1, -(-tokens // WINDOW))).mapInArrow(again, PIECES))
