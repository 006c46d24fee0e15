"""Quality rules as a short-circuit cascade.

Each rule rejects a text by a few counts. The counts that the caller wants for every text are made once and shared; some
rules need no others, some make counts of their own (most frequent word, bullets, ellipses, words with a letter). A bounded
sample gives every rule's cost on top of the shared counts and the share that it rejects; the cascade then asks the rules
in order of rejections per cost, and a text that one of them rejects is asked no more. Words found once are kept through
the cascade. The order changes the work, never the verdict, so a noisy sample is harmless.

A null or empty text has no words and fails the rule on length. Only ``doc_id`` and ``text`` are read; every row gets
its own verdict, repeated rows included.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalframe.llm import text as X

SAMPLE_ROWS = 512           # texts on which costs and selectivities are measured
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_bullet = re.compile(rb"^[ \t\x0b\x0c\r]*(?:[-*]|\xe2\x80\xa2)", re.MULTILINE)
_ellipsis = re.compile(rb"(?:\.\.\.|\xe2\x80\xa6)[ \t\x0b\x0c\r]*$", re.MULTILINE)


class Counts:
    """Counts of a slice of texts, each made when first asked for."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column
        self.made: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = getattr(type(self), f"_{name}")(self)
        return self.made[name]

    def of(self, keep: np.ndarray) -> Counts:
        """The counts and words of some of the texts."""
        out = Counts(self.column.filter(pa.array(keep)))
        out.made = {k: v[keep] for k, v in self.made.items() if k.startswith("n_") or k in ("word_chars", "texts")}
        if "words" in self.made and not keep.all():
            w, sizes = self.words, self.words.counts
            mine = np.repeat(keep, sizes)
            moved = np.repeat(self.limits[:-1][keep] - out.limits[:-1], sizes[keep])
            first = np.concatenate([[0], np.cumsum(sizes[keep])])
            out.made["words"] = X.Words(X.flat(out.column)[0], w.start[mine] - moved, w.end[mine] - moved, first, w.hash[mine])
        elif "words" in self.made:
            out.made["words"] = self.words
        return out

    def _words(self) -> X.Words:
        return X.words(self.column, fold=False)

    def _texts(self) -> np.ndarray:
        out = np.empty(len(self.column), object)
        out[:] = [t or b"" for t in self.column.cast(pa.large_binary()).to_pylist()]
        return out

    def _limits(self) -> np.ndarray:
        return X.flat(self.column)[1]

    def _per_text(self, flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[self.limits[1:]] - total[self.limits[:-1]]

    def _n_words(self) -> np.ndarray:
        return self.words.counts

    def _word_chars(self) -> np.ndarray:
        data = self.words.data
        return self._per_text(((data & 0xC0) != 0x80) & ~X._space[data])

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(_symbol[self.words.data])

    def _n_lines(self) -> np.ndarray:
        return self._per_text(self.words.data == 10) + 1

    def _n_dup_lines(self) -> np.ndarray:
        return np.array([repeated_lines(t) for t in self.texts], np.int64)

    def _n_bullets(self) -> np.ndarray:
        """Lines that begin with a bullet."""
        return np.array([len(_bullet.findall(t)) for t in self.texts], np.int64)

    def _n_ellipses(self) -> np.ndarray:
        """Lines that end in an ellipsis."""
        return np.array([len(_ellipsis.findall(t)) for t in self.texts], np.int64)

    def _n_top_word(self) -> np.ndarray:
        """Occurrences of the text's most frequent word."""
        w = self.words
        return np.array([np.unique(w.hash[a:b], return_counts=True)[1].max(initial=0)
                         for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())], np.int64)

    def _n_repeat_words(self) -> np.ndarray:
        w = self.words
        hashes = X.shingle_hashes(w, WINDOW)
        return np.array([repeated_words(hashes[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())], np.int64)

    def _n_wordlike(self) -> np.ndarray:
        """Words with a letter or a digit."""
        w = self.words
        total = np.concatenate([[0], np.cumsum(_letter[w.data] | _digit[w.data])])
        seen = np.concatenate([[0], np.cumsum(total[w.end] > total[w.start])])
        return seen[w.first[1:]] - seen[w.first[:-1]]


def repeated_lines(text: bytes | None) -> int:
    lines = [x for x in (text or b"").split(b"\n") if x.strip(X.WHITE)]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray) -> int:
    """Words that stand in a window which occurs twice or more in the text."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    _, inverse, count = np.unique(hashes[:n], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    edge = np.zeros(n + WINDOW, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


Rule = Callable[[Counts], np.ndarray]
#: Conditions under which a text is rejected; whole numbers, so that SQL can say the same.
RULES: dict[str, Rule] = {
    "few_words": lambda c: c.n_words < 20,
    "repeated_words": lambda c: 100 * c.n_repeat_words > 30 * c.n_words,
    "symbols": lambda c: 100 * c.n_symbols > 15 * c.n_words,
    "long_words": lambda c: c.word_chars > 15 * c.n_words,
    "short_words": lambda c: 2 * c.word_chars < 3 * c.n_words,
    "repeated_lines": lambda c: 100 * c.n_dup_lines > 50 * c.n_lines,
    "no_words": lambda c: 2 * c.n_wordlike < c.n_words,
    "one_word": lambda c: 100 * c.n_top_word > 30 * c.n_words,
    "bullet_lines": lambda c: 100 * c.n_bullets > 90 * c.n_lines,
    "ellipsis_lines": lambda c: 100 * c.n_ellipses > 30 * c.n_lines,
}
BASE = ("few_words", "repeated_words")
#: Counts that every text gets, whatever its verdict.
SHARED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, rules: dict[str, Rule], rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per cost, from at most ``rows`` texts; only sums reach the driver.

    The cost is what a rule adds to the counts that are made for every text anyway.
    """
    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            shared = Counts(batch.column("text"))
            for name in SHARED:
                getattr(shared, name)
            everything = np.ones(batch.num_rows, bool)
            for name, rule in rules.items():
                counts = shared.of(everything)
                began = time.perf_counter_ns()
                rejected = int(rule(counts).sum())
                yield pa.record_batch([pa.array([name]), pa.array([rejected], pa.int64()),
                                       pa.array([time.perf_counter_ns() - began], pa.int64())], ["rule", "rejected", "cost"])

    sample = docs.select("text").limit(rows).mapInArrow(timed, "rule string, rejected long, cost long")
    sums = {r["rule"]: (r["rejected"], r["cost"]) for r in
            sample.groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("cost").alias("cost")).collect()}
    return sorted(rules, key=lambda n: -(sums[n][0] + 0.5) / max(1, sums[n][1]) if n in sums else 0)


def cascade(counts: Counts, rules: dict[str, Rule], order: list[str], asked: dict[str, int] | None = None) -> np.ndarray:
    """Rows of the texts that every rule lets pass. Later rules see only what is left; ``asked`` counts their texts."""
    left = np.arange(len(counts.column))
    for name in order:
        if asked is not None:
            asked[name] = asked.get(name, 0) + len(left)
        keep = ~rules[name](counts)
        if keep.all():
            continue
        left, counts = left[keep], counts.of(keep)
        if not len(left):
            break
    return left


def judged(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    rules = RULES if rules is None else rules
    order = measure(docs, rules, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            counts = Counts(batch.column("text"))
            base = [getattr(counts, n).astype(np.int64) for n in SHARED]
            failed = np.any([rules[n](counts) for n in BASE if n in rules], axis=0) if any(n in rules for n in BASE) \
                else np.zeros(batch.num_rows, bool)
            kept = np.zeros(batch.num_rows, bool)
            kept[cascade(counts, rules, order)] = True
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *map(pa.array, base), pa.array(failed), pa.array(kept)],
                                  ["doc_id", *SHARED, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(
        judge, "doc_id long, " + ", ".join(f"{n} long" for n in SHARED) + ", base_failed boolean, kept boolean")
