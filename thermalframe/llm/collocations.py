"""Phrases of words that keep company, from stripes: every prefix keys an associative counter of its next words.

Level by level, from pairs on, a task slides over its pieces and adds each word to the stripe of the words before it. Stripes
of a task are dealt to parts and merged there elementwise. One merged stripe of a prefix holds all its extensions with their
counts; the total of the phrase itself is an entry of the stripe one level down, and the largest entry is what a longer phrase keeps of
it (subsumption). A next word is written as the suffix it makes with the prefix's other words, so that an entry also says which
shorter phrase ends there: the same entries, keyed by that suffix, give the maxima to the left.

A stripe is cut by its entries, not dealt whole: a prefix that starts a third of all phrases is spread over all parts.
Only entries of two frequent halves are sent. Which phrases are frequent is told to the tasks by a bit table over their 64-bit names,
of 32 bits a phrase and a fixed most, whatever the corpus holds: a name that falls on a used bit is counted in
vain and dropped by its exact count, so the table's size never changes a result. Words are counted by their letters;
longer phrases are named by hashes of their two halves.

Texts are split into pieces and these into words; nothing crosses a piece. A-Z are lower-cased. Null and empty texts have no word, a
null language is ``und``. Repeated rows all count. Only ``lang`` and ``text`` are read. An empty table gives no phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalframe.llm import text as X
from thermalframe.llm.store import bit_table, forget, on_used_bits, parts, written

BLANK = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
BLOCK_ENTRIES = 2_000_000       # stripe entries that a task merges before it sends them
PART_WORDS = 8_000_000          # words of the corpus for one part, so a part's entries are bounded
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

_breaks = np.zeros(256, bool)
_breaks[list(BREAKS)] = True


def _lang_names(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Languages of a slice, and each row's place in them."""
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _names(batch: pa.RecordBatch) -> tuple[X.Words, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words, languages, each word's language, its 64-bit name, and whether the next word is in the same piece."""
    w = X.words(batch.column("text"), between=BLANK + BREAKS)
    langs, lang = _lang_names(batch.column("lang"))
    seeds = X.mix(np.array([hash_text(x) for x in langs], np.uint64))
    of_word = np.repeat(lang, w.counts)
    name = X.mix(w.hash ^ seeds[of_word]) if len(w.hash) else w.hash
    cuts = np.r_[0, np.cumsum(_breaks[w.data])]
    near = np.zeros(len(w.start), bool)
    near[:-1] = cuts[w.start[1:]] == cuts[w.end[:-1]]
    near[w.first[1:][w.first[1:] > 0] - 1] = False
    return w, langs, of_word, name, near


def hash_text(text: str) -> int:
    """A 64-bit checksum that does not change between processes."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def name_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of a phrase from the names of it without its last and without its first word."""
    return X.mix(left * _LEFT + X.mix(right * _RIGHT))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, name, n) of a task's distinct words; the word is null in one row for all words of a language."""
    known, counts, spelt, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], {}

    def send() -> Iterator[pa.RecordBatch]:
        for lang, word, name in spelt:
            n = counts[np.searchsorted(known, name)]
            yield pa.record_batch([lang, word, pa.array(name.view(np.int64)), pa.array(n)], ["lang", "word", "name", "n"])
        rows = list(totals.items())
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.nulls(len(rows), pa.string()),
                               pa.array([0] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                              ["lang", "word", "name", "n"])

    for batch in X.slices(batches):
        w, langs, of_word, name, _ = _names(batch)
        for lang, n in zip(langs, np.bincount(of_word, minlength=len(langs)).tolist()):
            totals[lang] = totals.get(lang, 0) + n
        own, at, n = np.unique(name, return_index=True, return_counts=True)
        place = np.searchsorted(known, own)
        old = np.zeros(len(own), bool)
        inside = place < len(known)
        old[inside] = known[place[inside]] == own[inside]
        counts[place[old]] += n[old]
        own, at, n = own[~old], at[~old], n[~old]
        size = w.end[at] - w.start[at]
        limits = np.r_[0, np.cumsum(size)]
        letters = w.data[np.repeat(w.start[at] - limits[:-1], size) + np.arange(limits[-1])]
        words = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(letters)])
        spelt.append((pa.array(langs, pa.string()).take(pa.array(of_word[at])), words.cast(pa.string()), own))
        sort = np.argsort(np.r_[known, own], kind="stable")
        known, counts = np.r_[known, own][sort], np.r_[counts, n][sort]
        if len(known) >= BLOCK_ENTRIES:
            yield from send()
            known, counts, spelt, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], {}
    yield from send()


def merged(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of equal halves added up, in the order of their names: name, left, right, n."""
    name = name_of(left, right)
    sort = np.argsort(name, kind="stable")
    clash = (name[sort][1:] == name[sort][:-1]) & ((left[sort][1:] != left[sort][:-1]) | (right[sort][1:] != right[sort][:-1]))
    if clash.any():                                    # two phrases of one name: never added to each other
        sort = np.lexsort((right, left, name))
    name, left, right, n = name[sort], left[sort], right[sort], n[sort]
    new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])][:len(name)])
    return name[new], left[new], right[new], np.add.reduceat(n, new) if len(new) else n


def pack_stripes(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> bytes:
    """Stripes as bytes: prefixes, entries of each, then all entries and their counts."""
    sort = np.argsort(left, kind="stable")
    left, right, n = left[sort], right[sort], n[sort]
    new = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
    sizes = np.diff(np.r_[new, len(left)])
    return b"".join((np.array([len(new), len(left)], np.int64).tobytes(), left[new].tobytes(), sizes.astype(np.uint32).tobytes(),
                     right.tobytes(), n.astype(np.uint32).tobytes()))


def unpack_stripes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    prefixes, entries = np.frombuffer(data, np.int64, 2).tolist()
    at = 16
    left = np.frombuffer(data, np.uint64, prefixes, at)
    at += 8 * prefixes
    sizes = np.frombuffer(data, np.uint32, prefixes, at)
    at += 4 * prefixes
    right = np.frombuffer(data, np.uint64, entries, at)
    return np.repeat(left, sizes), right, np.frombuffer(data, np.uint32, entries, at + 8 * entries).astype(np.int64)


def _send_stripes(level: int, frequent, n_parts: int):
    """Stripes of phrases of ``level`` words, whose halves are on used bits of ``frequent``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            name, left, right, n = merged(*(np.concatenate(c) for c in zip(*held)))
            cut = np.searchsorted(X.deal(name, n_parts), np.arange(n_parts + 1))
            for part in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[part], cut[part + 1])
                yield pa.record_batch([pa.array([part], pa.int32()), X.binary([pack_stripes(left[own], right[own], n[own])])],
                                      ["part", "stripes"])

        size = 0
        for batch in X.slices(batches):
            *_, name, near = _names(batch)
            ok = near.copy()
            for _ in range(level - 2):                 # names of level - 1 words from each place on
                name[:-1] = name_of(name[:-1], name[1:])
                ok[:-1] &= near[1:]
                near = np.r_[near[1:], False]
            used = on_used_bits(name, frequent.value)
            ok[:-1] &= used[:-1] & used[1:]
            at = np.flatnonzero(ok[:-1])
            if len(at):
                held.append((name[at], name[at + 1], np.ones(len(at), np.int64)))
                size += len(at)
            if size >= BLOCK_ENTRIES:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()
    return work


def _merge_stripes(least: int):
    """(name, prefix, suffix, n) of the phrases of a part found at least ``least`` times."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[np.ndarray, ...] | None = None
        held, size = [], 0

        def add() -> tuple[np.ndarray, ...]:
            return merged(*(np.concatenate(c) for c in zip(*([total[1:]] if total else []), *held)))

        for batch in batches:
            for data in batch.column("stripes").to_pylist():
                held.append(unpack_stripes(data))
                size += len(held[-1][0])
            if size >= 2 * BLOCK_ENTRIES:
                total, held, size = add(), [], 0
        if held:
            total = add()
        if total:
            keep = total[3] >= least
            yield pa.record_batch([pa.array(c[keep].view(np.int64)) for c in total], ["name", "prefix", "suffix", "n"])
    return work


def _lowest_cut(level: int) -> Column:
    """(score, k, l, r) of the cut with the lowest score, the first of equals; whole-number arithmetic of up to 38 digits."""
    def exact(c: str) -> str:
        return f"cast({c} as decimal(19,0))"

    return F.array_min(F.array(*[F.struct(
        F.expr(f"(cast(1000 as decimal(4,0)) * {exact('a')} * {exact('n')}) div ({exact(f'before[{k - 1}]')} * {exact(f'after[{k - 1}]')})")
        .alias("score"), F.lit(k).alias("k"), F.col("before")[k - 1].alias("l"), F.col("after")[k - 1].alias("r")) for k in range(1, level)]))


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = 100) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and for each length from 1 the phrases (lang, phrase, last, name, a, before, after)
    found at least ``least`` times, with the counts of what each cut leaves before and after it, written."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = rows.mapInArrow(_count_words, "lang string, word string, name long, n long").groupBy("lang", "word").agg(
        F.max("name").alias("name"), F.sum("n").alias("n"))
    words = written(words.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = words.where("word is null").select("lang", "n")
    none = F.array().cast("array<long>")
    levels = [words.where("word is not null").select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "name",
                                                     F.col("n").alias("a"), none.alias("before"), none.alias("after"))]
    size = totals.agg(F.sum("n")).first()[0] or 0
    n_parts = max(parts(spark), -(-size // PART_WORDS))
    for level in range(2, longest + 1):
        shorter = levels[-1]
        frequent = spark.sparkContext.broadcast(bit_table(shorter.select("name")))
        stripes = rows.mapInArrow(_send_stripes(level, frequent, n_parts), "part int, stripes binary")
        found = written(stripes.repartitionById(n_parts, F.col("part")).mapInArrow(
            _merge_stripes(least), "name long, prefix long, suffix long, n long"), f"stripes-{level}")
        frequent.destroy()
        head = shorter.select(F.col("name").alias("prefix"), "lang", "phrase", "before", F.col("a").alias("head"))
        tail = shorter.select(F.col("name").alias("suffix"), "last", "after", F.col("a").alias("tail"))
        levels.append(written(found.join(head, "prefix").join(tail, "suffix").select(
            "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "name", F.col("n").alias("a"),
            F.concat("before", F.array("head")).alias("before"), F.concat(F.array("tail"), "after").alias("after"),
            "prefix", "suffix"), f"phrases-{level}"))
        forget(found)
    return totals, levels


def mine_phrases(docs: DataFrame, top: int = 2000, longest: int = LONGEST, least: int = 100, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` what its lowest-scoring cut leaves on either side, ``n`` the language's words. A phrase is
    dropped if a longer one that holds its words has at least ``percent`` % of its count. One word more on either
    side shows that: what a still longer phrase keeps, the one between keeps as well.
    """
    totals, levels = count_phrases(docs, longest, least)
    ranked = None
    for level in range(2, longest + 1):
        own = levels[level - 1]
        if level < longest:
            more = levels[level]
            longer = more.select(F.col("prefix").alias("name"), "a").union(more.select(F.col("suffix"), "a")).groupBy("name").agg(
                F.max("a").alias("longer"))
            own = own.join(longer, "name", "left").where(f"longer is null or 100 * longer < {int(percent)} * a")
        scored = own.join(totals, "lang").withColumn("cut", _lowest_cut(level)).select(
            "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "name")
        ranked = scored if ranked is None else ranked.unionByName(scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod("name", F.lit(64))                  # a language may hold nearly all phrases: each share ranks its own first
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
