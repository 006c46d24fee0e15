"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled rows; every path from a root is a conjunction of bounds on statistics. A logistic
regression with an L1 penalty over the rules keeps few of them, and what is left is compiled into one Spark column:
``1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))``.

Labels are taken from at most ``SAMPLE_ROWS`` labelled rows, the first by a hash of the id; statistics and scores cover all
rows. Rows with a null label or id, and those that ``train_when`` excludes, teach nothing. Without labels of both kinds
the score is the smoothed share of label 1. A null or empty text has statistics of 0 and is scored like any other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe.llm import text as X
from thermalframe.llm.quality_rules import Counts
from thermalframe.llm.store import written

SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 17
PENALTY = 5e-4
THRESHOLD = 0.7

STATISTICS = ("words", "word_length", "symbols", "capitals", "digits", "exclamations", "marks", "repeated_lines",
              "repeated_words", "distinct_words", "wordlike", "line_words", "top_word")
PREFIX = "__stat_"              # keeps clear of the documents' own columns

_capital, _ascii_digit, _mark = (np.zeros(256, bool) for _ in range(3))
_capital[65:91] = True
_ascii_digit[48:58] = True
_mark[list(b".,;:?!\"'()-")] = True


def statistics(column: pa.Array) -> list[np.ndarray]:
    """Each statistic of each text, shares being of words or bytes."""
    c = Counts(column)
    data, n = c.words.data, np.maximum(c.n_words, 1)
    size = np.maximum(np.diff(c.limits), 1)
    distinct, top = np.zeros(len(column)), np.zeros(len(column))
    first = c.words.first.tolist()
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b > a:
            _, count = np.unique(c.words.hash[a:b], return_counts=True)
            distinct[i], top[i] = len(count), count.max()
    share = lambda flag: c._per_text(flag[data]) / size
    return [np.log1p(c.n_words), c.word_chars / n, c.n_symbols / n, share(_capital), share(_ascii_digit),
            c._per_text(data == ord("!")) / n, share(_mark), c.n_dup_lines / np.maximum(c.n_lines, 1), c.n_repeat_words / n,
            distinct / n, c.n_wordlike / n, c.n_words / np.maximum(c.n_lines, 1), top / n]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with one column for each statistic."""
    from pyspark.sql import types as T
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(PREFIX + s, T.DoubleType()) for s in STATISTICS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            made = [pa.array(np.asarray(x, float)) for x in statistics(batch.column("text"))]
            yield pa.record_batch([*batch.columns, *made], [*columns, *(PREFIX + s for s in STATISTICS)])
    return docs.mapInArrow(work, schema)


@dataclass(frozen=True)
class Rule:
    """Statistics above ``low`` and at most ``high``: ((statistic, low, high), ...)."""
    bounds: tuple[tuple[int, float, float], ...]

    def column(self) -> Column:
        tests = []
        for s, low, high in self.bounds:
            value = F.col(PREFIX + STATISTICS[s])
            if low > -math.inf:
                tests.append(value > low)
            if high < math.inf:
                tests.append(value <= high)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


@dataclass
class Model:
    intercept: float
    weights: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def rules_of(tree: str) -> list[Rule]:
    """Every path of a tree as printed by Spark, from the root to each node below it."""
    rules: list[Rule] = []
    path: list[tuple[int, tuple[int, float, float]]] = []
    for line in tree.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)", line)
        if not m:
            continue
        depth, s, value = len(m[1]), int(m[2]), float(m[4])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (s, -math.inf, value) if m[3] == "<=" else (s, value, math.inf)))
        bounds: dict[int, tuple[float, float]] = {}
        for _, (s, low, high) in path:
            a, b = bounds.get(s, (-math.inf, math.inf))
            bounds[s] = max(a, low), min(b, high)
        rules.append(Rule(tuple((s, *bounds[s]) for s in sorted(bounds))))
    return rules


def fit(docs: DataFrame, labels: DataFrame, train_when: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Model of ``labels.quality`` from at most ``rows`` labelled documents; ``train_when`` is over doc_id."""
    labelled = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    if train_when is not None:
        labelled = labelled.where(train_when)
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)       # a proven bound: broadcast
    chosen = chosen.select("doc_id", F.col("quality").cast("double").alias("__label"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = written(with_statistics(sample.select("text", "__label")).drop("text"), "labelled").coalesce(4)
    n, ones = sample.agg(F.count("*"), F.sum("__label")).first()
    ones = ones or 0
    if not 0 < ones < n:
        return Model(math.log((ones + 1) / (n - ones + 1)))
    vector = array_to_vector(F.array(*(F.col(PREFIX + s) for s in STATISTICS)))
    data = sample.withColumn("__x", vector).persist()
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__label", numTrees=TREES, maxDepth=DEPTH, maxBins=64,
                                    featureSubsetStrategy="0.5", seed=SEED).fit(data)
    every = list(dict.fromkeys(r for r in rules_of(forest.toDebugString)))
    if not every:
        data.unpersist()
        return Model(math.log((ones + 1) / (n - ones + 1)))
    held = data.select("__label", array_to_vector(F.array(*(r.column().cast("double") for r in every))).alias("__r")).persist()
    lasso = LogisticRegression(featuresCol="__r", labelCol="__label", elasticNetParam=1.0, regParam=PENALTY,
                               maxIter=60, standardization=False).fit(held)
    held.unpersist()
    data.unpersist()
    return Model(lasso.intercept, [(r, w) for r, w in zip(every, lasso.coefficients.toArray().tolist()) if w])


def held_out(folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__score`` and ``__predicted``; all other columns as they were."""
    value = with_statistics(docs).withColumn("__score", model.score()).drop(*(PREFIX + s for s in STATISTICS))
    return value.withColumn("__predicted", (F.col("__score") >= THRESHOLD).cast("int"))
