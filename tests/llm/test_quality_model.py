import math

import pyarrow as pa
import pytest

from thermalframe.llm import quality_model as Q

TREE = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 0 <= 3.0)
      Predict: 1.0
     Else (feature 0 > 3.0)
      If (feature 2 <= 0.25)
       Predict: 0.0
      Else (feature 2 > 0.25)
       Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 0.0
"""


def test_paths_become_rules():
    inf = math.inf
    assert [r.bounds for r in Q.rules_of(TREE)] == [
        ((2, -inf, 0.5),), ((0, -inf, 3.0), (2, -inf, 0.5)), ((0, 3.0, inf), (2, -inf, 0.5)),
        ((0, 3.0, inf), (2, -inf, 0.25)), ((0, 3.0, inf), (2, 0.25, 0.5)), ((2, 0.5, inf),)]


def test_column_equals_plain_sum(spark, docs, texts):
    model = Q.Model(-0.5, [(r, w) for r, w in zip(Q.rules_of(TREE), (1.5, -2.0, 0.25, 3.0, -1.0, 0.75))])
    got = {r.doc_id: (r["__score"], r["__predicted"]) for r in Q.scored(docs, model).collect()}
    values = list(zip(*Q.statistics(pa.array([t for _, t in texts], pa.string()))))
    for (i, _), v in zip(texts, values):
        total = -0.5 + sum(w for rule, w in model.weights if all(low < v[s] <= high for s, low, high in rule.bounds))
        assert abs(got[i][0] - 1 / (1 + math.exp(-total))) < 1e-12 and got[i][1] == int(got[i][0] >= 0.7)
    assert Q.scored(docs, model).columns == [*docs.columns, "__score", "__predicted"]


def test_statistics_of_small_texts():
    names, values = Q.STATISTICS, Q.statistics(pa.array(["AB!! c1, ##", None, ""]))
    got = {n: v[0] for n, v in zip(names, values)}
    assert got["words"] == pytest.approx(math.log(4)) and got["word_length"] == 3 and got["symbols"] == pytest.approx(2 / 3)
    assert got["capitals"] == pytest.approx(2 / 11) and got["exclamations"] == pytest.approx(2 / 3) and got["distinct_words"] == 1
    assert all(v[1] == 0 and v[2] == 0 for v in values)


def test_accuracy_on_unseen_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels, ~Q.held_out())
    assert 0 < len(model.weights) <= 60
    seen = Q.scored(docs, model).join(labels, "doc_id").where(Q.held_out())
    right = [r.quality == r["__predicted"] for r in seen.select("quality", "__predicted").collect()]
    assert len(right) > 60 and sum(right) / len(right) > 0.95


@pytest.mark.parametrize("quality", [[], [1, 1, 1], [0], [None]])
def test_without_both_labels(spark, docs, quality):
    labels = spark.createDataFrame([(5 + i, q) for i, q in enumerate(quality)], "doc_id long, quality int")
    scores = {r["__score"] for r in Q.scored(docs, Q.fit(docs, labels)).collect()}
    known = [q for q in quality if q is not None]
    assert len(scores) == 1 and scores.pop() == pytest.approx((sum(known) + 1) / (len(known) + 2))


def test_empty(spark, empty):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.scored(empty, Q.fit(empty, labels)).count() == 0
