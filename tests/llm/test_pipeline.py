import ast
import os
import re

import public_tokenizers
import pytest

import brute
import corpus_pipeline as P
from thermalframe.llm import quality_model as Q

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                                        "best-fit packing"]


def test_quality_keeps_what_it_accepts(spark, raw):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = Q.scored(raw, Q.fit(raw, labels)).where("__score >= 0.7")
    out = P.quality(spark, raw, SF)
    assert out.columns == raw.columns and pairs(out) == pairs(want)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in out.collect()}
    assert all(i in kept for i, q in marks.items() if q == 1)
    assert sum(i in kept for i, q in marks.items() if q == 0) <= 2


def test_lines(spark, raw, docs, texts):
    for df, rows in ((raw, [(r.doc_id, r.text) for r in raw.collect()]), (docs, texts)):
        out = P.lines(spark, df, SF)
        assert out.columns == df.columns
        assert pairs(out) == sorted(((i, t) for i, _, _, t in brute.dedup(rows)), key=str)
        assert all(r.n_chars == len(r.text) for r in out.collect())


def test_near_duplicates(spark, raw, docs, texts):
    for df, rows in ((raw, [(r.doc_id, r.text) for r in raw.collect()]), (docs, texts)):
        out = P.near_duplicates(spark, df, SF)
        group = brute.components(rows, 5, 80)
        assert out.columns == df.columns
        assert pairs(out) == sorted(((i, t) for i, t in rows if group[i][1] == i), key=str)


def test_near_duplicates_without_ids(spark):
    body = " ".join(f"t{i}" for i in range(40))
    rows = [(None, body), (None, "a clean text of its own"), (5, body + " end"), (5, body + " end"), (7, None), (8, ""), (9, "x y")]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert pairs(out) == sorted([(None, "a clean text of its own"), (5, body + " end"), (7, None), (8, ""), (9, "x y")], key=str)


def test_decontaminated(spark, raw, docs, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for df, rows in ((raw, [(r.doc_id, r.text) for r in raw.collect()]), (docs, texts + [])):
        out = P.decontaminated(spark, df, SF)
        bad = {d for d, *_ in brute.contained(rows, items)}
        assert out.columns == df.columns and pairs(out) == sorted((r for r in rows if r[0] not in bad), key=str)


def test_whole_run(spark, raw):
    got = P.run(spark, SF).collect()
    docs = raw
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = brute.pieces([(r.doc_id, r.text) for r in docs.collect()], public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == sorted(w[:4] for w in want)


@pytest.mark.parametrize("stage", range(5))
def test_empty_table(spark, raw, stage):
    assert P.STAGES[stage][1](spark, raw.where("false"), SF).count() == 0


def test_entry_registers_everything():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)}


def test_nothing_else_imports_the_operators():
    root = os.path.dirname(os.path.abspath(P.__file__))
    for folder, _, names in os.walk(os.path.join(root, "thermalframe")):
        for n in names:
            if not n.endswith(".py") or os.path.basename(folder) == "llm":
                continue
            for node in ast.walk(ast.parse(open(os.path.join(folder, n)).read())):
                found = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                found.append(getattr(node, "module", None) or "")
                assert not any("llm" in name.split(".") for name in found), (n, found)
