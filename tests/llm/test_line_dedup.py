import numpy as np
import pytest

import brute
from thermalframe.llm.line_dedup import FAN, Runs, dedup_lines


def rows_of(df):
    return sorted(((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in df.collect()), key=str)


def test_equals_plain_version(docs, texts):
    assert rows_of(dedup_lines(docs)) == sorted(brute.dedup(texts), key=str)


def test_keeps_other_columns(docs):
    out = dedup_lines(docs)
    assert out.columns[:-2] == docs.columns
    assert out.where("n_words = 1 and key = 'x' and lang = 'en'").count() == docs.count()


def test_null_and_repeated_ids(spark):
    rows = [(None, "the same long line\nx"), (3, "The Same Long Line "), (3, "the same long line"), (None, None), (4, "the same long line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(dedup_lines(df)) == sorted(brute.dedup(rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_runs(seed):
    rng = np.random.default_rng(seed)
    runs, seen = Runs(), {}
    for batch in range(FAN ** 3):
        keys = np.unique(np.array([bytes(rng.integers(0, 4, 16, np.uint8)) for _ in range(5)], "S16"))
        found = runs.owners(keys)
        assert [None if m else int(o) for o, m in zip(found.data, found.mask)] == [seen.get(k) for k in keys.tolist()]
        new = found.mask
        runs.add(keys[new], np.full(new.sum(), batch))
        seen.update({k: batch for k in keys[new].tolist()})
    assert all(len(level) < FAN for level in runs.levels)


def test_empty(empty):
    assert dedup_lines(empty).count() == 0
