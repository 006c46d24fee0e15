import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalframe.operators import blocks, clean


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_row_index_is_position_in_unit(series, width):
    df, pdf = series
    got = {r["id"]: r["time_index"] for r in blocks.row_index(df, "id", ["unit"], width=width).collect()}
    want = dict(zip(pdf["id"], pdf.groupby("unit").cumcount()))
    assert got == want


@pytest.mark.parametrize("width", [3, 50, 1 << 16])
def test_row_index_over_whole_table(series, width):
    df, pdf = series
    got = {r["id"]: r["time_index"] for r in blocks.row_index(df, "id", width=width).collect()}
    assert got == {i: p for p, i in enumerate(pdf["id"])}


@pytest.mark.parametrize("width", [5, 97, 1 << 16])
def test_order_cuts_with_gaps(series, width):
    df, pdf = series
    n, cuts = blocks.order_cuts(df, "id", [lambda n, r=r: F.lit(r) for r in (0, 1, 299, 420, 599, 600)], width)
    assert n == 600
    assert cuts == [*(int(pdf["id"][r]) for r in (0, 1, 299, 420, 599)), None]


def test_order_cuts_dense_and_empty(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert blocks.order_cuts(df, "k", [lambda n: F.floor(n * 0.7)], 64) == (1000, [700])
    assert blocks.order_cuts(df.where("k < 0"), "k", [lambda n: n * 0], 64) == (0, [None])


@pytest.mark.parametrize("width", [4, 33, 1 << 16])
def test_fills_equal_pandas(series, width):
    df, pdf = series
    groups = pdf.groupby("unit")[["a", "b"]]
    forward = groups.ffill(limit=5)
    both = forward.groupby(pdf["unit"])[["a", "b"]].bfill(limit=5)
    back = groups.bfill(limit=5)
    for f, want in ((clean.forward_fill, forward), (clean.fill_both_ways, both), (clean.backward_fill, back)):
        got = f(df, "id", ["a", "b"], ["unit"], width=width).toPandas().sort_values("id")
        np.testing.assert_array_equal(got[["a", "b"]].to_numpy("float64"), want.to_numpy())


@pytest.mark.parametrize("width", [4, 33, 1 << 16])
def test_interpolation_equals_pandas(series, width):
    df, pdf = series
    want = pdf.groupby("unit", group_keys=False)["a"].apply(
        lambda s: s.interpolate(method="linear", limit=10, limit_direction="both"))
    got = clean.interpolate(df, "id", ["a"], ["unit"], width=width).toPandas().sort_values("id")
    np.testing.assert_allclose(got["a"].to_numpy("float64"), want.sort_index().to_numpy(), rtol=1e-12)


def test_interpolation_short_limit(spark):
    rows = list(enumerate([None, 1.0, None, None, None, 4.0, None]))
    df = spark.createDataFrame(rows, "i long, x double")
    got = [r["x"] for r in clean.interpolate(df, "i", ["x"], limit=1, width=3).orderBy("i").collect()]
    assert got == [1.0, 1.0, 1.75, None, 3.25, 4.0, 4.0]


def test_long_gap_keeps_its_middle(spark):
    xs = [None, None, 1.0] + [None] * 13 + [2.0] + [None] * 3
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
    got = [r["x"] for r in clean.fill_both_ways(df, "i", ["x"], width=4).orderBy("i").collect()]
    assert got == [1.0] * 8 + [None] * 3 + [2.0] * 9


@pytest.mark.parametrize("width,horizon", [(12, 1), (16, 3), (1 << 16, 2)])
def test_sequences(series, width, horizon):
    df, pdf = series
    df = df.fillna(0.0)
    pdf = pdf.fillna(0.0)
    length = 6
    got = {(r["unit"], r["seq_index"]): (np.array(r["x"]), r["y_b"])
           for r in blocks.sequences(df, "id", ["a", "b"], ["b"], length, horizon, ["unit"], width).collect()}
    count = 0
    for unit, rows in pdf.groupby("unit"):
        x, y = rows[["a", "b"]].to_numpy(), rows["b"].to_numpy()
        for i in range(len(rows) - length - horizon + 1):
            gx, gy = got[(unit, i)]
            np.testing.assert_array_equal(gx, x[i:i + length])
            assert gy == y[i + length + horizon - 1]
            count += 1
    assert count == len(got)


def test_sequence_longer_than_block(series):
    with pytest.raises(ValueError):
        blocks.sequences(series[0], "id", ["a"], ["b"], length=20, width=10)


def test_rows_without_a_unit_are_a_series(spark):
    rows = [(1, "u", 1.0), (2, None, 5.0), (3, "u", None), (4, None, None), (5, "", 2.0), (6, None, None)]
    df = spark.createDataFrame(rows, "k long, unit string, x double")
    got = {r["k"]: r["time_index"] for r in blocks.row_index(df, "k", ["unit"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 2}
    filled = {r["k"]: r["x"] for r in clean.forward_fill(df, "k", ["x"], ["unit"]).collect()}
    assert filled == {1: 1.0, 2: 5.0, 3: 1.0, 4: 5.0, 5: 2.0, 6: 5.0}
    numbered = spark.createDataFrame([(1, None), (2, 0), (3, None)], "k long, unit int")
    assert {r["k"]: r["time_index"] for r in blocks.row_index(numbered, "k", ["unit"]).collect()} == {1: 0, 2: 0, 3: 1}


@pytest.mark.parametrize("rows, message", [([(1, "u"), (None, "u")], "missing"), ([(1, "u"), (2, "u"), (2, "u")], "twice")])
def test_keys_without_a_place_raise(spark, rows, message):
    df = spark.createDataFrame(rows, "k long, unit string")
    with pytest.raises(Exception, match=message):
        blocks.row_index(df, "k", ["unit"]).collect()


def test_blocks_follow_the_rows(spark):
    """A microsecond clock does not make a block for each of its rows."""
    n = 200_000
    df = spark.range(n).select((F.col("id") * 1_000_000 + 17).alias("k"))
    cut = blocks.equal_blocks(df, "k")
    assert df.groupBy(cut.number("k")).count().count() <= -(-n // blocks.BLOCK_ROWS) + 1
    assert blocks.order_cuts(df, "k", [lambda m: F.floor(m * 0.7)]) == (n, [140_000 * 1_000_000 + 17])
    tail = blocks.row_index(df, "k").where(f"k >= {(n - 2) * 1_000_000}").orderBy("k").collect()
    assert [r["time_index"] for r in tail] == [n - 2, n - 1]


@pytest.mark.parametrize("segments", [1 << 10, 8])
def test_stray_keys_and_bursts_make_no_heavy_block(spark, monkeypatch, segments):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 500)
    monkeypatch.setattr(blocks, "SEGMENTS", segments)
    n = 20_000
    key = F.when(F.col("id") < n // 2, F.col("id") * 1_000_000).when(F.col("id") < n - 1, F.lit(n * 1_000_000) + F.col("id")).otherwise(F.lit(1 << 62))
    df = spark.range(n).select(key.alias("k"), (F.col("id") % 7).cast("double").alias("x"), F.col("id").alias("at"))
    cut = blocks.equal_blocks(df, "k")
    sizes = [r["count"] for r in df.groupBy(cut.number("k").alias("b")).count().collect()]
    mean = n / -(-n // 500)
    assert sum(sizes) == n and (segments < 100 or max(sizes) <= 2 * mean)
    assert blocks.row_index(df, "k").where("time_index <> at").count() == 0
    assert blocks.order_cuts(df, "k", [lambda m, r=r: F.lit(r) for r in (0, 9_999, 15_000, n - 1, n)])[1] == [
        0, 9_999 * 1_000_000, n * 1_000_000 + 15_000, 1 << 62, None]
    for b in {r["b"] for r in df.select(cut.number("k").alias("b")).distinct().collect()}:
        low, high = cut.keys(b)
        assert df.where(F.col("k").between(low, high) != (cut.number("k") == b)).count() == 0 if b % 9 == 0 else low <= high


def test_known_values_cross_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SUPER", 3)
    n = 2_000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id").isin(3, 700, 1500), F.col("id").cast("double")).alias("x"),
                               F.when(F.col("id") % 2 == 0, F.lit("u")).otherwise(F.lit("v")).alias("unit"))
    near = {r["k"]: r for r in blocks.neighbours(df, "k", ["x"], width=10).collect()}
    for i in range(n):
        before, after = [p for p in (3, 700, 1500) if p <= i], [p for p in (3, 700, 1500) if p >= i]
        assert (near[i]["x__pv"], near[i]["x__pd"]) == ((float(before[-1]), i - before[-1]) if before else (None, None))
        assert (near[i]["x__nv"], near[i]["x__nd"]) == ((float(after[0]), after[0] - i) if after else (None, None))
    split = {r["k"]: r["x__pv"] for r in blocks.neighbours(df, "k", ["x"], ["unit"], width=10).collect()}
    assert split[5] == 3.0 and split[1999] == 3.0 and split[702] == 700.0 and split[1600] == 1500.0 and split[2] is None


def test_running_start_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SUPER", 3)
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = blocks.row_index(df, "k", width=7).where("time_index <> k").count()
    assert got == 0


def test_whole_range_of_keys(spark):
    top = (1 << 63) - 1
    df = spark.createDataFrame([(-top - 1,), (0,), (5,), (top,)], "k long")
    assert blocks.order_cuts(df, "k", [lambda n: F.lit(r) for r in ()] + [lambda n: F.lit(2)]) == (4, [5])
    assert [r["time_index"] for r in blocks.row_index(df, "k").orderBy("k").collect()] == [0, 1, 2, 3]


def test_position_comes_with_the_neighbours(series):
    df, pdf = series
    near = blocks.neighbours(df, "id", ["a"], ["unit"], width=50, position="at")
    got = {r["id"]: r["at"] for r in near.collect()}
    assert got == dict(zip(pdf["id"], pdf.groupby("unit").cumcount()))
