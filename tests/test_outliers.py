from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import outliers as O
from tidemark.operators.segments import segmented


def test_cutoff_lies_between_bulk_and_spikes():
    rng = np.random.default_rng(0)
    bulk = np.abs(rng.standard_normal(20_000))
    for spikes in ([], [25.0, 40.0, 41.0], list(rng.uniform(15, 5000, 60))):
        x = np.sort(np.concatenate([bulk, spikes]))
        cut = O.gpd_cutoff(x, np.ones(len(x)))
        assert bulk.max() < cut < 15, cut


def test_bounded_bulk_and_few_readings():
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.uniform(0, 0.05, 600), [0.12, 2.3]]))
    assert 0.05 < O.gpd_cutoff(x, np.ones(len(x))) < 0.12
    assert O.gpd_cutoff(np.array([0.0, 1.0]), np.array([1.0, 1.0])) > 0
    assert np.isfinite(O.gpd_cutoff(np.zeros(1) + 1.0, np.array([500.0])))


def test_stuck_length():
    ordinary = O.stuck_length(np.array([1, 2, 3, 25]), np.array([9000, 200, 5, 3]))
    still = O.stuck_length(np.arange(1, 61), np.full(60, 5))
    assert ordinary == 8 and still > 60
    assert O.stuck_length(np.array([1]), np.array([100])) == 8


def trades(spark, price, size=None, symbol="S"):
    size = size if size is not None else [1.0 + (i * 7 % 13) / 10 for i in range(len(price))]
    rows = [(i, symbol, i * 1_000_000_000, None if p is None else float(p), None if s is None else float(s)) for i, (p, s) in enumerate(zip(price, size, strict=True))]
    return spark.createDataFrame(rows, "id bigint, symbol string, ts bigint, price double, size double")


def walk(n, seed=2):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).standard_normal(n) * 1e-3))


def found(spark, df, rows=100_000):
    out = O.sequence_outliers(df, "symbol", "ts", "id", "price", "size", 60_000_000_000, rows)
    return {(r.row_key, r.field) for r in out.collect()}


@pytest.mark.parametrize("rows", [100_000, 700])
def test_spikes_runs_and_moves(spark, rows):
    p = walk(3000)
    p[1500:] *= 1.5  # a lasting move is none
    p[200] *= 1.1
    p[700:703] *= 0.9
    p[2000:2012] = p[2000]
    price = list(p)
    price[2005] = None  # breaks no run
    df = trades(spark, price)
    df = df.unionByName(df.where("id % 5 = 0"))  # delivered again
    want = {(200, "price")} | {(i, "price") for i in (700, 701, 702)} | {(i, "price") for i in range(2001, 2012) if i != 2005}
    assert found(spark, df, rows) == want


def test_source_that_stands_still_by_nature(spark):
    p = np.repeat(walk(150, 3), np.random.default_rng(4).integers(1, 60, 150))[:3000]
    assert not {k for k in found(spark, trades(spark, p)) if k[1] == "price"}


def test_nulls_empty_and_impossible(spark):
    assert found(spark, trades(spark, [])) == set()
    assert found(spark, trades(spark, [None] * 20, [None] * 20)) == set()
    df = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, float("inf")), (4, float("nan")), (5, 1.0), (6, None)], "i int, v double")
    assert {r.i for r in df.where(O.impossible(F.col("v"))).collect()} == {1, 2, 3, 4}


def test_levels(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.uniform(98, 102, 500)] + [("a", 1000.0), ("a", 10.0), ("b", 5.0), (None, 1.0), ("a", None), ("a", -1.0)]
    df = spark.createDataFrame(rows, "who string, v double")
    assert {r.v for r in O.level_outliers(df, "level", "who", "v").collect()} == {1000.0, 10.0}
    assert {r.v for r in O.level_outliers(df, "above", "who", "v").collect()} == {1000.0}


def test_stuck_fills(spark):
    rows = [("x", i, i * 10, 5.0 if 20 <= i < 30 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "who string, id int, t bigint, v double")
    for slot in (1_000_000, 100):
        assert {r.id for r in O.stuck_readings(df, ["who"], "t", "id", "v", slot).collect()} == set(range(21, 30))


def test_segments_hold_their_halo(spark):
    rows = [("k", i) for i in range(5000)] + [("hot", 7)] * 3000 + [(None, 1), ("k", None)]
    df = spark.createDataFrame(rows, "key string, ord bigint")
    out = segmented(df, "key", "ord", 50, 600, 100).toPandas()
    own = out[out.own]
    assert len(own) == 8000
    k = out[out.key == "k"]
    for _, g in k.groupby("seg"):
        mine = g[g.own].ord
        if len(mine):
            lo, hi = mine.min(), mine.max()
            assert set(range(max(0, lo - 100), min(5000, hi + 101))) <= set(g.ord)


@pytest.mark.parametrize("rows", [100_000, 300])
def test_a_run_over_many_segments_is_measured_whole(spark, rows):
    p = walk(4000)
    p[1000:3000] = p[1000]
    got = {k for k, f in found(spark, trades(spark, p), rows) if f == "price"}
    assert got == set(range(1001, 3000))


@pytest.mark.parametrize("rows", [100_000, 40])
def test_stuck_fills_over_segments(spark, rows):
    rng = np.random.default_rng(6)
    fills = [(a, "T", i, i * 10, 5.0 if a == "x" and 100 <= i < 400 else float(rng.random())) for a in "xy" for i in range(600)]
    # a ticker that stands still by nature: runs of ten are no cases there
    fills += [("z", "S", 10_000 + i, i * 10, float(i // 10)) for i in range(600)]
    df = spark.createDataFrame([(f"{a}{i}", a, t, at, v) for a, t, i, at, v in fills], "id string, account string, ticker string, t bigint, v double")
    got = {r.id for r in O.stuck_readings(df, ["account", "ticker"], "t", "id", "v", 100, rows).collect()}
    assert got == {f"x{i}" for i in range(101, 400)}
