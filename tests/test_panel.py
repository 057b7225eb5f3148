from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import stats as ST
from tidemark.operators import backtest as BT
from tidemark.operators import factors as FA
from tidemark.operators import joins as J
from tidemark.operators import panel as P


def bars(spark, n=80, tickers=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tickers):
        price = 100 * np.exp(np.cumsum(rng.standard_normal(n) * 0.02))
        for i, p in enumerate(price):
            rows.append((f"T{t:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(p), float(p * 1.01), float(p * 0.99), float(p), float(rng.integers(100, 1000)), t % 3))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, sector int")


def test_factors_use_no_later_row(spark):
    b = bars(spark)
    cut = dt.date(2020, 3, 1)
    for name, forms in FA.REGISTRY.items():
        h = FA.Horizons.weekly()
        whole = forms["plan"](b, h).where(F.col("date") == cut).toPandas().set_index("ticker").score
        known = forms["plan"](b.where(F.col("date") <= cut), h).where(F.col("date") == cut).toPandas().set_index("ticker").score
        pd.testing.assert_series_equal(whole.sort_index(), known.sort_index(), check_exact=False), name


def test_sector_means_are_zero_and_singletons_null(spark):
    b = bars(spark).withColumn("sector", F.when(F.col("ticker") == "T00", 99).otherwise(F.col("sector")))
    n = b.select("date", "sector", "ticker", P.group_demean("close", ["date", "sector"]).alias("x"))
    assert n.where("sector = 99 and x is not null").count() == 0
    assert n.where("sector <> 99").groupBy("date", "sector").agg(F.avg("x").alias("m")).where("abs(m) > 1e-9").count() == 0


def test_bucket_rules(spark):
    df = spark.createDataFrame([(1, f"t{i}", float(i // 2)) for i in range(23)], "date int, ticker string, s double")
    for rule, value, k in (("floor", 5.0, 4), ("least_one", 10.0, 2), ("share", 0.3, 6), ("rounded", 0.1, 2), ("percent", 20.0, 4)):
        out = P.baskets(df, "s", ["date"], rule, value).toPandas()
        assert (out.side == 1).sum() == k == (out.side == -1).sum()


def test_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, None)], "d int, x double")
    got = [r[0] for r in df.select(P.average_rank("x", ["d"]).alias("r")).collect()]
    assert sorted(x for x in got if x is not None) == [1.0, 2.5, 2.5] and got.count(None) == 1


def test_normal_functions(spark):
    from statistics import NormalDist

    nd = NormalDist()
    xs = [-40.0, -8.0, -3.3, -1.0, 0.0, 0.5, 2.0, 7.5, 40.0]
    got = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.normal_cdf(F.col("x")).alias("v")).collect()]
    assert np.allclose(got, [nd.cdf(x) for x in xs], atol=1e-13)
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = [r.v for r in spark.createDataFrame([(p,) for p in ps], "p double").select(S.normal_quantile(F.col("p")).alias("v")).collect()]
    assert np.allclose(got, [nd.inv_cdf(p) for p in ps], rtol=1e-7, atol=1e-8)


def test_put_call_parity_and_strike(spark):
    df = spark.createDataFrame([(100.0, 90.0, 0.3, 0.5), (50.0, 60.0, 0.2, 1.0)], "s double, k double, v double, t double")
    s, k, v, t = (F.col(c) for c in "skvt")
    for r in df.select("*", S.bs_price(s, k, v, t, 0.03, True).alias("c"), S.bs_price(s, k, v, t, 0.03, False).alias("p"), S.strike_for_delta(s, S.bs_delta(s, k, v, t, 0.03, False), v, t, 0.03, False).alias("back")).collect():
        assert abs(r.c - r.p - (r.s - r.k * math.exp(-0.03 * r.t))) < 1e-9 and abs(r.back - r.k) < 1e-4


def test_deflated_sharpe_is_a_probability_and_monotone(spark):
    df = spark.createDataFrame([(x / 100,) for x in range(-20, 40, 5)], "sr double")
    n, zero = F.lit(250.0), F.lit(0.0)
    got = [r.d for r in df.select("sr", ST.deflated_sharpe(F.col("sr"), n, zero, zero, 10).alias("d")).orderBy("sr").collect()]
    assert all(0 <= x <= 1 for x in got) and got == sorted(got)
    few, many = (df.select(ST.deflated_sharpe(F.lit(0.1), n, zero, zero, k).alias("d")).first().d for k in (2, 200))
    assert many < few


def test_sharpe_presets_on_degenerate_series(spark):
    df = spark.createDataFrame([("flat", 0.01)] * 40 + [("one", 0.01)], "k string, ret double")
    out = {r.k: r for r in df.groupBy("k").agg(*[ST.sharpe("ret", p).alias(p) for p in ST.SHARPE_PRESETS]).collect()}
    assert all(out["flat"][p] == 0 for p in ST.SHARPE_PRESETS)
    assert out["one"]["gate"] is None and out["one"]["metrics"] == 0


def test_bootstrap_indices_and_spread(spark):
    rng = np.random.default_rng(0)
    idx = ST.stationary_indices(rng, 50, 5.0, 400)
    assert idx.min() >= 0 and idx.max() < 50
    follow = ((np.diff(idx, axis=1) % 50) == 1).mean()
    assert 0.75 < follow < 0.87
    x = rng.standard_normal(200) * 0.01
    v = ST.bootstrap_statistic(spark, x, ST.sharpe_of_samples, 600, 5.0).toPandas()
    assert len(v) == 600 and v.rep.is_unique and abs(v.value.mean() - ST.sharpe_of_samples(x[None])[0]) < 0.5


def test_superior_ability():
    rng = np.random.default_rng(1)
    noise = rng.standard_normal((250, 10)) * 0.01
    assert ST.superior_ability(noise, 200)[1] > 0.05
    noise[:, 3] += 0.004
    assert ST.superior_ability(noise, 200)[1] < 0.05 and ST.superior_ability(noise, 200, recentre="mean")[1] < 0.05


def test_linear_algebra():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2))
    y = 1 + x @ np.array([2.0, -1.0]) + rng.standard_normal(400) * 0.1
    o = ST.ols(y, x, robust=True)
    assert np.allclose(o["beta"], [1, 2, -1], atol=0.03) and o["r2"] > 0.99
    p = 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))
    s, i = ST.logistic_recalibration(p, (rng.random(400) < p).astype(float))
    assert abs(s - 1) < 0.4 and abs(i) < 0.4
    cov, a = ST.ledoit_wolf(x)
    assert 0 <= a <= 1 and np.all(np.linalg.eigvalsh(cov) > 0)
    w = ST.mean_variance_weights(np.array([0.1, 0.05, 0.0]), np.eye(3) * 0.04, 1.0, 0.6)
    assert abs(w.sum() - 1) < 1e-9 and w.max() <= 0.6 + 1e-9 and w[0] >= w[1] >= w[2]
    assert 0.4 < ST.hurst(rng.standard_normal(512)) < 0.75


def test_quintile_return_is_lagged_weight_times_return(spark):
    b = bars(spark).withColumn("score", P.simple_return("close", 4))
    held = BT.hold_weights(b.select("ticker", "date", "close", "score"), BT.rebalance_weights(b, 4))
    out = BT.weighted_returns(held, 0.0).toPandas().set_index("date").gross
    h = held.toPandas().pivot(index="date", columns="ticker", values="weight").sort_index()
    c = held.toPandas().pivot(index="date", columns="ticker", values="close").sort_index()
    want = (h.shift(1) * c.pct_change()).sum(axis=1)
    assert np.allclose(out.sort_index(), want.loc[out.sort_index().index])


def test_fills_come_after_decisions_and_flat_markets_cost(spark):
    rows = [("s", dt.date(2020, 1, d), "A", 10.0, 10.0, 0.5 if d == 1 else None) for d in range(1, 6)]
    p = spark.createDataFrame(rows, "strategy string, date date, ticker string, open double, close double, target double")
    out = BT.event_driven(p).orderBy("date").collect()
    assert [r.n_fills for r in out] == [0, 1, 0, 0, 0]
    assert out[0].nav == 1_000_000 and 0 < 1_000_000 - out[-1].nav < 500


def test_pairs_and_volatility_machine(spark):
    rng = np.random.default_rng(3)
    x = 100 * np.exp(np.cumsum(rng.standard_normal(200) * 0.01))
    y = x * np.exp(0.05 * np.sin(np.arange(200) / 6) + rng.standard_normal(200) * 0.002)
    df = spark.createDataFrame([("p", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(y[i]), float(x[i])) for i in range(200)], "pair string, date date, y double, x double")
    out = BT.pairs_trading(df).toPandas()
    assert set(out.position) <= {-1, 0, 1} and (out.position != 0).any() and out.z[:26].isna().all()
    v = spark.createDataFrame([("t", dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0, 10.0 if i != 5 else 8.0, 40.0, 2.0) for i in range(12)], "trial string, date date, open double, close double, vol double, signal double")
    out = BT.volatility_trades(v).orderBy("date").toPandas()
    assert out.event[1] == "enter" and out.event[6] == "exit" and out.event[7:10].eq("").all()


def test_funding_signal_excludes_the_event(spark):
    t0 = dt.datetime(2020, 1, 1)
    rows = [(s, t0 + dt.timedelta(hours=8 * i), float(i * (k + 1))) for k, s in enumerate("abc") for i in range(6)]
    df = spark.createDataFrame(rows, "symbol string, funding_time timestamp, funding_rate double")
    bumped = df.withColumn("funding_rate", F.when(F.col("funding_time") == t0 + dt.timedelta(hours=40), 1e9).otherwise(F.col("funding_rate")))
    a, b = (BT.funding_signal(x).orderBy("symbol", "funding_time").toPandas().signal for x in (df, bumped))
    assert a.equals(b)


def test_asof_blocks_agree_and_keep_nulls(spark):
    rng = np.random.default_rng(4)
    left = spark.createDataFrame([(i, "ab"[i % 2], int(t)) for i, t in enumerate(rng.integers(0, 1000, 300))] + [(900, None, 5), (901, "a", None), (902, "zz", 5)], "id int, k string, t bigint")
    right = spark.createDataFrame([("ab"[i % 2], int(t), i) for i, t in enumerate(rng.integers(0, 1000, 80))] + [("a", 500, 1), ("a", 500, 2), ("b", None, 3)], "k string, rt bigint, v int")
    plain = J.asof_backward(left, right, ["k"], "t", "rt", ["v", "rt"]).toPandas().sort_values("id").reset_index(drop=True)
    block = J.asof_backward(left, right, ["k"], "t", "rt", ["v", "rt"], block=40).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, block)
    lp, rp = left.toPandas(), right.toPandas()
    for r in plain.itertuples():
        me = lp[lp.id == r.id].iloc[0]
        c = rp[(rp.k == me.k) & (rp.rt <= me.t)]
        assert (math.isnan(r.rt) and c.empty) or r.rt == c.rt.max()


def test_one_to_one_raises(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    with pytest.raises(Exception, match="key repeated"):
        J.one_to_one(a, b, ["k"]).collect()


def test_journal_is_idempotent(spark):
    from tidemark.sources.store import Journal

    j = Journal.temporary(spark, "t", "k string, at string, v int", ["k"], "at")
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "k string, at string, v int")
    j.append(rows)
    j.append(rows)
    assert j.entries().count() == 2 and j.latest().first().v == 2


def test_zip_archives(spark, tmp_path):
    import hashlib
    import zipfile

    from tidemark.sources.store import read_zipped_csv

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "h\n1\n")
    r = read_zipped_csv(spark, str(tmp_path / "*.zip")).orderBy("line_no").collect()
    assert [x.raw for x in r] == ["h", "1"] and r[0].sha256 == hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()


def test_generator_against_plain_arithmetic(spark):
    from tidemark.functions import prng

    def plain(seed, n):
        out = []
        for k in range(1, n + 1):
            s = (seed + k * prng.STEP) % 2**32
            t = (s ^ (s >> 15)) * (s | 1) % 2**32
            t = ((t + (t ^ (t >> 7)) * (t | 61)) % 2**32) ^ t
            out.append((t ^ (t >> 14)) / 2**32)
        return out

    df = spark.range(1, 30).withColumn("s", F.lit(4_000_000_000).cast("bigint"))
    got = [r.u for r in prng.with_draw(df, "s", "id", "u").orderBy("id").collect()]
    assert got == plain(4_000_000_000, 29)


def test_read_routes(spark):
    from tidemark.plans import api

    b = bars(spark, 160, 15).cache()
    h = FA.Horizons.weekly()
    assert api.universe(b).count() == 15 and api.prices(b, ["T01"], "2020-02-01", "2020-02-10").count() == 10
    api.check_request(b, ["T01"], "2020-01-01", "2020-02-01")
    for args, message in (((["X"], "2020-01-01", "2020-01-02"), "unknown"), ((["T01"], "2019-01-01", "2020-01-02"), "has data"), ((["T01"], "2020-01-01", "2020-01-02", ("T01",)), "quarantined")):
        with pytest.raises(ValueError, match=message):
            api.check_request(b, *args)
    assert set(r.signal for r in api.scanner(b, horizons=h).select("signal").distinct().collect()) <= {"LONG", "SHORT", "NEUTRAL"}
    c = api.correlation(b, h).where("corr is not null")
    assert c.where("abs(corr) > 1.0000001").count() == 0 and c.count() > 20
    r = api.backtest(b, "mean_reversion", 5, horizons=h)
    assert api.metrics(r.withColumn("k", F.lit(1)), ["k"]).first().win_rate is not None
    assert api.forward_ic(b, "low_volatility", 4, h).count() > 50


def test_registry_takes_new_factors(spark):
    FA.register("size", lambda df, h=FA.H: df.withColumn("score", -F.col("volume")))
    try:
        assert FA.REGISTRY["size"]["parity"](bars(spark, 5, 3)).where("score is not null").count() == 15
    finally:
        del FA.REGISTRY["size"]


def test_power_comes_from_the_series(spark):
    """Two windows of the series itself must pass: fat tails and dependence enter, and power has steps of one path."""
    rng = np.random.default_rng(5)
    calm = rng.standard_normal(260) * 0.02
    slow = np.convolve(rng.standard_normal(300), np.ones(12) / 12, "valid")[:260] * 0.02
    got = {k: {r.sharpe: r.power for r in ST.power_curve(spark, x, [0.0, 2.0, 4.0], 10.0, 10, 52.0, paths=60, boot=100).collect()} for k, x in (("calm", calm), ("slow", slow))}
    assert got["calm"][0.0] <= 0.05 and got["calm"][0.0] <= got["calm"][2.0] <= got["calm"][4.0] and got["calm"][4.0] > 0.9
    assert got["slow"][2.0] != got["calm"][2.0] and all(abs(p * 60 - round(p * 60)) < 1e-9 for c in got.values() for p in c.values())
    shifted = {r.sharpe: r.power for r in ST.power_curve(spark, calm + 0.5, [0.0, 2.0, 4.0], 10.0, 10, 52.0, paths=60, boot=100).collect()}
    assert shifted == got["calm"]  # demeaned
    assert {r.power for r in ST.power_curve(spark, np.array([]), [1.0], 10.0, 10, paths=3).collect()} == {0.0}


def test_deflation_uses_skew_and_kurtosis():
    x = np.random.default_rng(1).standard_normal(200) * 0.01 + 0.002
    crash = x.copy()
    crash[::50] -= 0.03
    crash = (crash - crash.mean()) / crash.std(ddof=1) * x.std(ddof=1) + x.mean()  # the same Sharpe ratio
    assert ST.deflated_sharpe_of(crash, 10) < ST.deflated_sharpe_of(x, 10)
    assert math.isnan(ST.deflated_sharpe_of(x[:4], 10))


def test_funding_of_all_users(spark, duck):
    """No user is left out: a row for every user and hour of the events table."""
    from tests.conftest import SMALL
    from tidemark.plans import catalogue

    want = duck.execute("SELECT count(*), count(DISTINCT user_id) FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) t(user_id, h)").fetchone()
    got = catalogue.QUERIES["funding_signal"](spark, SMALL)
    assert (got.count(), got.select("symbol").distinct().count()) == want and want[1] > 12


def test_limits_decide_on_the_boundary(spark, tmp_path):
    """Snapshots on a limit, also by rounding, are rows of the result and pass; those above fail."""
    from tidemark.plans import catalogue

    rows = [("a", 1, '{"X": 0.25, "Y": 0.1}'), ("a", 2, '{"X": 0.1, "Y": 0.2, "Z": 0.2, "V": 0.1}'), ("b", 3, '{"X": 0.2500001}'), ("b", 4, None)]
    spark.createDataFrame(rows, "account_id string, recorded_at bigint, weights string").write.parquet(f"{tmp_path}/snapshots.parquet")
    got = {r.recorded_at: (r.per_name, r.gross_limit, r.n_failures) for r in catalogue.QUERIES["pre_trade_limits"](spark, str(tmp_path)).collect()}
    assert got == {1: (False, False, 0), 2: (False, False, 0), 3: (True, False, 1)}
