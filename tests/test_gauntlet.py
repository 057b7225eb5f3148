"""Operators without SQL against brute force and known cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as ST
from tidemark.operators import backtest as BT
from tidemark.operators import factors as FA
from tidemark.operators import pairs
from tidemark.plans import gauntlet as G
from tidemark.sources import store
from tests.conftest import SMALL


def test_edge_bootstrap_is_the_iid_interval(spark):
    counts = spark.createDataFrame([("a", 0.3, 1, 400), ("a", 0.3, 0, 600), ("b", 0.5, 1, 50), ("b", 0.5, 0, 50)], "region string, p double, y int, n bigint")
    got = {r.region: r for r in G.edge_bootstrap_rows(spark, counts, 2000).collect()}
    sd = (0.4 * 0.6 / 1000) ** 0.5
    assert got["a"].edge == pytest.approx(0.1) and got["a"].low == pytest.approx(0.1 - 1.96 * sd, abs=0.004) and got["a"].high == pytest.approx(0.1 + 1.96 * sd, abs=0.004)
    assert got["a"].excludes_zero and not got["b"].excludes_zero and got["a"].n == 1000


def test_sharpe_difference(spark):
    r = np.random.default_rng(0).standard_normal(300) * 0.01
    same = G.sharpe_difference(spark, r, r, 200).first()
    assert same.difference == 0 and same.low == same.high == 0
    better = G.sharpe_difference(spark, r + 0.01, r, 400).first()
    assert better.low > 0 and better.p_value < 0.5 and better.n == 400


def test_superior_ability_rows(spark):
    rng = np.random.default_rng(1)
    none = rng.standard_normal((250, 6)) * 0.01
    some = none.copy()
    some[:, 2] += 0.01
    p = {k: {r.test: r for r in ST.superior_ability_rows(spark, x, 300).collect()} for k, x in (("none", none), ("some", some))}
    assert all(r.p_value > 0.05 for r in p["none"].values()) and all(r.p_value < 0.02 for r in p["some"].values())
    stat, _ = ST.superior_ability(some, 10)
    assert p["some"]["superior_ability"].statistic == pytest.approx(stat)
    assert ST.superior_ability_rows(spark, np.empty((0, 3))).count() == 0


def test_rolling_residuals_are_refits():
    rng = np.random.default_rng(2)
    y, x = rng.standard_normal(40), rng.standard_normal((40, 3))
    got = ST.rolling_residuals(y, x, 12)
    assert np.isnan(got[:12]).all()
    for t in (12, 25, 39):
        z = np.column_stack([np.ones(12), x[t - 12 : t]])
        beta = np.linalg.lstsq(z, y[t - 12 : t], rcond=None)[0]
        assert got[t] == pytest.approx(y[t] - np.concatenate([[1.0], x[t]]) @ beta)
    assert np.isnan(ST.rolling_residuals(y[:5], x[:5], 12)).all()


def test_hurst_of_windows_is_hurst_of_each():
    x = np.random.default_rng(3).standard_normal((5, 64))
    x[3] = 1.0
    got = ST.hurst_of_windows(x)
    for row, h in zip(x, got, strict=True):
        logs = []
        for size in (8, 16, 32):
            parts = row.reshape(-1, size)
            walk = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
            sd = parts.std(axis=1)
            good = sd > 1e-12
            if good.any():
                logs.append((np.log(size), np.log(((walk.max(axis=1) - walk.min(axis=1))[good] / sd[good]).mean())))
        want = np.clip(np.polyfit(*np.array(logs).T, 1)[0], 0, 1) if len(logs) > 1 else 0.5
        assert h == pytest.approx(want)


def test_weighted_recalibration_is_that_of_repeated_rows():
    rng = np.random.default_rng(4)
    p = rng.choice([0.2, 0.4, 0.7], 500)
    y = (rng.random(500) < 0.1 + 0.7 * p).astype(float)
    f = pd.DataFrame({"p": p, "y": y}).value_counts().reset_index()
    assert ST.logistic_recalibration(f["p"].to_numpy(), f["y"].to_numpy(), weights=f["count"].to_numpy(float)) == pytest.approx(ST.logistic_recalibration(p, y))


def test_pair_sums_against_rows(spark):
    rng = np.random.default_rng(5)
    wide = np.cumsum(rng.standard_normal((60, 4)), axis=0)
    wide[rng.random(wide.shape) < 0.1] = np.nan
    rows = [(pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t), f"n{i}", float(wide[t, i])) for t in range(60) for i in range(4) if wide[t, i] == wide[t, i]]
    panel = pairs.centred(spark.createDataFrame(rows + [(None, "n0", 1.0), (rows[0][0], None, 1.0)], "date date, ticker string, value double"))
    g = pairs.pair_sums(panel, [f"n{i}" for i in range(4)])
    ratio, t, n = pairs.dickey_fuller(g)
    corr = pairs.correlations(g)
    for i in range(4):
        for j in range(4):
            if i == j:
                continue
            both = ~np.isnan(wide[:, i]) & ~np.isnan(wide[:, j])
            y, x = wide[both, i], wide[both, j]
            b, a = np.polyfit(x, y, 1)
            assert ratio[i, j] == pytest.approx(b) and corr[i, j] == pytest.approx(np.corrcoef(x, y)[0, 1])
            e = wide[:, i] - a - b * wide[:, j]
            ok = both[1:] & both[:-1]
            d, u = (e[1:] - e[:-1])[ok], e[:-1][ok]
            z = np.column_stack([np.ones(len(u)), u])
            beta = np.linalg.lstsq(z, d, rcond=None)[0]
            s2 = ((d - z @ beta) ** 2).sum() / (len(d) - 2)
            assert n[i, j] == len(d) and t[i, j] == pytest.approx(beta[1] / np.sqrt(s2 / ((u - u.mean()) ** 2).sum()))


def test_event_driven_fills_at_the_next_open(spark):
    rows = [("s", f"2020-01-0{d}", "A", o, c, w) for d, o, c, w in [(1, 10.0, 10.0, 0.5), (2, 20.0, 20.0, None), (3, 30.0, 40.0, None)]]
    df = spark.createDataFrame(rows, "strategy string, date string, ticker string, open double, close double, target double").withColumn("date", F.to_date("date"))
    e = BT.Execution(slippage_bps=0.0, commission_bps=0.0, min_notional=0.0, capital=1000.0)
    got = BT.event_driven(df, e).orderBy("date").collect()
    assert [r.n_fills for r in got] == [0, 1, 0]  # 50 shares decided at 10, filled at 20
    assert got[1].cash == 0.0 and got[1].nav == 1000.0 and got[2].nav == 2000.0


def test_capacity_falls_with_size(spark):
    r = spark.createDataFrame([(f"2020-01-0{i}", 0.02, 1.0) for i in range(1, 6)], "date string, gross double, turnover double").withColumn("date", F.to_date("date"))
    got = {x.aum: x for x in BT.capacity(r, [1e6, 1e8], 1e8, 0.01).collect()}
    assert got[1e6].final_nav / 1e6 > got[1e8].final_nav / 1e8
    nav, costs = 1e6, []
    for _ in range(5):
        costs.append(0.01 * (nav / 1e8) ** 0.5)
        nav *= 1.02 - costs[-1]
    assert got[1e6].final_nav == pytest.approx(nav) and got[1e6].mean_cost_bps == pytest.approx(1e4 * np.mean(costs))


def test_factors_share_one_exchange_of_the_bars(spark):
    from tidemark.plans.base import bars
    from tidemark.plans.panel import W

    bars(spark, SMALL)
    three = FA.scores(bars(spark, SMALL), W, ("momentum", "mean_reversion", "low_volatility"))
    plan = three._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_archives_with_and_without_header(spark):
    lines = spark.createDataFrame([("p", "1,2.5,10,True", True), ("p", "2,x,11,0", True), ("q", "3,1.0,12,false", False)], "path string, line string, header boolean")
    rows = store.parse_trades(store.read_archives(store.pack_archives(lines, "agg_trade_id,price,exchange_ts_ns,is_buyer_maker"))).orderBy("agg_trade_id").collect()
    assert [(r.path, r.agg_trade_id, r.price, r.is_buyer_maker) for r in rows] == [("p", 1, 2.5, True), ("p", 2, None, False), ("q", 3, 1.0, False)]


def test_gate_rows_fail_on_missing_values(spark):
    df = spark.createDataFrame([("t", 0.96, None), ("u", 0.5, 1.0)], "trial string, dsr double, drawdown double")
    got = {(r.trial, r.gate): r.passed for r in G.gate_rows(df, ["trial"], (("dsr", "dsr", 0.95, True), ("max_drawdown", "drawdown", 0.3, False))).collect()}
    assert got == {("t", "dsr"): True, ("t", "max_drawdown"): False, ("u", "dsr"): False, ("u", "max_drawdown"): False}
