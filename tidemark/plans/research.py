"""Queries of aggregations, statistical gates, backtests, risk, data quality and market microstructure."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import stats as ST
from tidemark.operators import backtest as BT
from tidemark.operators import factors as FA
from tidemark.operators import panel as P
from tidemark.operators.rolling_periods import latest_state, parse_day
from tidemark.plans.base import B, bars, bars_sql, lag_sql, over, r6, r6_sql, ret_sql, roll_sql
from tidemark.plans.panel import _IC, _LR, _X, _cross
from tidemark.plans.problems import _DAY
from tidemark.plans.relational import _trades, cdf_sql, ppf_sql
from tidemark.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("ticker", "date", P.simple_return("close").alias("ret")).where("ret is not null")


_RET = _LR + ", q AS (SELECT ticker, date, sr AS ret FROM lr WHERE sr IS NOT NULL)"

# --- aggregations ---


@_add(
    "return_distribution",
    _RET
    + f" SELECT ticker, count(*) AS n, {r6_sql('avg(ret)', 'mean')}, {r6_sql('stddev_samp(ret)', 'sd')}, {r6_sql('median(ret)', 'median')}, {r6_sql('quantile_cont(ret, 0.05)', 'q05')}, {r6_sql('quantile_cont(ret, 0.95)', 'q95')}, {r6_sql('min(ret)', 'least')}, {r6_sql('max(ret)', 'most')}, {r6_sql('avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END)', 'share_negative')}, {r6_sql('avg(CASE WHEN ret = 0 THEN 1.0 ELSE 0.0 END)', 'share_zero')}, {r6_sql('avg(ret) * 52', 'annualised')} FROM q GROUP BY 1",
)
def return_distribution(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("ret")
    return _returns(spark, sf).groupBy("ticker").agg(
        F.count(r).alias("n"), r6(F.avg(r), "mean"), r6(F.stddev_samp(r), "sd"), r6(F.median(r), "median"), r6(F.percentile(r, F.lit(0.05)), "q05"), r6(F.percentile(r, F.lit(0.95)), "q95"),
        r6(F.min(r), "least"), r6(F.max(r), "most"), r6(F.avg((r < 0).cast("double")), "share_negative"), r6(F.avg((r == 0).cast("double")), "share_zero"), r6(F.avg(r) * 52, "annualised"),
    )


@_add("cross_section_stats", _RET + f" SELECT date, count(*) AS n, {r6_sql('avg(ret)', 'mean')}, {r6_sql('stddev_samp(ret)', 'sd')}, {r6_sql('quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25)', 'iqr')} FROM q GROUP BY 1")
def cross_section_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("ret")
    return _returns(spark, sf).groupBy("date").agg(F.count(r).alias("n"), r6(F.avg(r), "mean"), r6(F.stddev_samp(r), "sd"), r6(F.percentile(r, F.lit(0.75)) - F.percentile(r, F.lit(0.25)), "iqr"))


def _sharpe_sql(preset: str) -> str:
    least, ddof, short, flat, annual = ST.SHARPE_PRESETS[preset]
    sd = "stddev_samp(ret)" if ddof else "stddev_pop(ret)"
    short = "NULL" if short is None else short
    return f"CASE WHEN count(ret) < {least} THEN {short} WHEN {sd} < 1e-12 THEN {flat} ELSE avg(ret) / nullif({sd}, 0){' * sqrt(52)' if annual else ''} END"


@_add(
    "performance_metrics",
    _RET
    + " SELECT ticker, "
    + ", ".join(r6_sql(_sharpe_sql(p), f"sharpe_{p}") for p in ST.SHARPE_PRESETS)
    + f", {r6_sql('CASE WHEN count(CASE WHEN ret < 0 THEN 1 END) < 2 THEN 0 ELSE avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(52) END', 'sortino')}, {r6_sql('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {r6_sql('stddev_samp(ret) * sqrt(52)', 'volatility')} FROM q GROUP BY 1",
)
def performance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Sharpe ratio in all its conventions, Sortino, win rate, volatility."""
    r = F.col("ret")
    return _returns(spark, sf).groupBy("ticker").agg(
        *[r6(ST.sharpe("ret", p, 52.0), f"sharpe_{p}") for p in ST.SHARPE_PRESETS], r6(ST.sortino("ret", 52.0), "sortino"), r6(F.avg((r > 0).cast("double")), "win_rate"), r6(F.stddev_samp(r) * 52**0.5, "volatility")
    )


@_add("chunk_returns", bars_sql("day") + f", q AS (SELECT * FROM (SELECT ticker, date, {ret_sql('close')} AS ret FROM bars) WHERE ret IS NOT NULL), c AS (SELECT *, (row_number() {over()} - 1) // 21 AS chunk FROM q) SELECT ticker, chunk, {r6_sql('product(1 + ret) / 1 - 1', 'ret')} FROM c GROUP BY 1, 2")
def chunk_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Compound returns of chunks of 21 days."""
    r = bars(spark, sf, "day").select("ticker", "date", P.simple_return("close").alias("ret")).where("ret is not null")
    c = r.withColumn("chunk", F.floor((F.row_number().over(P.ts()) - 1) / 21))
    return c.groupBy("ticker", "chunk").agg(r6(F.product(1 + F.col("ret")) - 1, "ret"))


@_add("month_resample", _RET + f", m AS (SELECT b.ticker, date_trunc('month', b.date)::DATE AS month, b.date, b.close, q.ret FROM bars b LEFT JOIN q USING (ticker, date)) SELECT ticker, month, {r6_sql('sum(ret)', 'total')}, arg_max(close, date) AS last_close FROM m GROUP BY 1, 2")
def month_resample(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("ticker", "date", "close", P.simple_return("close").alias("ret"))
    return b.groupBy("ticker", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(r6(F.sum("ret"), "total"), F.max_by("close", "date").alias("last_close"))


_MOM = (
    _RET
    + ", mu AS (SELECT ticker, avg(ret) AS m FROM q GROUP BY 1), mo AS (SELECT ticker, count(*)::DOUBLE AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5) AS skew, avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) - 3 AS excess FROM q JOIN mu USING (ticker) GROUP BY 1), s AS (SELECT *, mean / nullif(sd, 0) AS sr FROM mo)"
)
_TRIALS = 25


def _expected_max_sql(variance: str) -> str:
    a, b = ppf_sql(f"CAST({1 - 1 / _TRIALS!r} AS DOUBLE)"), ppf_sql(f"CAST({1 - 1 / (_TRIALS * math.e)!r} AS DOUBLE)")
    return f"(sqrt({variance}) * ({1 - ST.EULER_GAMMA!r} * {a} + {ST.EULER_GAMMA!r} * {b}))"


_VAR = "((1 - skew * sr + (excess + 2) / 4.0 * sr * sr) / (n - 1))"


@_add(
    "sharpe_inference",
    _MOM
    + f""", v AS (SELECT *, {_VAR} AS sv, {_expected_max_sql('1 / (n - 1) * (1 + 0)')} AS e1, {_expected_max_sql('CAST(1 AS DOUBLE)')} AS e2, var_samp(sr) OVER () AS tv FROM s),
w AS (SELECT *, (sr - 0) / sqrt(sv) AS z0, (sr - e1) / sqrt(sv) AS z1, (sr - sqrt(tv) * e2) / sqrt(sv) AS z2, (sr * sqrt(n - 1) - e2) / sqrt(1 - skew * sr + (excess + 2) / 4.0 * sr * sr) AS z3 FROM v)
SELECT ticker, n, {', '.join(r6_sql(c, c) for c in ('mean', 'sd', 'skew', 'excess', 'sr'))}, {r6_sql(cdf_sql('z0'), 'psr')}, {r6_sql(cdf_sql('z1'), 'dsr_sampling')}, {r6_sql(cdf_sql('z2'), 'dsr_trials')}, {r6_sql(cdf_sql('z3'), 'dsr_events')}, {r6_sql('sr * (1 + skew / 6.0 * sr - excess / 24.0 * sr * sr)', 'cornish_fisher')} FROM w""",
)
def sharpe_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Moments, probabilistic and deflated Sharpe ratios (three variants), Cornish-Fisher adjustment."""
    m = ST.moments(_returns(spark, sf), ["ticker"])
    m = m.withColumn("tv", F.var_samp("sr").over(Window.partitionBy()))  # over all trials: one row a trial
    sr, n, k, x = F.col("sr"), F.col("n"), F.col("skew"), F.col("excess")
    none = 1.0 / (n - 1.0)  # sampling variance of a strategy without skill
    # one projection each, so that no generated method holds four normal distribution functions
    m = m.withColumn("psr", ST.probabilistic_sharpe(sr, F.lit(0.0), n, k, x)).withColumn("dsr_sampling", ST.deflated_sharpe(sr, n, k, x, _TRIALS, none))
    m = m.withColumn("dsr_trials", ST.deflated_sharpe(sr, n, k, x, _TRIALS, F.col("tv"))).withColumn("dsr_events", ST.deflated_sharpe_events(sr, n, k, x, _TRIALS))
    names = ("mean", "sd", "skew", "excess", "sr", "psr", "dsr_sampling", "dsr_trials", "dsr_events")
    return m.select("ticker", "n", *[r6(c) for c in names], r6(ST.cornish_fisher_sharpe(sr, k, x), "cornish_fisher"))


@_add(
    "single_factor_ols",
    _LR + f", k AS (SELECT *, avg(r) OVER (PARTITION BY date) AS m FROM lr WHERE r IS NOT NULL) SELECT ticker, count(*) AS n, {r6_sql('regr_slope(r, m)', 'beta')}, {r6_sql('regr_intercept(r, m)', 'alpha')}, {r6_sql('regr_r2(r, m)', 'r2')} FROM k GROUP BY 1",
)
def single_factor_ols(spark: SparkSession, sf: str) -> DataFrame:
    r = bars(spark, sf).select("ticker", "date", P.log_return("close").alias("r")).where("r is not null").withColumn("m", F.avg("r").over(P.cs()))
    return r.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), r6(F.regr_slope("r", "m"), "beta"), r6(F.regr_intercept("r", "m"), "alpha"), r6(F.regr_r2("r", "m"), "r2"))


_TWO = (
    _LR
    + """, f0 AS (SELECT *, avg(r) OVER (PARTITION BY date) AS m, percent_rank() OVER (PARTITION BY date ORDER BY volume) AS big FROM lr WHERE r IS NOT NULL), f1 AS (SELECT date, avg(CASE WHEN big < 0.5 THEN r END) - avg(CASE WHEN big >= 0.5 THEN r END) AS s FROM f0 GROUP BY 1),
k AS (SELECT ticker, date, r, m, s FROM f0 JOIN f1 USING (date) WHERE s IS NOT NULL)"""
)
_DET = "({v}(m){w} * {v}(s){w} - {c}(m, s){w} * {c}(m, s){w})"
_B1 = "(({c}(r, m){w} * {v}(s){w} - {c}(r, s){w} * {c}(m, s){w}) / nullif(" + _DET + ", 0))"
_B2 = "(({c}(r, s){w} * {v}(m){w} - {c}(r, m){w} * {c}(m, s){w}) / nullif(" + _DET + ", 0))"


def _two_sql(x: str, window: str = "") -> str:
    return x.format(v="var_pop", c="covar_pop", w=window)


def _two_betas(over_=None) -> tuple:
    """(beta of m, beta of s) of r on both, from aggregates or windows; null where they are collinear."""

    def w(c):
        return c if over_ is None else c.over(over_)

    vm, vs, ms = w(F.covar_pop("m", "m")), w(F.covar_pop("s", "s")), w(F.covar_pop("m", "s"))
    rm, rs = w(F.covar_pop("r", "m")), w(F.covar_pop("r", "s"))
    det = F.nullif(vm * vs - ms * ms, F.lit(0.0))
    return (rm * vs - rs * ms) / det, (rs * vm - rm * ms) / det


def _two_factors(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, date, r, m, s): returns with the market's and a size spread of their date."""
    b = bars(spark, sf).withColumn("r", P.log_return("close")).where("r is not null")
    b = b.withColumns({"m": F.avg("r").over(P.cs()), "big": F.percent_rank().over(P.cs().orderBy("volume"))})
    small, big = F.when(F.col("big") < 0.5, F.col("r")), F.when(F.col("big") >= 0.5, F.col("r"))
    return b.select("ticker", "date", "r", "m", (F.avg(small).over(P.cs()) - F.avg(big).over(P.cs())).alias("s")).where("s is not null")


_by = " OVER (PARTITION BY ticker)"


@_add(
    "multi_factor_ols",
    _TWO
    + f""", b1 AS (SELECT *, {_two_sql(_B1, _by)} AS b1, {_two_sql(_B2, _by)} AS b2, avg(r){_by} AS ar, avg(m){_by} AS am, avg(s){_by} AS a_s, var_pop(m){_by} AS vm, var_pop(s){_by} AS vs, covar_pop(m, s){_by} AS ms, count(*){_by} AS n FROM k),
e AS (SELECT *, r - ar - b1 * (m - am) - b2 * (s - a_s) AS e, (vs * (m - am) - ms * (s - a_s)) / nullif(n * (vm * vs - ms * ms), 0) AS h FROM b1)
SELECT ticker, {r6_sql('max(ar - b1 * am - b2 * a_s)', 'alpha')}, {r6_sql('max(b1)', 'beta_market')}, {r6_sql('max(b2)', 'beta_size')}, {r6_sql('sqrt(sum(h * h * e * e))', 'se_market')}, {r6_sql('1 - sum(e * e) / nullif(sum((r - ar) * (r - ar)), 0)', 'r2')} FROM e GROUP BY 1""",
)
def multi_factor_ols(spark: SparkSession, sf: str) -> DataFrame:
    """Returns on the market and a size spread, with a heteroskedasticity-robust error: windows of one partitioning, no refits in Python."""
    w = Window.partitionBy("ticker")
    b1, b2 = _two_betas(w)
    k = _two_factors(spark, sf).withColumns({"b1": b1, "b2": b2, "ar": F.avg("r").over(w), "am": F.avg("m").over(w), "as_": F.avg("s").over(w), "vm": F.covar_pop("m", "m").over(w), "vs": F.covar_pop("s", "s").over(w), "ms": F.covar_pop("m", "s").over(w), "n": F.count(F.lit(1)).over(w)})
    dm, ds = F.col("m") - F.col("am"), F.col("s") - F.col("as_")
    e = F.col("r") - F.col("ar") - F.col("b1") * dm - F.col("b2") * ds
    h = (F.col("vs") * dm - F.col("ms") * ds) / F.nullif(F.col("n") * (F.col("vm") * F.col("vs") - F.col("ms") * F.col("ms")), F.lit(0.0))
    g = k.withColumns({"e": e, "h": h, "y": F.col("r") - F.col("ar"), "alpha": F.col("ar") - F.col("b1") * F.col("am") - F.col("b2") * F.col("as_")})
    return g.groupBy("ticker").agg(
        r6(F.max("alpha"), "alpha"), r6(F.max("b1"), "beta_market"), r6(F.max("b2"), "beta_size"), r6(F.sqrt(F.sum(F.expr("h * h * e * e"))), "se_market"), r6(1 - F.sum(F.expr("e * e")) / F.nullif(F.sum(F.expr("y * y")), F.lit(0.0)), "r2")
    )


_r26 = " OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)"


@_add(
    "rolling_residual",
    _TWO + f", b1 AS (SELECT *, count(*){_r26} AS n, {_two_sql(_B1, _r26)} AS b1, {_two_sql(_B2, _r26)} AS b2, avg(r){_r26} AS ar, avg(m){_r26} AS am, avg(s){_r26} AS a_s FROM k) SELECT ticker, date, {r6_sql('r - ar - b1 * (m - am) - b2 * (s - a_s)', 'residual')} FROM b1 WHERE n = 26",
)
def rolling_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Residual of each week under a two-factor fit on the 26 weeks before it, from windowed moments."""
    w = P.ts().rowsBetween(-26, -1)
    b1, b2 = _two_betas(w)
    k = _two_factors(spark, sf).withColumns({"n": F.count(F.lit(1)).over(w), "b1": b1, "b2": b2, "ar": F.avg("r").over(w), "am": F.avg("m").over(w), "as_": F.avg("s").over(w)}).where("n = 26")
    return k.select("ticker", "date", r6(F.expr("r - ar - b1 * (m - am) - b2 * (s - as_)"), "residual"))


@_add("rolling_residual_factors")
def rolling_residual_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals under market, size, value and momentum returns, refitted each week on the 52 before: all fits of a ticker at once."""
    b = bars(spark, sf).withColumns({"r": P.simple_return("close"), "cap": P.lag("close") * P.lag("volume"), "value": P.lag("close", 5) / P.lag("close"), "mom": P.lag("close") / P.lag("close", 14) - 1})
    b = b.where("r is not null and cap is not null and value is not null and mom is not null")
    ranks = {f"_{c}": F.percent_rank().over(P.cs().orderBy(c)) for c in ("cap", "value", "mom")}
    b = b.withColumns(ranks)

    def spread(c: str, sign: int) -> "F.Column":
        return sign * (F.avg(F.when(F.col(c) > 0.5, F.col("r"))).over(P.cs()) - F.avg(F.when(F.col(c) <= 0.5, F.col("r"))).over(P.cs()))

    f = b.select("ticker", "date", "r", F.avg("r").over(P.cs()).alias("x1"), spread("_cap", -1).alias("x2"), spread("_value", 1).alias("x3"), spread("_mom", 1).alias("x4")).na.drop()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        e = ST.rolling_residuals(pdf["r"].to_numpy(float), pdf[["x1", "x2", "x3", "x4"]].to_numpy(float), 52)
        return pd.DataFrame({"ticker": pdf["ticker"], "date": pdf["date"], "residual": e}).dropna()

    return f.groupBy("ticker").applyInPandas(run, "ticker string, date date, residual double")


_BIN = "WITH b AS (SELECT l_orderkey, l_shipdate, least(greatest(0.25 + l_discount * 5, 0.01), 0.99) AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    p = F.least(F.greatest(0.25 + F.col("l_discount") * 5, F.lit(0.01)), F.lit(0.99))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", p.alias("p"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


@_add("calibration_table", _BIN + f" SELECT CASE WHEN p <= 0.1 THEN 0 ELSE ceil(p * 10)::BIGINT - 1 END AS bin, count(*) AS n, {r6_sql('avg(p)', 'mean_forecast')}, {r6_sql('avg(y)', 'share')}, {r6_sql('avg(y) - avg(p)', 'gap')} FROM b GROUP BY 1")
def calibration_table(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability by forecast bins, left-open but for the first."""
    bin_ = F.when(F.col("p") <= 0.1, F.lit(0).cast("bigint")).otherwise(F.ceil(F.col("p") * 10) - 1)
    return _binary(spark, sf).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p"), "mean_forecast"), r6(F.avg("y"), "share"), r6(F.avg("y") - F.avg("p"), "gap"))


@_add("forecast_scores", _BIN + f" SELECT count(*) AS n, {r6_sql('avg(pow(p - y, 2))', 'brier')}, {r6_sql('avg(y) * (1 - avg(y))', 'base_brier')}, {r6_sql('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')}, {r6_sql('avg(CASE WHEN p < 0.4 THEN y - p END)', 'longshot_edge')}, {r6_sql('avg(CASE WHEN p > 0.6 THEN y - p END)', 'favourite_edge')} FROM b")
def forecast_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scorecard: Brier score and its base rate's, log loss, edges of two regions."""
    p, y = F.col("p"), F.col("y")
    return _binary(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.pow(p - y, 2.0)), "brier"), r6(F.avg(y) * (1 - F.avg(y)), "base_brier"), r6(F.avg(S.calibration_logloss(p, y)), "log_loss"),
        r6(F.avg(F.when(p < 0.4, y - p)), "longshot_edge"), r6(F.avg(F.when(p > 0.6, y - p)), "favourite_edge"),
    )


@_add(
    "calibration_cells",
    _BIN
    + f""", mid AS (SELECT min(epoch(l_shipdate)::BIGINT) + (max(epoch(l_shipdate)::BIGINT) - min(epoch(l_shipdate)::BIGINT)) // 2 AS m FROM b),
c AS (SELECT CASE WHEN p <= 0.5 THEN 'low' ELSE 'high' END AS cell, CASE WHEN epoch(l_shipdate)::BIGINT <= m THEN 'is' ELSE 'oos' END AS half, y - p AS e FROM b, mid),
h AS (SELECT cell, count(CASE WHEN half = 'is' THEN 1 END) AS n_is, count(CASE WHEN half = 'oos' THEN 1 END) AS n_oos, avg(CASE WHEN half = 'is' THEN e END) AS edge_is, avg(CASE WHEN half = 'oos' THEN e END) AS edge_oos FROM c GROUP BY 1)
SELECT cell, n_is, n_oos, {r6_sql('edge_is', 'edge_is')}, {r6_sql('edge_oos', 'edge_oos')}, n_is >= 500 AND n_oos >= 500 AS powered, sign(edge_is) = sign(edge_oos) AS same_sign, n_is >= 500 AND n_oos >= 500 AND sign(edge_is) = sign(edge_oos) AND abs(edge_oos) > 0.03 AS passed FROM h""",
)
def calibration_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells held against the first and second half of time: power, direction, edge net of a fee."""
    b = _binary(spark, sf).withColumn("t", F.unix_timestamp("l_shipdate"))
    mid = b.agg(F.min("t").alias("a"), F.max("t").alias("z")).select(F.expr("a + (z - a) div 2").alias("m"))
    c = b.crossJoin(mid).select(F.when(F.col("p") <= 0.5, "low").otherwise("high").alias("cell"), (F.col("t") <= F.col("m")).alias("first"), (F.col("y") - F.col("p")).alias("e"))
    h = c.groupBy("cell").agg(F.count_if("first").alias("n_is"), F.count_if(~F.col("first")).alias("n_oos"), F.avg(F.when(F.col("first"), F.col("e"))).alias("edge_is"), F.avg(F.when(~F.col("first"), F.col("e"))).alias("edge_oos"))
    powered, same = (F.col("n_is") >= 500) & (F.col("n_oos") >= 500), F.signum("edge_is") == F.signum("edge_oos")
    return h.select("cell", "n_is", "n_oos", r6("edge_is"), r6("edge_oos"), powered.alias("powered"), same.alias("same_sign"), (powered & same & (F.abs("edge_oos") > 0.03)).alias("passed"))


@_add("both_sides_days", _X + f", k AS (SELECT date, ticker, f4, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY m4, ticker) AS u FROM x WHERE m4 IS NOT NULL AND f4 IS NOT NULL) SELECT date, count(*) AS n_names, {r6_sql('avg(CASE WHEN u > n - 5 THEN f4 END) - avg(CASE WHEN u <= 5 THEN f4 END)', 'spread')} FROM k GROUP BY 1 HAVING count(CASE WHEN u > n - 5 THEN 1 END) > 0 AND count(CASE WHEN u <= 5 THEN 1 END) > 0 AND count(*) >= 10")
def both_sides_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days that hold both baskets, with the spread of their forward returns."""
    x = _cross(spark, sf).where("m4 is not null and f4 is not null")
    k = x.withColumns({"n": F.count(F.lit(1)).over(P.cs()), "u": F.row_number().over(P.cs().orderBy("m4", "ticker"))})
    top, low = F.col("u") > F.col("n") - 5, F.col("u") <= 5
    g = k.groupBy("date").agg(F.count(F.lit(1)).alias("n_names"), (F.avg(F.when(top, F.col("f4"))) - F.avg(F.when(low, F.col("f4")))).alias("spread"), F.count_if(top).alias("a"), F.count_if(low).alias("b"))
    return g.where("a > 0 and b > 0 and n_names >= 10").select("date", "n_names", r6("spread"))


@_add("coverage", "SELECT symbol, count(*) AS n, min(exchange_ts_ns) AS first_ts, max(exchange_ts_ns) AS last_ts, count(DISTINCT agg_trade_id) AS n_ids, sum(CASE WHEN exchange_ts_ns IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing FROM trade_events GROUP BY 1")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "trade_events").select("symbol", "exchange_ts_ns", "agg_trade_id")
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("exchange_ts_ns").alias("first_ts"), F.max("exchange_ts_ns").alias("last_ts"), F.countDistinct("agg_trade_id").alias("n_ids"), F.count_if(F.col("exchange_ts_ns").isNull()).alias("n_missing"))


@_add("t_test", _RET + f" SELECT month(date) AS month, count(*) AS n, {r6_sql('avg(ret) / (stddev_samp(ret) / sqrt(count(ret)))', 't')}, {r6_sql('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)', 'share_positive')} FROM q GROUP BY 1")
def t_test(spark: SparkSession, sf: str) -> DataFrame:
    """One-sample t statistics and sign shares by calendar month."""
    r = F.col("ret")
    return _returns(spark, sf).groupBy(F.month("date").alias("month")).agg(F.count(r).alias("n"), r6(F.avg(r) / (F.stddev_samp(r) / F.sqrt(F.count(r))), "t"), r6(F.avg((r > 0).cast("double")), "share_positive"))


@_add(
    "ks_two_sample",
    "WITH v AS (SELECT CASE WHEN upper(side) = 'BUY' THEN 1 ELSE 0 END AS a, slippage_bps AS x FROM (SELECT DISTINCT * FROM exec_orders) WHERE slippage_bps IS NOT NULL), n AS (SELECT sum(a) AS na, count(*) - sum(a) AS nb FROM v), g AS (SELECT x, sum(a) AS a, count(*) - sum(a) AS b FROM v GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY x) / na AS fa, sum(b) OVER (ORDER BY x) / nb AS fb FROM g, n) SELECT round(ks, 9) AS ks, round(greatest(least(2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * l * l))), 1), 0), 6) AS p_value FROM (SELECT ks, (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * ks AS l FROM (SELECT max(abs(fa - fb)) AS ks, (SELECT na * nb / (na + nb)::DOUBLE FROM n) AS ne FROM c))",
)
def ks_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Largest distance of two distribution functions (slippage of buys and sells).

    Values are counted first; running counts go range by range, so no task holds all values.
    """
    o = table(spark, sf, "exec_orders").select("order_id", "side", "slippage_bps").distinct().where("slippage_bps is not null")
    g = o.groupBy(F.col("slippage_bps").alias("x")).agg(F.count_if(F.upper("side") == "BUY").alias("a"), F.count_if(F.upper("side") != "BUY").alias("b"))
    g = g.withColumn("block", F.floor(F.col("x") * 10))
    edge = g.groupBy("block").agg(F.sum("a").alias("ea"), F.sum("b").alias("eb"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.select("block", F.coalesce(F.sum("ea").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("eb").over(before), F.lit(0)).alias("ob"))
    totals = edge.agg(F.sum("ea").alias("na"), F.sum("eb").alias("nb"))
    w = Window.partitionBy("block").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    c = g.withColumns({"ca": F.sum("a").over(w), "cb": F.sum("b").over(w)}).join(offsets, "block").crossJoin(totals)  # one row of totals
    away = F.abs((F.col("ca") + F.col("oa")) / F.col("na") - (F.col("cb") + F.col("ob")) / F.col("nb"))
    ne = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    g = c.agg(F.max(away).alias("ks"), F.max(ne).alias("ne")).withColumn("l", (F.sqrt("ne") + 0.12 + 0.11 / F.sqrt("ne")) * F.col("ks"))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("l") * F.col("l")))
    p = F.greatest(F.least(2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)), F.lit(0.0))
    return g.select(F.round("ks", 9).alias("ks"), F.round(p, 6).alias("p_value"))


@_add("slippage_by_ticker", f"SELECT ticker, count(slippage_bps) AS n, {r6_sql('median(slippage_bps)', 'median')}, {r6_sql('quantile_cont(slippage_bps, 0.9)', 'q90')}, {r6_sql('avg(slippage_bps)', 'mean')}, {r6_sql('median(abs(slippage_bps)) / 5.0', 'cost_multiplier')} FROM (SELECT DISTINCT * FROM exec_orders) GROUP BY 1")
def slippage_by_ticker(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("slippage_bps")
    o = table(spark, sf, "exec_orders").select("order_id", "ticker", "slippage_bps").distinct()
    return o.groupBy("ticker").agg(F.count(s).alias("n"), r6(F.median(s), "median"), r6(F.percentile(s, F.lit(0.9)), "q90"), r6(F.avg(s), "mean"), r6(F.median(F.abs(s)) / 5.0, "cost_multiplier"))


@_add("regime_fractions", _X + f" SELECT year(date) AS year, count(*) AS n, {r6_sql('avg(CASE WHEN m4 > 0.1 THEN 1.0 ELSE 0.0 END)', 'share_up')}, {r6_sql('avg(CASE WHEN m4 < -0.1 THEN 1.0 ELSE 0.0 END)', 'share_down')} FROM x WHERE m4 IS NOT NULL GROUP BY 1")
def regime_fractions(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("m4")
    return _cross(spark, sf).where("m4 is not null").groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg((m > 0.1).cast("double")), "share_up"), r6(F.avg((m < -0.1).cast("double")), "share_down"))


# --- resampling and gates ---


def _series(spark: SparkSession, sf: str) -> np.ndarray:
    """One strategy's returns: the equal-weight market by week (one row a date)."""
    rows = _returns(spark, sf).groupBy("date").agg(F.avg("ret").alias("r")).orderBy("date").collect()
    return np.array([r.r for r in rows])


@_add("bootstrap_sharpe")
def bootstrap_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """Stationary-bootstrap distribution of a Sharpe ratio: 2000 replicates, interval."""
    reps = ST.bootstrap_statistic(spark, _series(spark, sf), lambda x: ST.sharpe_of_samples(x, 52.0), 2000, 10.0)
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")
    return reps.agg(F.count(F.lit(1)).alias("n"), q).select("n", *[F.col("q")[i].alias(c) for i, c in enumerate(("low", "median", "high"))])


def _wide(spark: SparkSession, sf: str, value) -> tuple[list[str], np.ndarray]:
    """(names, dates x names) of a value of the returns; a week without trades earns nothing.

    One number a trial and date: the design's candidates, not rows of the tables.
    """
    rows = _returns(spark, sf).select("date", "ticker", value.alias("x")).toArrow()
    dates, at = np.unique(rows.column("date").to_numpy(), return_inverse=True)
    names, of = np.unique(np.array(rows.column("ticker").to_pylist(), dtype=str), return_inverse=True)
    wide = np.zeros((len(dates), len(names)))
    wide[at, of] = rows.column("x").to_numpy()
    return names.tolist(), wide


@_add("superior_ability")
def superior_ability(spark: SparkSession, sf: str) -> DataFrame:
    """Test of superior predictive ability and reality check of all names against the market; replicates are rows."""
    _, perf = _wide(spark, sf, F.col("ret") - F.avg("ret").over(P.cs()))
    return ST.superior_ability_rows(spark, perf, 1000, 10.0)


_FOLDS = 5


@_add(
    "purged_cv",
    _IC
    + f""", p AS (SELECT date, ic, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS t FROM ic), f AS (SELECT *, least(k * {_FOLDS} // t, {_FOLDS - 1}) AS fold FROM p),
g AS (SELECT fold, min(k) AS a, max(k) AS z FROM f GROUP BY 1)
SELECT g.fold, count(CASE WHEN p.k BETWEEN g.a AND g.z THEN 1 END) AS n_test, count(CASE WHEN p.k < g.a - 4 OR p.k > g.z + 2 THEN 1 END) AS n_train, {r6_sql('avg(CASE WHEN p.k BETWEEN g.a AND g.z THEN p.ic END)', 'test_ic')}, {r6_sql('avg(CASE WHEN p.k < g.a - 4 OR p.k > g.z + 2 THEN p.ic END)', 'train_ic')} FROM g, p GROUP BY 1""",
)
def purged_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds in time: labels that reach into the test fold are purged, two rows after it are embargoed."""
    ic = P.information_coefficient(_cross(spark, sf), "m4", "f4", ["date"]).select("date", "ic")
    p = ic.withColumns({"k": F.row_number().over(Window.orderBy("date")) - 1, "t": F.count(F.lit(1)).over(Window.partitionBy())})
    f = p.withColumn("fold", F.least(F.expr(f"k * {_FOLDS} div t"), F.lit(_FOLDS - 1)))
    g = f.groupBy("fold").agg(F.min("k").alias("a"), F.max("k").alias("z"))
    both = p.crossJoin(F.broadcast(g))  # five folds
    k = F.col("k")
    test, train = (k >= F.col("a")) & (k <= F.col("z")), (k < F.col("a") - 4) | (k > F.col("z") + 2)
    return both.groupBy("fold").agg(F.count_if(test).alias("n_test"), F.count_if(train).alias("n_train"), r6(F.avg(F.when(test, F.col("ic"))), "test_ic"), r6(F.avg(F.when(train, F.col("ic"))), "train_ic"))


@_add(
    "random_baseline",
    _RET
    + f""", k AS (SELECT seed, date, ret, row_number() OVER (PARTITION BY seed, date ORDER BY md5(seed || '|' || date || '|' || ticker)) AS u FROM q, (SELECT unnest(generate_series(0, 99)) AS seed)), d AS (SELECT seed, date, sum(CASE WHEN u <= 5 THEN ret ELSE -ret END) / 5 AS ret FROM k WHERE u <= 10 GROUP BY 1, 2)
SELECT seed, {r6_sql('CASE WHEN count(ret) < 30 THEN 0 WHEN stddev_samp(ret) < 1e-12 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(52) END', 'sharpe')} FROM d GROUP BY 1""",
)
def random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred random long-short portfolios: seeds are rows, ranks come from a hash, so every run gives the same."""
    seeds = _returns(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))))
    u = F.row_number().over(Window.partitionBy("seed", "date").orderBy(F.md5(F.concat_ws("|", "seed", "date", "ticker").cast("binary"))))
    daily = seeds.withColumn("u", u).where("u <= 10").groupBy("seed", "date").agg((F.sum(F.when(F.col("u") <= 5, F.col("ret")).otherwise(-F.col("ret"))) / 5).alias("ret"))
    return daily.groupBy("seed").agg(r6(ST.sharpe("ret", "study", 52.0), "sharpe"))


@_add("power_curve")
def power_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Share of strategies of a true Sharpe ratio that pass the gates in two windows, on the market's own returns: replicates are rows."""
    return ST.power_curve(spark, _series(spark, sf), [0.0, 1.0, 2.0, 3.0], 10.0, 10, 52.0)


@_add("portfolio_weights")
def portfolio_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Capped long-only mean-variance weights of all names under a shrunk covariance."""
    names, wide = _wide(spark, sf, F.col("ret"))
    sigma, _ = ST.ledoit_wolf(wide)
    w = ST.mean_variance_weights(wide.mean(axis=0), sigma, risk=2.0, cap=0.25)
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, w, strict=True)], "ticker string, weight double")


@_add("rolling_hurst")
def rolling_hurst(spark: SparkSession, sf: str) -> DataFrame:
    """Hurst exponent of the hundred returns before each row, all windows of a ticker at once (a ticker has one row a week)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r = pdf["ret"].to_numpy(float)
        if len(r) <= 100:
            return pdf[["ticker", "date"]].iloc[:0].assign(hurst=0.0)
        windows = np.lib.stride_tricks.sliding_window_view(r, 100)[:-1]
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[100:], "date": pdf["date"].iloc[100:], "hurst": ST.hurst_of_windows(windows)})

    return _returns(spark, sf).groupBy("ticker").applyInPandas(run, "ticker string, date date, hurst double")


# --- backtests ---

_QB = f"""{B}{_LR[len(B):]}, sc AS (SELECT ticker, date, close, {ret_sql('close', 4)} AS score FROM bars),
dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM sc WHERE score IS NOT NULL)),
rk AS (SELECT s.*, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS u FROM sc s WHERE score IS NOT NULL AND date IN (SELECT date FROM dd WHERE k % 4 = 0)),
sd AS (SELECT date, ticker, CASE WHEN u > n - floor(n / 5) THEN 1 WHEN u <= floor(n / 5) THEN -1 ELSE 0 END AS side FROM rk WHERE n >= 10),
wt AS (SELECT date, ticker, side / count(*) OVER (PARTITION BY date, side) AS w FROM sd WHERE side <> 0),
aa AS (SELECT d.date, last_value(m.date IGNORE NULLS) OVER (ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM (SELECT DISTINCT date FROM sc) d LEFT JOIN (SELECT DISTINCT date FROM wt) m ON m.date = d.date),
hd AS (SELECT sc.ticker, sc.date, sc.close, coalesce(wt.w, 0) AS w FROM sc JOIN aa ON aa.date = sc.date LEFT JOIN wt ON wt.date = aa.a AND wt.ticker = sc.ticker),
pl AS (SELECT *, lag(w) {over()} AS w1, {ret_sql('close')} AS ret FROM hd),
bt AS (SELECT date, sum(coalesce(w1 * ret, 0)) AS gross, sum(abs(w - coalesce(w1, 0))) AS turnover FROM pl GROUP BY 1)
"""


def _quintiles(spark: SparkSession, sf: str) -> DataFrame:
    scored = bars(spark, sf).select("ticker", "date", "close", P.simple_return("close", 4).alias("score"))
    return BT.quintile_backtest(scored, 4, 10.0, 0.0005)


@_add("quintile_backtest", _QB + f"SELECT date, {r6_sql('gross', 'gross')}, {r6_sql('turnover', 'turnover')}, {r6_sql('gross - turnover * 10.0 / 1e4 - 0.0005 * turnover * turnover', 'net')} FROM bt")
def quintile_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return _quintiles(spark, sf).select("date", r6("gross"), r6("turnover"), r6("net"))


@_add(
    "tsmom_weights",
    _LR
    + f""", v AS (SELECT *, {roll_sql('stddev_samp({})', 'r', 13)} * {52**0.5!r} AS vol, {ret_sql('close', 52)} AS past FROM lr),
a AS (SELECT *, coalesce(sign(past) * least(0.1 / nullif(vol, 0), 1), 0) AS raw FROM v), b2 AS (SELECT *, coalesce(raw / nullif(sum(CASE WHEN raw <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY date), 0), 0) AS w FROM a)
SELECT ticker, date, round(CASE WHEN past IS NULL OR vol IS NULL THEN 0 ELSE w * least(2.0 / nullif(sum(abs(w)) OVER (PARTITION BY date), 0), 1) END, 9) + 0.0 AS weight FROM b2""",
)
def tsmom_weights(spark: SparkSession, sf: str) -> DataFrame:
    return BT.time_series_momentum(bars(spark, sf)).select("ticker", "date", (F.round("weight", 9) + 0.0).alias("weight"))


_FUND = "WITH f AS (SELECT 'u' || user_id AS symbol, date_trunc('hour', ts) AS funding_time, avg(value) / 1e6 AS funding_rate FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, count(funding_rate) OVER w AS n, quantile_cont(funding_rate, 0.5) OVER w AS md FROM f WINDOW w AS (PARTITION BY symbol ORDER BY funding_time ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), s AS (SELECT *, CASE WHEN n = 3 THEN md END AS signal FROM g), z AS (SELECT *, (signal - avg(signal) OVER (PARTITION BY funding_time)) / nullif(stddev_samp(signal) OVER (PARTITION BY funding_time), 0) AS score FROM s)"


def _funding(spark: SparkSession, sf: str) -> DataFrame:
    """Funding panel: every user of the events table by hour."""
    e = table(spark, sf, "events").where("user_id is not null and ts is not null")
    f = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), F.date_trunc("hour", "ts").alias("funding_time")).agg((F.avg("value") / 1e6).alias("funding_rate"))
    return BT.funding_signal(f, 3)


@_add("funding_signal", _FUND + " SELECT symbol, funding_time, round(signal, 12) AS signal, round(score, 6) + 0.0 AS score FROM z")
def funding_signal(spark: SparkSession, sf: str) -> DataFrame:
    return _funding(spark, sf).select("symbol", "funding_time", F.round("signal", 12).alias("signal"), r6("score"))


@_add(
    "funding_baskets",
    _FUND
    + f""", ev AS (SELECT funding_time, row_number() OVER (ORDER BY funding_time) - 1 AS k FROM (SELECT DISTINCT funding_time FROM z)),
rk AS (SELECT z.symbol, ev.k, count(*) OVER (PARTITION BY z.funding_time) AS n, row_number() OVER (PARTITION BY z.funding_time ORDER BY score, symbol) AS u, row_number() OVER (PARTITION BY z.funding_time ORDER BY score DESC, symbol) AS d FROM z JOIN ev USING (funding_time) WHERE score IS NOT NULL),
pk AS (SELECT k AS a, symbol, CASE WHEN d <= 3 THEN -1 ELSE 1 END AS side FROM rk WHERE k % 3 = 0 AND k >= 3 AND n >= 8 AND (d <= 3 OR u <= 3)),
la AS (SELECT ev.funding_time, ev.k, last_value(m.a IGNORE NULLS) OVER (ORDER BY ev.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM ev LEFT JOIN (SELECT DISTINCT a FROM pk) m ON m.a = ev.k),
h AS (SELECT la.funding_time, la.k, la.a, pk.side, f.funding_rate AS fr FROM la JOIN pk ON pk.a = la.a LEFT JOIN f ON f.symbol = pk.symbol AND f.funding_time = la.funding_time)
SELECT funding_time, {r6_sql('0.5 * coalesce(avg(CASE WHEN side = 1 THEN -fr * 1e4 - 30.0 * 8.0 / 8766.0 END), 0) + 0.5 * coalesce(avg(CASE WHEN side = -1 THEN fr * 1e4 END), 0) - CASE WHEN k = a THEN 6.0 ELSE 0.0 END', 'pnl_bps')}, count(fr) AS n FROM h GROUP BY funding_time, k, a""",
)
def funding_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return BT.funding_baskets(_funding(spark, sf)).select("funding_time", r6("pnl_bps"), "n")


@_add("event_driven_backtest")
def event_driven_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Two strategies on target weights, filled at the next open with costs."""
    b = bars(spark, sf)
    scored = b.withColumn("score", P.simple_return("close", 4))
    out = None
    for name, every in (("monthly", 4), ("quarterly", 13)):
        held = BT.hold_weights(scored, BT.rebalance_weights(scored, every))
        one = held.select(F.lit(name).alias("strategy"), "date", "ticker", "open", "close", F.col("weight").alias("target"))
        out = one if out is None else out.unionByName(one)
    return BT.event_driven(out)


@_add("volatility_trades")
def volatility_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The stateful volatility trade on every brand as a trial of its own."""
    b = bars(spark, sf).withColumn("r", P.log_return("close"))
    vol = P.rolling(F.stddev_samp, "r", 8) * 52**0.5 * 100
    p = b.select(F.col("ticker").alias("trial"), "date", "open", "close", vol.alias("vol"), (F.col("close") / P.rolling(F.avg, "close", 8)).alias("signal"))
    return BT.volatility_trades(p.where("vol is not null and signal is not null"))


@_add(
    "capacity_curve",
    _QB.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", n AS (SELECT gross, turnover, row_number() OVER (ORDER BY date) AS k FROM bt), walk AS (SELECT aum, 0::BIGINT AS k, aum AS nav, 0.0::DOUBLE AS cost FROM (SELECT unnest([1e6, 1e7, 1e8, 1e9]::DOUBLE[]) AS aum)
UNION ALL SELECT aum, n.k, nav * (1 + gross - least(turnover * 0.1 * sqrt(greatest(nav * turnover, 0) / 1e8), 0.5)), cost + turnover * 0.1 * sqrt(greatest(nav * turnover, 0) / 1e8) FROM walk JOIN n ON n.k = walk.k + 1)
SELECT aum, {r6_sql('arg_max(nav, k) / aum', 'growth')}, {r6_sql('1e4 * arg_max(cost, k) / max(k)', 'mean_cost_bps')} FROM walk GROUP BY 1""",
)
def capacity_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Growth and mean cost of the quintile strategy by the fund's starting size."""
    c = BT.capacity(_quintiles(spark, sf), [1e6, 1e7, 1e8, 1e9], 1e8)
    return c.select("aum", r6(F.col("final_nav") / F.col("aum"), "growth"), r6("mean_cost_bps"))


@_add(
    "size_value_legs",
    _LR
    + f""", ch AS (SELECT date, ticker, close * volume AS cap, {lag_sql('close', 4)} / close AS value, lead(close) {over()} / close - 1 AS fwd FROM lr),
ok AS (SELECT * FROM ch WHERE cap > 0 AND value IS NOT NULL AND fwd IS NOT NULL), md AS (SELECT *, median(cap) OVER (PARTITION BY date) AS mc FROM ok),
bp AS (SELECT date, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.7) AS hi FROM md WHERE cap > mc GROUP BY 1),
lg AS (SELECT md.date, CASE WHEN cap > mc THEN 'big' ELSE 'small' END AS size, CASE WHEN value <= lo THEN 'low' WHEN value > hi THEN 'high' ELSE 'mid' END AS val, sum(cap * fwd) / sum(cap) AS ret FROM md JOIN bp USING (date) GROUP BY 1, 2, 3)
SELECT date, {r6_sql("avg(CASE WHEN size = 'small' THEN ret END) - avg(CASE WHEN size = 'big' THEN ret END)", 'smb')}, {r6_sql("avg(CASE WHEN val = 'high' THEN ret END) - avg(CASE WHEN val = 'low' THEN ret END)", 'hml')} FROM lg GROUP BY 1""",
)
def size_value_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Double sorts (median of size, 30/70 of value among the big), value-weighted legs and their spreads."""
    b = bars(spark, sf)
    ch = b.select("date", "ticker", (F.col("close") * F.col("volume")).alias("cap"), (P.lag("close", 4) / F.col("close")).alias("value"), P.forward_return("close", 1).alias("fwd"))
    md = ch.where("cap > 0 and value is not null and fwd is not null").withColumn("mc", F.percentile("cap", F.lit(0.5)).over(P.cs()))
    bp = md.where("cap > mc").groupBy("date").agg(F.percentile("value", F.lit(0.3)).alias("lo"), F.percentile("value", F.lit(0.7)).alias("hi"))
    size = F.when(F.col("cap") > F.col("mc"), "big").otherwise("small")
    val = F.when(F.col("value") <= F.col("lo"), "low").when(F.col("value") > F.col("hi"), "high").otherwise("mid")
    lg = md.join(bp, "date").groupBy("date", size.alias("size"), val.alias("val")).agg((F.sum(F.col("cap") * F.col("fwd")) / F.sum("cap")).alias("ret"))

    def leg(c: str, v: str):
        return F.avg(F.when(F.col(c) == v, F.col("ret")))

    return lg.groupBy("date").agg(r6(leg("size", "small") - leg("size", "big"), "smb"), r6(leg("val", "high") - leg("val", "low"), "hml"))


# --- execution and risk ---

_STATES = f"WITH st AS (SELECT account_id, {_DAY} AS day, arg_max({{'r': daily_return, 'n': nav, 'l': long_exposure, 's': short_exposure, 'c': cash}}, recorded_at) AS s FROM snapshots GROUP BY 1, 2), d AS (SELECT account_id, day AS date, s.r AS ret, s.n AS nav, s.l AS long_exposure, s.s AS short_exposure, s.c AS cash FROM st WHERE day IS NOT NULL)"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    s = latest_state(table(spark, sf, "snapshots"), {"account_id": F.col("account_id"), "date": parse_day(F.col("date"))}, "recorded_at", ["daily_return", "nav", "long_exposure", "short_exposure", "cash"])
    return s.where("date is not null").withColumnRenamed("daily_return", "ret")


_LOSS = _STATES + ", k AS (SELECT *, sum(CASE WHEN ret >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY date) AS g FROM d WHERE ret IS NOT NULL), l AS (SELECT account_id, date, ret, sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id, g ORDER BY date) AS streak FROM k)"


@_add("portfolio_tracker", _STATES + f", p AS (SELECT *, max(nav) OVER (PARTITION BY account_id ORDER BY date) AS peak FROM d WHERE nav IS NOT NULL) SELECT account_id, date, {r6_sql('1 - nav / peak', 'drawdown')}, {r6_sql('(long_exposure + short_exposure) / nav', 'gross')}, {r6_sql('(long_exposure - short_exposure) / nav', 'net')} FROM p")
def portfolio_tracker(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = _states(spark, sf).where("nav is not null").withColumn("peak", F.max("nav").over(w))
    nav, long, short = F.col("nav"), F.col("long_exposure"), F.col("short_exposure")
    return s.select("account_id", "date", r6(1 - nav / F.col("peak"), "drawdown"), r6((long + short) / nav, "gross"), r6((long - short) / nav, "net"))


@_add(
    "pre_trade_limits",
    "WITH w AS (SELECT s.account_id, s.recorded_at, w.key AS ticker, CAST(w.value AS DOUBLE) AS w FROM (SELECT DISTINCT account_id, recorded_at, weights FROM snapshots WHERE weights IS NOT NULL) s, json_each(s.weights) w), a AS (SELECT account_id, recorded_at, round(max(abs(w)), 9) AS top, round(sum(abs(w)), 9) AS gross, count(*) AS n FROM w GROUP BY 1, 2) SELECT account_id, recorded_at, n, top > 0.25 AS per_name, gross > 0.6 AS gross_limit, (CASE WHEN top > 0.25 THEN 1 ELSE 0 END + CASE WHEN gross > 0.6 THEN 1 ELSE 0 END) AS n_failures FROM a",
)
def pre_trade_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Per-name and gross limits on the weights of each snapshot, compared at nine digits; one on its limit passes."""
    s = table(spark, sf, "snapshots").where("weights is not null").select("account_id", "recorded_at", "weights").distinct()
    w = s.select("account_id", "recorded_at", F.explode(F.from_json("weights", "map<string,double>")).alias("ticker", "w"))
    a = w.groupBy("account_id", "recorded_at").agg(F.max(F.abs("w")).alias("top"), F.sum(F.abs("w")).alias("gross"), F.count(F.lit(1)).alias("n"))
    one, two = F.round("top", 9) > 0.25, F.round("gross", 9) > 0.6
    return a.select("account_id", "recorded_at", "n", one.alias("per_name"), two.alias("gross_limit"), (one.cast("int") + two.cast("int")).alias("n_failures"))


@_add("daily_digest", "SELECT ticker, count(*) AS n_orders, sum(CASE WHEN lower(status) = 'filled' THEN 1 ELSE 0 END)::BIGINT AS n_filled, sum(CASE WHEN status = 'FILLED' THEN 1 ELSE 0 END)::BIGINT AS n_filled_verbatim, round(sum(tx_cost), 4) AS cost FROM (SELECT DISTINCT * FROM exec_orders) GROUP BY 1")
def daily_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of orders; the status literal matters, so both readings are counted."""
    o = table(spark, sf, "exec_orders").distinct()
    return o.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.lower("status") == "filled").alias("n_filled"), F.count_if(F.col("status") == "FILLED").alias("n_filled_verbatim"), F.round(F.sum("tx_cost"), 4).alias("cost"))


# --- microstructure (batch) ---

_T = "WITH t AS (SELECT DISTINCT agg_trade_id, symbol, exchange_ts_ns AS ts, price, size, is_buyer_maker FROM trade_events WHERE exchange_ts_ns IS NOT NULL)"


@_add("tick_gaps", _T + ", g AS (SELECT symbol, ts, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM t) SELECT symbol, count(*) AS n_gaps, max(gap) AS longest FROM g WHERE gap > 5000000000 GROUP BY 1")
def tick_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Pauses of more than five seconds between trades; segments, so that no symbol is one task."""
    from tidemark.operators.segments import segmented

    seg = segmented(_trades(spark, sf).select("agg_trade_id", "symbol", "ts"), "symbol", "ts", 60_000_000_000, 100_000, 2)
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("symbol", "seg").orderBy("ts"))
    return seg.withColumn("gap", gap).where("own and gap > 5000000000").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("gap").alias("longest"))


_K = "WITH k AS (SELECT DISTINCT last_update_id, symbol, exchange_ts_ns AS ts, bid_px_1, bid_sz_1, ask_px_1, ask_sz_1 FROM book_snapshots WHERE exchange_ts_ns IS NOT NULL)"


@_add("book_imbalance", _K + f" SELECT last_update_id, {r6_sql('(bid_sz_1 - ask_sz_1) / nullif(bid_sz_1 + ask_sz_1, 0)', 'imbalance')}, (ask_px_1 * bid_sz_1 + bid_px_1 * ask_sz_1) / nullif(bid_sz_1 + ask_sz_1, 0) AS microprice FROM k")
def book_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalance and microprice of the top of the book."""
    k = table(spark, sf, "book_snapshots").where("exchange_ts_ns is not null").select("last_update_id", "symbol", "exchange_ts_ns", "bid_px_1", "bid_sz_1", "ask_px_1", "ask_sz_1").distinct()
    b, a = F.col("bid_sz_1"), F.col("ask_sz_1")
    both = F.nullif(b + a, F.lit(0.0))
    return k.select("last_update_id", r6((b - a) / both, "imbalance"), ((F.col("ask_px_1") * b + F.col("bid_px_1") * a) / both).alias("microprice"))


_WIDTHS = (10, 30, 60, 300)


@_add(
    "trade_flow_windows",
    _T
    + ", s AS (SELECT symbol, ts // 10000000000 * 10 AS sec, count(*) AS n, sum(CASE WHEN is_buyer_maker THEN -1 ELSE 1 END) AS net, sum(CASE WHEN is_buyer_maker THEN -size ELSE size END) AS flow, sum(size) AS volume FROM t WHERE price > 0 AND size > 0 AND isfinite(size) GROUP BY 1, 2), w AS ("
    + " UNION ALL ".join(f"SELECT {w} AS width, symbol, unnest(generate_series(sec - {w - 10}, sec, 10)) AS start_s, n, net, flow, volume FROM s" for w in _WIDTHS)
    + ") SELECT width, symbol, start_s, sum(n)::BIGINT AS n, sum(net)::BIGINT AS net_trades, round(sum(flow) / sum(volume), 6) + 0.0 AS imbalance FROM w GROUP BY 1, 2, 3",
)
def trade_flow_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Net trades and volume imbalance in windows of 10, 30, 60 and 300 seconds that slide by 10; trades are summed by ten seconds first."""
    t = _trades(spark, sf).where("price > 0 and size > 0 and not isnan(size) and size < double('inf')")
    sign = F.when(F.col("is_buyer_maker"), -1).otherwise(1)
    s = t.groupBy("symbol", F.expr("ts div 10000000000 * 10").alias("sec")).agg(F.count(F.lit(1)).alias("n"), F.sum(sign).alias("net"), F.sum(sign * F.col("size")).alias("flow"), F.sum("size").alias("volume"))

    def starts(width: int):
        return F.transform(F.sequence(F.col("sec") - (width - 10), F.col("sec"), F.lit(10).cast("bigint")), lambda x: F.struct(F.lit(width).alias("width"), x.alias("start_s")))

    x = s.select("symbol", "n", "net", "flow", "volume", F.inline(F.flatten(F.array(*[starts(w) for w in _WIDTHS]))))
    return x.groupBy("width", "symbol", "start_s").agg(F.sum("n").alias("n"), F.sum("net").alias("net_trades"), r6(F.sum("flow") / F.sum("volume"), "imbalance"))


@_add(
    "microprice_return",
    _K + ", m AS (SELECT symbol, ts, last_update_id, CASE WHEN bid_sz_1 + ask_sz_1 > 0 AND bid_px_1 > 0 AND ask_px_1 > 0 THEN (ask_px_1 * bid_sz_1 + bid_px_1 * ask_sz_1) / (bid_sz_1 + ask_sz_1) END AS px FROM k) SELECT last_update_id, symbol, round(ln(px / lag(px) OVER (PARTITION BY symbol ORDER BY ts, last_update_id)), 9) + 0.0 AS ret FROM m",
)
def microprice_return(spark: SparkSession, sf: str) -> DataFrame:
    """Log return of the microprice from a symbol's state before, in segments, so that no symbol is one task."""
    from tidemark.operators.segments import segmented

    k = table(spark, sf, "book_snapshots").where("exchange_ts_ns is not null").select("last_update_id", "symbol", F.col("exchange_ts_ns").alias("ts"), "bid_px_1", "bid_sz_1", "ask_px_1", "ask_sz_1").distinct()
    b, a = F.col("bid_sz_1"), F.col("ask_sz_1")
    px = F.when((b + a > 0) & (F.col("bid_px_1") > 0) & (F.col("ask_px_1") > 0), (F.col("ask_px_1") * b + F.col("bid_px_1") * a) / (b + a))
    seg = segmented(k.select("last_update_id", "symbol", "ts", px.alias("px")), "symbol", "ts", 60_000_000_000)
    before = F.lag("px").over(Window.partitionBy("symbol", "seg").orderBy("ts", "last_update_id"))
    return seg.withColumn("ret", F.round(F.log(F.col("px") / before), 9) + 0.0).where("own").select("last_update_id", "symbol", "ret")


@_add(
    "benchmark_metrics",
    _RET
    + f""", m AS (SELECT *, ret - avg(ret) OVER (PARTITION BY date) AS active, product(1 + ret) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS nav FROM q), p AS (SELECT *, max(nav) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS peak FROM m)
SELECT ticker, {r6_sql('(pow(product(1 + ret), 52.0 / count(ret)) - 1) / nullif(max(1 - nav / peak), 0)', 'calmar')}, {r6_sql('avg(active) / nullif(stddev_samp(active), 0) * sqrt(52)', 'information_ratio')}, {r6_sql('pow(product(1 + ret), 52.0 / count(ret)) - 1', 'annual_return')}, {r6_sql('max(1 - nav / peak)', 'max_drawdown')} FROM p GROUP BY 1""",
)
def benchmark_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Calmar ratio, information ratio against the market, annual return and largest drawdown."""
    whole = P.ts().rowsBetween(Window.unboundedPreceding, 0)
    m = _returns(spark, sf).withColumns({"active": F.col("ret") - F.avg("ret").over(P.cs()), "nav": F.product(1 + F.col("ret")).over(whole)}).withColumn("down", 1 - F.col("nav") / F.max("nav").over(whole))
    annual = ST.annual_return("ret", 52.0)
    return m.groupBy("ticker").agg(
        r6(annual / F.nullif(F.max("down"), F.lit(0.0)), "calmar"), r6(F.avg("active") / F.nullif(F.stddev_samp("active"), F.lit(0.0)) * 52**0.5, "information_ratio"), r6(annual, "annual_return"), r6(F.max("down"), "max_drawdown")
    )


# --- learning features ---


@_add(
    "agent_features",
    _LR
    + f""", f AS (SELECT ticker, date, {ret_sql('close', 1)} AS ret1, {ret_sql('close', 4)} AS ret4, {roll_sql('stddev_samp({})', 'r', 4)} AS vol4, close / ({roll_sql('avg({})', 'close', 4)}) - 1 AS over_mean, close / ({roll_sql('max({})', 'close', 13)}) - 1 AS below_high, volume / ({roll_sql('avg({})', 'volume', 4)}) - 1 AS surge FROM lr)
SELECT ticker, date, {', '.join(r6_sql(c, c) for c in ('ret1', 'ret4', 'vol4', 'over_mean', 'below_high', 'surge'))}, {r6_sql('0.35 * ret4 / nullif(vol4, 0) + 0.25 * ret1 + 0.2 * below_high + 0.1 * -over_mean + 0.1 * surge', 'score')} FROM f""",
)
def agent_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per-ticker state features and the rolling signal score."""
    b = bars(spark, sf).withColumn("r", P.log_return("close"))
    f = b.select(
        "ticker", "date", P.simple_return("close", 1).alias("ret1"), P.simple_return("close", 4).alias("ret4"), P.rolling(F.stddev_samp, "r", 4).alias("vol4"), (F.col("close") / P.rolling(F.avg, "close", 4) - 1).alias("over_mean"),
        (F.col("close") / P.rolling(F.max, "close", 13) - 1).alias("below_high"), (F.col("volume") / P.rolling(F.avg, "volume", 4) - 1).alias("surge"),
    )
    score = F.expr("0.35 * ret4 / nullif(vol4, 0) + 0.25 * ret1 + 0.2 * below_high + 0.1 * -over_mean + 0.1 * surge")
    return f.select("ticker", "date", *[r6(c) for c in ("ret1", "ret4", "vol4", "over_mean", "below_high", "surge")], r6(score, "score"))


@_add(
    "walk_forward_folds",
    _RET
    + f""", sp AS (SELECT min(date) AS a, max(date) AS z FROM q), fo AS (SELECT k AS fold, (date_trunc('month', a) + INTERVAL 12 MONTH * k)::DATE AS tr FROM sp, unnest(generate_series(0, CAST(year(z) - year(a) AS INTEGER))) g(k) WHERE (date_trunc('month', a) + INTERVAL 12 MONTH * k + INTERVAL 18 MONTH)::DATE <= z)
SELECT fold, count(CASE WHEN date < (tr + INTERVAL 12 MONTH)::DATE THEN 1 END) AS n_train, count(CASE WHEN date >= (tr + INTERVAL 12 MONTH)::DATE THEN 1 END) AS n_eval, {r6_sql('avg(CASE WHEN date < (tr + INTERVAL 12 MONTH)::DATE THEN ret END)', 'train_mean')}, {r6_sql('avg(CASE WHEN date >= (tr + INTERVAL 12 MONTH)::DATE THEN ret END)', 'eval_mean')} FROM fo JOIN q ON date >= tr AND date < (tr + INTERVAL 18 MONTH)::DATE GROUP BY 1""",
)
def walk_forward_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds of twelve months of training and six of evaluation, a year apart."""
    q = _returns(spark, sf)
    span = q.agg(F.to_date(F.date_trunc("month", F.min("date"))).alias("a"), F.max("date").alias("z"))
    fold = span.select("z", "a", F.explode(F.sequence(F.lit(0), F.year("z") - F.year("a"))).alias("fold")).withColumn("tr", F.expr("add_months(a, 12 * fold)")).where("add_months(tr, 18) <= z").select("fold", "tr")
    j = q.join(F.broadcast(fold), (F.col("date") >= F.col("tr")) & (F.col("date") < F.add_months("tr", 18)))  # one fold a year of the span
    train = F.col("date") < F.add_months("tr", 12)
    return j.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_eval"), r6(F.avg(F.when(train, F.col("ret"))), "train_mean"), r6(F.avg(F.when(~train, F.col("ret"))), "eval_mean"))


__all__ = ["ORACLE", "QUERIES", "FA"]
