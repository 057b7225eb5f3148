"""Queries of the panel operators: bars, features, factors, cross-section, information coefficients."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import factors as FA
from tidemark.operators import pairs
from tidemark.operators import panel as P
from tidemark.plans.base import B, bars, bars_sql, lag_sql, over, r6, r6_sql, ret_sql, roll_sql

W = FA.Horizons.weekly()
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


@_add("bars_weekly", B + f"SELECT ticker, date, open, high, low, close, volume, sector FROM bars")
def bars_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("ticker", "date", "open", "high", "low", "close", "volume", "sector")


@_add("bars_daily", bars_sql("day") + f"SELECT ticker, date, open, high, low, close, volume FROM bars")
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf, "day").select("ticker", "date", "open", "high", "low", "close", "volume")


# --- factors: SQL of each form, as (further CTEs, score) ---

_R = ", lr AS (SELECT *, CASE WHEN {l} > 0 AND close > 0 THEN ln(close / {l}) END AS r, {s} AS sr, close - {l} AS step FROM bars)".format(l=lag_sql("close"), s=ret_sql("close"))
_GAIN = ", gl AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS g, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS d FROM lr), rs AS (SELECT *, " + roll_sql("avg({})", "g", W.rsi) + " AS ag, " + roll_sql("avg({})", "d", W.rsi) + " AS al FROM gl), rsi AS (SELECT *, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100 ELSE 50 END END AS rsi FROM rs)"
_MKT = ", mk AS (SELECT *, CASE WHEN r IS NOT NULL THEN avg(r) OVER (PARTITION BY date) END AS m FROM lr)"
_f = over(f"ROWS BETWEEN {W.vol - 1} PRECEDING AND CURRENT ROW")
_FIT = _MKT + f", fit AS (SELECT *, CASE WHEN count(r) {_f} = {W.vol} THEN covar_samp(r, m) {_f} / nullif(var_samp(m) {_f}, 0) END AS b, avg(r) {_f} AS ar, avg(m) {_f} AS am, count(r) {_f} AS nr, var_samp(r) {_f} AS vr, covar_samp(r, m) {_f} AS crm, var_samp(m) {_f} AS vm FROM mk), res AS (SELECT *, r - (ar - b * am) - b * m AS e, ar - b * am AS a FROM fit)"
_last5 = over("ROWS BETWEEN 4 PRECEDING AND CURRENT ROW")
_ann = W.annual**0.5
_mom = f"({ret_sql('close', W.year)}) - ({ret_sql('close', W.month)})"


def _amihud(floor: float) -> str:
    return roll_sql("avg({})", f"(abs(sr) / greatest(close * volume, {floor!r}))", W.surge, min(10, W.surge)) + " * 1e6"


# the rolling average's expression must be a column for the count guard
_DOLLAR = ", il1 AS (SELECT *, abs(sr) / greatest(close * volume, 0.000001) AS il, abs(sr) / greatest(close * volume, 1.0) AS ilp FROM lr)"
_OLD = f"lag(close, {W.year}) {over()}"
_SQL = {
    "momentum": (_R, "lr", _mom, f"CASE WHEN {_OLD} > 0 THEN ({lag_sql('close', W.month)} - {_OLD}) / {_OLD} END"),
    "mean_reversion": (_R, "lr", f"-({ret_sql('close', W.week)})", f"-({ret_sql('close', W.week)})"),
    "volume_surge": (
        _R + ", vs AS (SELECT *, " + roll_sql("avg({})", "volume", W.surge) + " AS u, " + roll_sql("avg({})", "volume", W.surge_short) + " AS us FROM lr)",
        "vs", "CASE WHEN u > 0 THEN volume / u * sr END", "CASE WHEN u > 0 THEN (us - u) / u END",
    ),
    "rsi_divergence": (
        _R + _GAIN, "rsi",
        "CASE WHEN rsi < 30 THEN (30 - rsi) / 30.0 WHEN rsi > 70 THEN -(rsi - 70) / 30.0 ELSE (50 - rsi) / 50.0 * 0.5 END", "(rsi - 50.0) / 50.0",
    ),
    "earnings_drift": (
        _R + ", ev AS (SELECT *, " + roll_sql("stddev_samp({})", "r", W.surge) + f" * {_ann!r} AS v, {ret_sql('close', W.quarter)} AS q FROM lr)",
        "ev", "q / greatest(v, 0.01)", ret_sql("close", W.fortnight),
    ),
    "low_volatility": (_R, "lr", f"-({roll_sql('stddev_samp({})', 'r', W.vol)}) * {_ann!r}", None),
    "amihud_illiquidity": (_R + _DOLLAR, "il1", f"({roll_sql('avg({})', 'il', W.surge, min(10, W.surge))}) * 1e6", f"({roll_sql('avg({})', 'ilp', W.surge, min(10, W.surge))}) * 1e6"),
    "idiosyncratic_volatility": (
        _R + _FIT, "res",
        f"CASE WHEN nr = {W.vol} THEN -sqrt(greatest({W.vol - 1} * (vr - crm * crm / nullif(vm, 0)), 0) / {W.vol - 2}) * {_ann!r} END",
        f"-({roll_sql('stddev_samp({})', 'e', W.vol)}) * {_ann!r}",
    ),
    "residual_reversal": (
        _R + _FIT, "res",
        f"CASE WHEN nr = {W.vol} THEN -(sum(r) {_last5} - 5 * a - b * sum(m) {_last5}) END", f"-({roll_sql('sum({})', 'e', 5)})",
    ),
    "risk_managed_momentum": (
        _R + ", rm AS (SELECT *, " + roll_sql("stddev_samp({})", "r", W.quarter) + " AS v FROM lr)", "rm", f"({_mom}) / greatest(v, 0.001)", None,
    ),
    "long_horizon_reversal": (_R, "lr", f"CASE WHEN lag(close, {W.long_year}) {over()} > 0 THEN -({lag_sql('close', W.month)} / lag(close, {W.long_year}) {over()} - 1) END", None),
    "execution_momentum": (
        _R, "lr",
        f"0.4 * ({ret_sql('close', W.month)}) + 0.4 * ({ret_sql('close', W.week)}) + 0.2 * (-(close / ({roll_sql('avg({})', 'close', W.month)}) - 1))", None,
    ),
}


# greatest() skips nulls in both engines; a null deviation must stay null as in the plan
_GUARD = {"earnings_drift": "q IS NOT NULL", "risk_managed_momentum": "TRUE"}


def factor_query(spark: SparkSession, sf: str, name: str, form: str) -> DataFrame:
    scored = FA.REGISTRY[name][form](bars(spark, sf), W)
    return scored.where("score is not null").select("date", "ticker", r6("score"))


for _name, (_ctes, _from, _plan, _parity) in _SQL.items():
    for _form, _expr in (("plan", _plan), ("parity", _parity)):
        if _expr is not None:
            _q = f"factor_{_name}_{_form}"
            QUERIES[_q] = partial(factor_query, name=_name, form=_form)
            ORACLE[_q] = f"{B}{_ctes}, sc AS (SELECT date, ticker, {_expr} AS score FROM {_from}) SELECT date, ticker, round(score, 6) + 0.0 AS score FROM sc WHERE score IS NOT NULL"


# --- flagship ---

_SCORES = f"""{B}{_R}, vol AS (SELECT *, {roll_sql('stddev_samp({})', 'r', W.vol)} AS v FROM lr),
sc AS (SELECT date, ticker, 'momentum' AS factor, {_mom} AS score FROM lr
  UNION ALL SELECT date, ticker, 'mean_reversion', -({ret_sql('close', W.week)}) FROM lr
  UNION ALL SELECT date, ticker, 'low_volatility', -v * {_ann!r} FROM vol),
z AS (SELECT *, (score - avg(score) OVER (PARTITION BY date, factor)) / greatest(stddev_samp(score) OVER (PARTITION BY date, factor), 1e-8) AS z FROM sc WHERE score IS NOT NULL),
comp AS (SELECT date, ticker, greatest(least(avg(z) * 40, 100), -100) AS composite FROM z GROUP BY 1, 2)
"""


def _scores(spark: SparkSession, sf: str, names=("momentum", "mean_reversion", "low_volatility")) -> DataFrame:
    """(date, ticker, factor, score): all factors in one window stage over the bars, then unpivoted."""
    return FA.scores(bars(spark, sf), W, names)


@_add("flagship_signals", _SCORES + "SELECT date, ticker, round(composite, 6) + 0.0 AS composite, CASE WHEN composite > 40 THEN 'LONG' WHEN composite < -40 THEN 'SHORT' ELSE 'NEUTRAL' END AS signal FROM comp")
def flagship_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Three factors, cross-sectional z-scores, composite and signal."""
    return FA.composite(_scores(spark, sf)).select("date", "ticker", r6("composite"), "signal")


@_add(
    "scanner_rank",
    _SCORES + "SELECT date, ticker, round(composite, 6) + 0.0 AS composite, row_number() OVER (PARTITION BY date ORDER BY composite DESC, ticker) AS position FROM comp WHERE abs(composite) >= 20",
)
def scanner_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Scanner: names whose composite is at least 20 in size, ranked on each date."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("composite"), "ticker"))
    return FA.composite(_scores(spark, sf)).where(F.abs("composite") >= 20).select("date", "ticker", r6("composite"), rank.alias("position"))


# --- time-series features ---

_LR = B + _R


@_add("returns_simple_log", _LR + f"SELECT ticker, date, {r6_sql('sr', 'simple')}, {r6_sql('r', 'logged')} FROM lr")
def returns_simple_log(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("ticker", "date", r6(P.simple_return("close"), "simple"), r6(P.log_return("close"), "logged"))


_ROLL = {"mean": ("avg({})", F.avg), "sd": ("stddev_samp({})", F.stddev_samp), "total": ("sum({})", F.sum), "least": ("min({})", F.min), "most": ("max({})", F.max)}


@_add("rolling_stats", _LR + "SELECT ticker, date, " + ", ".join(r6_sql(roll_sql(a, "r", 12), n) for n, (a, _) in _ROLL.items()) + f", {r6_sql(roll_sql('avg({})', 'r', 12, 6), 'mean_half')} FROM lr")
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling aggregates over 12 rows, full windows and half-full ones."""
    b = bars(spark, sf).withColumn("r", P.log_return("close"))
    return b.select("ticker", "date", *[r6(P.rolling(f, "r", 12), n) for n, (_, f) in _ROLL.items()], r6(P.rolling(F.avg, "r", 12, 6), "mean_half"))


@_add(
    "rolling_exclusive",
    _LR
    + f"SELECT ticker, date, {r6_sql('volume / nullif(' + roll_sql('avg({})', 'volume', 8, None, 1) + ', 0)', 'volume_ratio')}, {r6_sql(roll_sql('stddev_samp({})', 'r', 12, None, 1) + ' * sqrt(52)', 'realised_vol')}, round({roll_sql('quantile_cont({}, 0.5)', 'close', 8, None, 1)}, 9) AS median_before FROM lr",
)
def rolling_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that end the row before: volume ratio, realised volatility, median."""
    b = bars(spark, sf).withColumn("r", P.log_return("close"))
    usual = P.exclusive(F.avg, "volume", 8)
    return b.select(
        "ticker", "date", r6(F.col("volume") / F.nullif(usual, F.lit(0.0)), "volume_ratio"),
        r6(P.exclusive(F.stddev_samp, "r", 12) * 52**0.5, "realised_vol"), F.round(P.rolling_median("close", 8, 1), 9).alias("median_before"),
    )


@_add("rsi_14", _LR + _GAIN + f"SELECT ticker, date, {r6_sql('rsi', 'rsi')} FROM rsi")
def rsi_14(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("step", F.col("close") - P.lag("close"))
    return b.select("ticker", "date", r6(P.rsi_of_steps("step", 14), "rsi"))


_z = over("ROWS BETWEEN 12 PRECEDING AND CURRENT ROW")


@_add("zscore_rolling", B + f"SELECT ticker, date, {r6_sql(f'CASE WHEN count(close) {_z} = 13 THEN (close - avg(close) {_z}) / nullif(stddev_samp(close) {_z}, 0) END', 'z')} FROM bars")
def zscore_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("ticker", "date", r6(P.zscore_window("close", 12), "z"))


_ac = over("ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING")


@_add("autocorrelation_rolling", _LR + f", l AS (SELECT *, lag(r) {over()} AS q FROM lr) SELECT ticker, date, {r6_sql(f'CASE WHEN count(CASE WHEN r IS NOT NULL AND q IS NOT NULL THEN 1 END) {_ac} >= 11 THEN corr(r, q) {_ac} END', 'ac1')} FROM l")
def autocorrelation_rolling(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("r", P.log_return("close")).withColumn("_lag1", P.lag("r"))
    return b.select("ticker", "date", r6(P.lag_autocorrelation("r", 12), "ac1"))


@_add("autocorrelation_lags", _LR + f", l AS (SELECT *, lag(r, 1) {over()} AS q1, lag(r, 4) {over()} AS q4 FROM lr) SELECT coalesce(ticker, 'ALL') AS ticker, {r6_sql('corr(r, q1)', 'ac1')}, {r6_sql('corr(r, q4)', 'ac4')} FROM l GROUP BY ROLLUP (ticker)")
def autocorrelation_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation per ticker and pooled, by ROLLUP."""
    b = bars(spark, sf).withColumn("r", P.log_return("close")).withColumns({"q1": P.lag("r", 1), "q4": P.lag("r", 4)})
    out = b.rollup("ticker").agg(F.corr("r", "q1").alias("ac1"), F.corr("r", "q4").alias("ac4"))
    return out.select(F.coalesce("ticker", F.lit("ALL")).alias("ticker"), r6("ac1"), r6("ac4"))


_b = over("ROWS BETWEEN 11 PRECEDING AND CURRENT ROW")


@_add("rolling_beta", _LR + _MKT + f", x AS (SELECT *, count(r) {_b} AS n, covar_samp(r, m) {_b} / nullif(var_samp(m) {_b}, 0) AS beta, avg(r) {_b} AS ar, avg(m) {_b} AS am FROM mk) SELECT ticker, date, {r6_sql('beta', 'beta')}, {r6_sql('ar - beta * am', 'alpha')}, {r6_sql('r - (ar - beta * am) - beta * m', 'residual')} FROM x WHERE n = 12")
def rolling_beta(spark: SparkSession, sf: str) -> DataFrame:
    b = FA.with_market(bars(spark, sf))
    w = P.ts().rowsBetween(-11, 0)
    beta = F.covar_samp("_r", "_m").over(w) / F.nullif(F.var_samp("_m").over(w), F.lit(0.0))
    x = b.withColumns({"n": F.count("_r").over(w), "beta": beta, "ar": F.avg("_r").over(w), "am": F.avg("_m").over(w)}).where("n = 12")
    alpha = F.col("ar") - F.col("beta") * F.col("am")
    return x.select("ticker", "date", r6("beta"), r6(alpha, "alpha"), r6(F.col("_r") - alpha - F.col("beta") * F.col("_m"), "residual"))


_K = 3.0 - 2.0 * 2.0**0.5


@_add(
    "corwin_schultz_spread",
    B
    + f""", hl AS (SELECT *, lag(high) {over()} AS ph, lag(low) {over()} AS pl FROM bars),
ab AS (SELECT *, pow(ln(high / low), 2) + pow(ln(ph / pl), 2) AS beta, pow(ln(greatest(high, ph) / least(low, pl)), 2) AS gamma FROM hl),
al AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / {_K!r} - sqrt(gamma / {_K!r}) AS alpha FROM ab),
sp AS (SELECT *, CASE WHEN ph IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END AS s FROM al)
SELECT ticker, date, {r6_sql(roll_sql('avg({})', 's', 8), 'spread')} FROM sp""",
)
def corwin_schultz_spread(spark: SparkSession, sf: str) -> DataFrame:
    return P.corwin_schultz(bars(spark, sf), 8).select("ticker", "date", r6("spread"))


@_add("average_dollar_volume", B + f", d AS (SELECT *, close * volume AS dv FROM bars) SELECT ticker, date, ({roll_sql('avg({})', 'dv', 8)})::FLOAT::DOUBLE AS adv FROM d")
def average_dollar_volume(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("dv", F.col("close") * F.col("volume"))
    return b.select("ticker", "date", P.rolling(F.avg, "dv", 8).cast("float").cast("double").alias("adv"))


_fm = over("ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING")


@_add("forward_returns", B + f"SELECT ticker, date, {r6_sql(f'lead(close, 1) {over()} / close - 1', 'fwd1')}, {r6_sql(f'lead(close, 4) {over()} / close - 1', 'fwd4')}, {r6_sql(f'CASE WHEN count(close) {_fm} = 4 THEN avg(close) {_fm} END', 'mean_next4')} FROM bars")
def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select(
        "ticker", "date", r6(P.forward_return("close", 1), "fwd1"), r6(P.forward_return("close", 4), "fwd4"), r6(P.forward_mean("close", 4), "mean_next4")
    )


_cum = over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


@_add("nav_drawdown", _LR + f", n AS (SELECT *, product(1 + coalesce(sr, 0)) {_cum} AS nav FROM lr), p AS (SELECT *, max(nav) {_cum} AS peak FROM n) SELECT ticker, date, {r6_sql('nav', 'nav')}, {r6_sql('1 - nav / peak', 'drawdown')} FROM p")
def nav_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("sr", P.simple_return("close")).withColumn("nav", P.nav("sr"))
    return b.select("ticker", "date", r6("nav"), r6(P.drawdown("nav"), "drawdown"))


_DAYS = bars_sql("day")


@_add(
    "ffill_limit",
    _DAYS
    + f""", days AS (SELECT DISTINCT date FROM bars), names AS (SELECT DISTINCT ticker FROM bars),
g AS (SELECT n.ticker, d.date, b.close FROM days d CROSS JOIN names n LEFT JOIN bars b ON b.ticker = n.ticker AND b.date = d.date)
SELECT ticker, date, last_value(close IGNORE NULLS) {over("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW")} AS filled2, last_value(close IGNORE NULLS) {over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")} AS filled FROM g""",
)
def ffill_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse daily panel on the union of dates, filled forward for two days and without limit."""
    b = bars(spark, sf, "day").select("ticker", "date", "close")
    spans = b.select("ticker").distinct().withColumn("one", F.lit(1))
    grid = b.select("date").distinct().withColumn("one", F.lit(1)).join(spans, "one").drop("one")  # names are few: a calendar per name
    g = grid.join(b, ["ticker", "date"], "left")
    return g.select("ticker", "date", P.ffill("close", 2).alias("filled2"), P.ffill("close").alias("filled"))


@_add(
    "gap_runs",
    _DAYS
    + """, wd AS (SELECT ticker, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM bars GROUP BY 1),
miss AS (SELECT w.ticker, w.date FROM wd w ANTI JOIN bars b ON b.ticker = w.ticker AND b.date = w.date WHERE dayofweek(w.date) NOT IN (0, 6)),
pos AS (SELECT c.date, row_number() OVER (ORDER BY c.date) AS k FROM (SELECT DISTINCT date FROM wd WHERE dayofweek(date) NOT IN (0, 6)) c),
isl AS (SELECT m.ticker, m.date, p.k - row_number() OVER (PARTITION BY m.ticker ORDER BY m.date) AS g FROM miss m JOIN pos p USING (date))
SELECT ticker, min(date) AS first_missing, count(*) AS n_days FROM isl GROUP BY ticker, g HAVING count(*) > 3""",
)
def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of more than three missing business days."""
    b = bars(spark, sf, "day").select("ticker", "date")
    cal = b.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("z")).select("ticker", F.explode(S.business_days(F.col("a"), F.col("z"))).alias("date"))
    missing = cal.join(b, ["ticker", "date"], "left_anti")
    # weekday number without weekends: five a week
    days = F.unix_date("date") + 3
    k = F.floor(days / 7) * 5 + days % 7
    isl = missing.withColumn("g", k - F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    return isl.groupBy("ticker", "g").agg(F.min("date").alias("first_missing"), F.count(F.lit(1)).alias("n_days")).where("n_days > 3").drop("g")


# --- cross-section ---

_X = _LR + f", x AS (SELECT date, ticker, sector, {ret_sql('close', 4)} AS m4, {lag_sql('close', -4)} / close - 1 AS f4 FROM bars)"


def _cross(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("date", "ticker", "sector", P.simple_return("close", 4).alias("m4"), P.forward_return("close", 4).alias("f4"))


_AR = "rank() OVER (PARTITION BY date ORDER BY m4) + (count(*) OVER (PARTITION BY date, m4) - 1) / 2.0"


@_add("cross_zscore_rank", _X + f" SELECT date, ticker, {r6_sql('(m4 - avg(m4) OVER (PARTITION BY date)) / nullif(stddev_samp(m4) OVER (PARTITION BY date), 0)', 'z')}, {r6_sql(_AR, 'average_rank')}, {r6_sql(f'({_AR}) / count(*) OVER (PARTITION BY date)', 'rank_pct')} FROM x WHERE m4 IS NOT NULL")
def cross_zscore_rank(spark: SparkSession, sf: str) -> DataFrame:
    x = _cross(spark, sf).where("m4 is not null")
    return x.select("date", "ticker", r6(P.cs_zscore("m4"), "z"), r6(P.average_rank("m4", ["date"]), "average_rank"), r6(P.rank_pct("m4", ["date"]), "rank_pct"))


@_add("sector_neutral", _X + f" SELECT date, ticker, {r6_sql('CASE WHEN count(m4) OVER (PARTITION BY date, sector) >= 2 THEN m4 - avg(m4) OVER (PARTITION BY date, sector) END', 'neutral')} FROM x")
def sector_neutral(spark: SparkSession, sf: str) -> DataFrame:
    return _cross(spark, sf).select("date", "ticker", r6(P.group_demean("m4", ["date", "sector"]), "neutral"))


@_add("winsorised", _X + f" SELECT date, ticker, {r6_sql('CASE WHEN count(m4) OVER (PARTITION BY date) >= 10 THEN greatest(least(m4, quantile_cont(m4, 0.95) OVER (PARTITION BY date)), quantile_cont(m4, 0.05) OVER (PARTITION BY date)) ELSE m4 END', 'cut')} FROM x WHERE m4 IS NOT NULL")
def winsorised(spark: SparkSession, sf: str) -> DataFrame:
    return _cross(spark, sf).where("m4 is not null").select("date", "ticker", r6(P.winsorise("m4", ["date"], 0.05, 0.95), "cut"))


_RULES = {"floor": ("floor", 5.0, "floor(n / 5.0)"), "least_one": ("least_one", 10.0, "greatest(1, floor(n / 10.0))"), "share": ("share", 0.3, "greatest(1, floor(n * 0.3))"), "rounded": ("rounded", 0.2, "greatest(1, round_even(n * 0.2, 0))"), "percent": ("percent", 10.0, "greatest(1, floor(n * 10.0 / 100.0))")}


def bucket_query(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    name, value, _ = _RULES[rule]
    return P.baskets(_cross(spark, sf), "m4", ["date"], name, value, 10 if rule == "floor" else 1).select("date", "ticker", "side")


for _rule, (_, _, _k) in _RULES.items():
    QUERIES[f"buckets_{_rule}"] = partial(bucket_query, rule=_rule)
    _least = 10 if _rule == "floor" else 1
    ORACLE[f"buckets_{_rule}"] = (
        _X
        + f", k AS (SELECT date, ticker, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY m4, ticker) AS u FROM x WHERE m4 IS NOT NULL) "
        f"SELECT date, ticker, CASE WHEN n < {_least} THEN NULL WHEN u > n - {_k} THEN 1 WHEN u <= {_k} THEN -1 ELSE 0 END AS side FROM k"
    )

_IC = (
    _X
    + ", b AS (SELECT * FROM x WHERE m4 IS NOT NULL AND f4 IS NOT NULL), rk AS (SELECT date, m4, f4, rank() OVER (PARTITION BY date ORDER BY m4) + (count(*) OVER (PARTITION BY date, m4) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY f4) + (count(*) OVER (PARTITION BY date, f4) - 1) / 2.0 AS c FROM b)"
    ", ic AS (SELECT date, corr(a, c) AS ic, corr(m4, f4) AS pic, count(*) AS n_names FROM rk GROUP BY 1 HAVING count(*) >= 10)"
)


@_add("ic_spearman", _IC + f" SELECT date, {r6_sql('ic', 'ic')}, n_names FROM ic")
def ic_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return P.information_coefficient(_cross(spark, sf), "m4", "f4", ["date"]).select("date", r6("ic"), "n_names")


@_add("ic_pearson", _IC + f" SELECT date, {r6_sql('pic', 'ic')}, n_names FROM ic")
def ic_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return P.information_coefficient(_cross(spark, sf), "m4", "f4", ["date"], spearman=False).select("date", r6("ic"), "n_names")


@_add(
    "ic_summary",
    _IC + f" SELECT count(ic) AS n_dates, {r6_sql('avg(ic)', 'mean_ic')}, {r6_sql('avg(ic) / stddev_samp(ic)', 'ic_ratio')}, {r6_sql('avg(ic) / stddev_samp(ic) * sqrt(count(ic))', 't_stat')}, {r6_sql('avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)', 'hit_rate')} FROM ic",
)
def ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    ic = P.information_coefficient(_cross(spark, sf), "m4", "f4", ["date"])
    return P.ic_summary(ic, []).select("n_dates", *[r6(c) for c in ("mean_ic", "ic_ratio", "t_stat", "hit_rate")])


@_add("ic_by_year", _IC + f" SELECT year(date) AS year, {r6_sql('avg(ic)', 'mean_ic')}, count(*) AS n_dates FROM ic GROUP BY 1 HAVING count(*) >= 30")
def ic_by_year(spark: SparkSession, sf: str) -> DataFrame:
    ic = P.information_coefficient(_cross(spark, sf), "m4", "f4", ["date"])
    return ic.groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_dates")).where("n_dates >= 30").select("year", r6("mean_ic"), "n_dates")


@_add("rolling_ic_time", _IC + f", d AS (SELECT date, ic, avg(ic) OVER w AS m, count(ic) OVER w AS n FROM ic WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)) SELECT date, {r6_sql('CASE WHEN n >= 4 THEN m END', 'ic_90d')} FROM d")
def rolling_ic_time(spark: SparkSession, sf: str) -> DataFrame:
    """Mean coefficient of the last 90 calendar days over irregular dates (one row a date: a short series)."""
    ic = P.information_coefficient(_cross(spark, sf), "m4", "f4", ["date"])
    w = Window.orderBy(F.unix_date("date")).rangeBetween(-89, 0)
    return ic.select("date", r6(F.when(F.count("ic").over(w) >= 4, F.avg("ic").over(w)), "ic_90d"))


@_add(
    "correlation_matrix",
    _LR + f" SELECT a.ticker AS a, b.ticker AS b, {r6_sql('corr(a.r, b.r)', 'corr')}, count(*) AS n FROM lr a JOIN lr b ON a.date = b.date AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2",
)
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all pairs of names on their common dates, from Gram sums over blocks of dates."""
    r = bars(spark, sf).select("date", "ticker", P.log_return("close").alias("value")).where("value is not null")
    names = pairs.universe(r)
    g = pairs.pair_sums(pairs.centred(r), names)
    corr = pairs.correlations(g)
    rows = [(a, b, round(float(corr[i, j]), 6) + 0.0 if np.isfinite(corr[i, j]) else None, int(g["n"][i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and g["n"][i, j] > 0]
    return spark.createDataFrame(rows, "a string, b string, corr double, n bigint")


@_add("regime_buckets", _LR + f", m AS (SELECT date, avg(r) AS m FROM lr GROUP BY 1), v AS (SELECT date, CASE WHEN count(m) OVER w >= 8 THEN stddev_samp(m) OVER w END AS v FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), q AS (SELECT quantile_cont(v, 0.3) AS a, quantile_cont(v, 0.7) AS b FROM v) SELECT date, CASE WHEN v <= a THEN 'calm' WHEN v >= b THEN 'wild' ELSE 'normal' END AS regime FROM v, q WHERE v IS NOT NULL")
def regime_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Market regimes by the 30 and 70 % quantiles of rolling volatility (one row a date)."""
    r = bars(spark, sf).select("date", P.log_return("close").alias("r")).groupBy("date").agg(F.avg("r").alias("m"))
    w = Window.orderBy("date").rowsBetween(-7, 0)
    v = r.select("date", F.when(F.count("m").over(w) >= 8, F.stddev_samp("m").over(w)).alias("v")).where("v is not null")
    q = v.agg(F.percentile("v", F.lit(0.3)).alias("a"), F.percentile("v", F.lit(0.7)).alias("b"))
    return v.crossJoin(q).select("date", F.when(F.col("v") <= F.col("a"), "calm").when(F.col("v") >= F.col("b"), "wild").otherwise("normal").alias("regime"))
