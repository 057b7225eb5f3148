"""Further queries: volatility signals, contracts, combinations, coverage, learning baselines, and the service's read routes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import stats as ST
from tidemark.operators import factors as FA
from tidemark.operators import panel as P
from tidemark.plans.base import B, bars, bars_sql, lag_sql, over, r6, r6_sql, ret_sql, roll_sql
from tidemark.plans.panel import _LR, _SCORES, _mom, _scores
from tidemark.plans.relational import _trades
from tidemark.plans.research import _BIN, _RET, _binary, _returns
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


_VOLS = _LR + ", v AS (SELECT ticker, date, close, " + ", ".join(f"{roll_sql('stddev_samp({})', 'r', n)} * {52**0.5 * 100!r} AS v{n}" for n in (4, 8, 13)) + f", lead(close, 4) {over()} / close - 1 AS f4 FROM lr)"


def _vols(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("r", P.log_return("close"))
    return b.select("ticker", "date", "close", *[(P.rolling(F.stddev_samp, "r", n) * (52**0.5 * 100)).alias(f"v{n}") for n in (4, 8, 13)], P.forward_return("close", 4).alias("f4"))


@_add(
    "volatility_signals",
    _VOLS
    + f" SELECT ticker, date, {r6_sql('v8 - v4', 'premium')}, {r6_sql('v13 / nullif(v4, 0)', 'slope')}, CASE WHEN v8 - v4 > 50 THEN 1 WHEN v8 - v4 < -50 THEN -1 ELSE 0 END AS premium_signal, CASE WHEN v13 / nullif(v4, 0) > 1.5 THEN 1 WHEN v13 / nullif(v4, 0) < 0.5 THEN -1 ELSE 0 END AS slope_signal FROM v WHERE v13 IS NOT NULL AND v4 > 0",
)
def volatility_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility premium (long less short window), slope of the term structure, threshold signals."""
    v = _vols(spark, sf).where("v13 is not null and v4 > 0")
    p, s = F.col("v8") - F.col("v4"), F.col("v13") / F.nullif("v4", F.lit(0.0))
    return v.select("ticker", "date", r6(p, "premium"), r6(s, "slope"), F.when(p > 50, 1).when(p < -50, -1).otherwise(0).alias("premium_signal"), F.when(s > 1.5, 1).when(s < 0.5, -1).otherwise(0).alias("slope_signal"))


@_add("premium_ic_by_year", _VOLS + f" SELECT year(date) AS year, count(*) AS n, {r6_sql('CASE WHEN count(*) >= 30 THEN corr(v8 - v4, f4) END', 'ic')} FROM v WHERE v8 IS NOT NULL AND v4 IS NOT NULL AND f4 IS NOT NULL GROUP BY 1")
def premium_ic_by_year(spark: SparkSession, sf: str) -> DataFrame:
    v = _vols(spark, sf).where("v8 is not null and v4 is not null and f4 is not null")
    n = F.count(F.lit(1))
    return v.groupBy(F.year("date").alias("year")).agg(n.alias("n"), r6(F.when(n >= 30, F.corr(F.col("v8") - F.col("v4"), "f4")), "ic"))


@_add(
    "term_structure_panel",
    bars_sql("day")
    + ", t AS (SELECT left(ticker, 7) AS family, CAST(right(ticker, 1) AS INTEGER) AS tenor, date, close FROM bars) SELECT family, date, "
    + ", ".join(f"max(CASE WHEN tenor = {i} THEN close END) AS c{i}" for i in range(1, 6))
    + ", max(CASE WHEN tenor = 2 THEN close END) / max(CASE WHEN tenor = 1 THEN close END) AS slope, max(CASE WHEN tenor = 5 THEN close END) - max(CASE WHEN tenor = 1 THEN close END) AS difference FROM t GROUP BY 1, 2",
)
def term_structure_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The five tenors of every family on the union of their dates, with slopes; one grouping instead of outer joins."""
    b = bars(spark, sf, "day").select(F.substring("ticker", 1, 7).alias("family"), F.expr("int(right(ticker, 1))").alias("tenor"), "date", "close")
    wide = b.groupBy("family", "date").agg(*[F.max(F.when(F.col("tenor") == i, F.col("close"))).alias(f"c{i}") for i in range(1, 6)])
    return wide.select("*", (F.col("c2") / F.col("c1")).alias("slope"), (F.col("c5") - F.col("c1")).alias("difference"))


_STRESS = (("first", "1996-02-01", "1996-06-30"), ("second", "1998-08-01", "1998-12-31"), ("outside", "2030-01-01", "2030-02-01"))
_STRESS_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in _STRESS) + ") st(period, a, z)"


@_add(
    "stress_losses",
    _LR
    + f", x AS (SELECT st.period, st.a, ticker, date, close FROM bars JOIN {_STRESS_SQL} ON date BETWEEN st.a AND st.z), e AS (SELECT *, first_value(close) OVER (PARTITION BY period, ticker ORDER BY date) AS c0 FROM x) SELECT period, ticker, {r6_sql('max(1 - close / c0)', 'worst_from_entry')}, CASE WHEN date_diff('day', min(a), min(date)) <= 5 THEN 'COVERED' ELSE 'PARTIAL' END AS coverage FROM e GROUP BY 1, 2",
)
def stress_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Worst loss since the entry of each stress period (not since a running peak), with coverage."""
    st = spark.createDataFrame(list(_STRESS), "period string, a string, z string").select("period", F.to_date("a").alias("a"), F.to_date("z").alias("z"))
    x = bars(spark, sf).select("ticker", "date", "close").join(F.broadcast(st), F.col("date").between(F.col("a"), F.col("z")))  # three periods
    w = Window.partitionBy("period", "ticker").orderBy("date")
    e = x.withColumn("c0", F.first("close").over(w))
    late = F.datediff(F.min("date"), F.min("a"))
    return e.groupBy("period", "ticker").agg(r6(F.max(1 - F.col("close") / F.col("c0")), "worst_from_entry"), F.when(late <= 5, "COVERED").otherwise("PARTIAL").alias("coverage"))


_ENTRY = "WITH t AS (SELECT DISTINCT agg_trade_id, symbol, exchange_ts_ns AS ts, price FROM trade_events WHERE exchange_ts_ns IS NOT NULL AND price > 0 AND isfinite(price)), c AS (SELECT symbol, max(ts) AS close_ts FROM t GROUP BY 1), j AS (SELECT t.*, c.close_ts FROM t JOIN c USING (symbol))"


@_add(
    "entry_price",
    _ENTRY
    + " SELECT symbol, close_ts, coalesce(arg_max(price, ts) FILTER (WHERE ts <= close_ts - 600000000000), arg_max(price, ts) FILTER (WHERE ts < close_ts)) AS entry_price, coalesce(max(ts) FILTER (WHERE ts <= close_ts - 600000000000), max(ts) FILTER (WHERE ts < close_ts)) AS entry_ts FROM j GROUP BY 1, 2 HAVING count(CASE WHEN ts < close_ts THEN 1 END) > 0",
)
def entry_price(spark: SparkSession, sf: str) -> DataFrame:
    """Price ten minutes before a symbol's last trade, else the last one before it; symbols without either are skipped."""
    t = _trades(spark, sf).where("price > 0 and not isnan(price) and price < double('inf')").select("symbol", "ts", "price")
    j = t.join(t.groupBy("symbol").agg(F.max("ts").alias("close_ts")), "symbol")
    early, before = F.col("ts") <= F.col("close_ts") - 600_000_000_000, F.col("ts") < F.col("close_ts")
    row = F.struct("ts", "price")
    g = j.groupBy("symbol", "close_ts").agg(F.max(F.when(early, row)).alias("a"), F.max(F.when(before, row)).alias("b"))
    e = F.coalesce("a", "b")
    return g.where("b is not null").select("symbol", "close_ts", e["price"].alias("entry_price"), e["ts"].alias("entry_ts"))


@_add("no_look_ahead", "SELECT count(*) AS n, count(CASE WHEN NOT (submitted_at < filled_at) THEN 1 END) AS n_violations, count(CASE WHEN filled_at IS NULL THEN 1 END) AS n_open FROM (SELECT DISTINCT * FROM exec_orders)")
def no_look_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """Fills must come after their submission."""
    o = table(spark, sf, "exec_orders").select("order_id", "submitted_at", "filled_at").distinct()
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(F.col("submitted_at") < F.col("filled_at"))).alias("n_violations"), F.count_if(F.col("filled_at").isNull()).alias("n_open"))


@_add(
    "exchange_coverage",
    "WITH d AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem), c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d) SELECT year(c.day) AS year, count(*) AS n_weekdays, count(d.day) AS n_present FROM c LEFT JOIN d ON d.day = c.day WHERE isodow(c.day) < 6 GROUP BY 1",
)
def exchange_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Weekdays with and without data, by year."""
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    c = d.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(S.business_days(F.col("a"), F.col("z"))).alias("day"))
    j = c.join(d.withColumn("there", F.lit(1)), "day", "left")
    return j.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n_weekdays"), F.count("there").alias("n_present"))


@_add(
    "top_weights",
    "WITH w AS (SELECT s.account_id, s.recorded_at, w.key AS ticker, CAST(w.value AS DOUBLE) AS w FROM (SELECT DISTINCT account_id, recorded_at, weights FROM snapshots WHERE weights IS NOT NULL) s, json_each(s.weights) w), k AS (SELECT *, row_number() OVER (PARTITION BY account_id, recorded_at ORDER BY abs(w) DESC, ticker) AS u FROM w), t AS (SELECT * FROM k WHERE u <= 2) SELECT account_id, recorded_at, ticker, round(w / nullif(sum(abs(w)) OVER (PARTITION BY account_id, recorded_at), 0), 6) + 0.0 AS weight FROM t",
)
def top_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The two largest weights by size of each snapshot, rescaled to a gross of 1."""
    s = table(spark, sf, "snapshots").where("weights is not null").select("account_id", "recorded_at", "weights").distinct()
    w = s.select("account_id", "recorded_at", F.explode(F.from_json("weights", "map<string,double>")).alias("ticker", "w"))
    by = Window.partitionBy("account_id", "recorded_at")
    t = w.withColumn("u", F.row_number().over(by.orderBy(F.abs("w").desc(), "ticker"))).where("u <= 2")
    return t.select("account_id", "recorded_at", "ticker", r6(F.col("w") / F.nullif(F.sum(F.abs("w")).over(by), F.lit(0.0)), "weight"))


_COMB = (
    _SCORES.split("comp AS")[0].rstrip().rstrip(",")
    + f""", fw AS (SELECT ticker, date, lead(close) {over()} / close - 1 AS fwd FROM bars), zz AS (SELECT z.*, fw.fwd FROM z JOIN fw USING (ticker, date)),
ic AS (SELECT factor, avg(c) AS w FROM (SELECT factor, date, corr(z, fwd) AS c FROM zz WHERE z IS NOT NULL AND fwd IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1)
SELECT date, ticker, round(sum(z * w) / sum(abs(w)), 6) + 0.0 AS combined FROM zz JOIN ic USING (factor) GROUP BY 1, 2"""
)


@_add("ic_weighted_combination", _COMB)
def ic_weighted_combination(spark: SparkSession, sf: str) -> DataFrame:
    """Factors combined with their mean information coefficients as weights."""
    s = _scores(spark, sf).where("score is not null")
    w = Window.partitionBy("date", "factor")
    z = s.withColumn("z", (F.col("score") - F.avg("score").over(w)) / F.greatest(F.stddev_samp("score").over(w), F.lit(1e-8)))
    fwd = bars(spark, sf).select("ticker", "date", P.forward_return("close", 1).alias("fwd"))
    zz = z.join(fwd, ["ticker", "date"])
    good = zz.where("z is not null and fwd is not null")
    ic = good.groupBy("factor", "date").agg(F.corr("z", "fwd").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 10").groupBy("factor").agg(F.avg("c").alias("w"))
    return zz.join(ic, "factor").groupBy("date", "ticker").agg(r6(F.sum(F.col("z") * F.col("w")) / F.sum(F.abs("w")), "combined"))


_LAGS = (1, 5, 21)


@_add(
    "crowding",
    bars_sql("day")
    + f", q AS (SELECT * FROM (SELECT ticker, date, {ret_sql('close')} AS ret FROM bars) WHERE ret IS NOT NULL), k AS (SELECT *, {', '.join(f'lag(ret, {n}) {over()} AS p{n}' for n in _LAGS)}, 2 * row_number() {over()} <= count(*) OVER (PARTITION BY ticker) AS early FROM q) SELECT ticker, "
    + ", ".join(r6_sql(f"corr(CASE WHEN {c} THEN ret END, CASE WHEN {c} THEN p{n} END)", f"{w}_{n}") for n in _LAGS for w, c in (("early", "early"), ("late", "NOT early")))
    + ", "
    + ", ".join(r6_sql(f"avg(CASE WHEN {c} THEN ret END) / nullif(stddev_samp(CASE WHEN {c} THEN ret END), 0) * sqrt(252)", f"sharpe_{w}") for w, c in (("early", "early"), ("late", "NOT early")))
    + f", {r6_sql('avg(CASE WHEN NOT early THEN ret END) / nullif(stddev_samp(CASE WHEN NOT early THEN ret END), 0) * sqrt(252) - avg(CASE WHEN early THEN ret END) / nullif(stddev_samp(CASE WHEN early THEN ret END), 0) * sqrt(252)', 'decay')} FROM k GROUP BY 1",
)
def crowding(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation at 1, 5 and 21 days and Sharpe ratio in the first and the second half of each name's life, and the decay."""
    r = bars(spark, sf, "day").select("ticker", "date", P.simple_return("close").alias("ret")).where("ret is not null")
    k = r.withColumns({f"p{n}": P.lag("ret", n) for n in _LAGS} | {"early": 2 * F.row_number().over(P.ts()) <= F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    halves = {"early": F.col("early"), "late": ~F.col("early")}

    def sharpe(c):
        x = F.when(c, F.col("ret"))
        return F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * 252**0.5

    return k.groupBy("ticker").agg(
        *[r6(F.corr(F.when(c, F.col("ret")), F.when(c, F.col(f"p{n}"))), f"{w}_{n}") for n in _LAGS for w, c in halves.items()],
        *[r6(sharpe(c), f"sharpe_{w}") for w, c in halves.items()], r6(sharpe(halves["late"]) - sharpe(halves["early"]), "decay"),
    )


@_add("request_rate", "WITH s AS (SELECT symbol, exchange_ts_ns // 1000000000 AS sec, count(DISTINCT agg_trade_id) AS n FROM trade_events WHERE exchange_ts_ns IS NOT NULL GROUP BY 1, 2) SELECT symbol, sec, sum(n) OVER (PARTITION BY symbol ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)::BIGINT AS last_minute FROM s")
def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Trades of the last 60 seconds at every active second; counted by second first, so the window follows time, not rows.

    Windows run per symbol and hour; the last 59 seconds of an hour go to the next as well, so no symbol is one task.
    """
    s = _trades(spark, sf).groupBy("symbol", F.expr("ts div 1000000000").alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    hour, late = F.expr("sec div 3600"), F.pmod("sec", F.lit(3600)) > 3600 - 60
    s = s.withColumn("hour", hour).withColumn("block", F.explode(F.array_compact(F.array(hour, F.when(late, hour + 1)))))
    near = Window.partitionBy("symbol", "block").orderBy("sec").rangeBetween(-59, 0)
    return s.withColumn("last_minute", F.sum("n").over(near)).where("block = hour").select("symbol", "sec", "last_minute")


@_add("settlements", _BIN + ", x AS (SELECT l_orderkey, p, y, CASE WHEN p < 0.5 THEN 'yes' ELSE 'no' END AS side, CASE WHEN p < 0.5 THEN p ELSE 1 - p END AS paid FROM b) SELECT side, count(*) AS n, round(sum(10 * ((CASE WHEN (side = 'yes' AND y = 1) OR (side = 'no' AND y = 0) THEN 1 ELSE 0 END) - paid) - ceil(100 * 0.07 * 10 * paid * (1 - paid) - 1e-9) / 100), 4) AS pnl FROM x GROUP BY 1")
def settlements(spark: SparkSession, sf: str) -> DataFrame:
    """Profit of ten contracts of each forecast, bought on the cheap side, after fees."""
    b = _binary(spark, sf)
    side, paid = F.when(F.col("p") < 0.5, "yes").otherwise("no"), F.when(F.col("p") < 0.5, F.col("p")).otherwise(1 - F.col("p"))
    x = b.select("y", side.alias("side"), paid.alias("paid"))
    pnl = S.settlement_pnl(F.col("side"), F.col("paid"), F.col("y"), 10.0, S.contract_fee(0.07, 10.0, F.col("paid")))
    return x.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(pnl), 4).alias("pnl"))


@_add("open_market_price", "SELECT DISTINCT last_update_id, coalesce(mid, (bid_px_1 + ask_px_1) / 2, ask_px_1, bid_px_1) AS price, CASE WHEN mid IS NOT NULL THEN 'last' WHEN bid_px_1 IS NOT NULL AND ask_px_1 IS NOT NULL THEN 'mid' WHEN ask_px_1 IS NOT NULL THEN 'ask' WHEN bid_px_1 IS NOT NULL THEN 'bid' END AS source FROM book_snapshots")
def open_market_price(spark: SparkSession, sf: str) -> DataFrame:
    """Price of an open market: last, else mid, else ask, else bid."""
    b, a, m = F.col("bid_px_1"), F.col("ask_px_1"), F.col("mid")
    source = F.when(m.isNotNull(), "last").when(b.isNotNull() & a.isNotNull(), "mid").when(a.isNotNull(), "ask").when(b.isNotNull(), "bid")
    return table(spark, sf, "book_snapshots").select("last_update_id", F.coalesce(m, (b + a) / 2, a, b).alias("price"), source.alias("source")).distinct()


@_add("period_kinds", "SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days, CASE WHEN date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) BETWEEN 85 AND 95 THEN 'quarterly' WHEN date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) BETWEEN 175 AND 190 THEN 'half' WHEN date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) BETWEEN 265 AND 280 THEN 'nine_months' WHEN date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) BETWEEN 355 AND 380 THEN 'annual' ELSE 'other' END AS kind FROM orders GROUP BY 1")
def period_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kind of a reporting period by its length."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")).cast("bigint").alias("days"))
    d = F.col("days")
    kind = F.when(d.between(85, 95), "quarterly").when(d.between(175, 190), "half").when(d.between(265, 280), "nine_months").when(d.between(355, 380), "annual").otherwise("other")
    return g.select("o_custkey", "days", kind.alias("kind"))


@_add("unpivot_wide", bars_sql("day") + " SELECT ticker, date, field, price FROM (SELECT ticker, date, open, close FROM bars) UNPIVOT (price FOR field IN (open, close))")
def unpivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf, "day").select("ticker", "date", "open", "close").unpivot(["ticker", "date"], ["open", "close"], "field", "price")


@_add("contract_hashes", "SELECT p_partkey, sha256(p_partkey || '|' || p_name || '|' || p_size) AS digest FROM part")
def contract_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of a pre-registered row."""
    return table(spark, sf, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_partkey", "p_name", "p_size"), 256).alias("digest"))


_U = over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


@_add(
    "momentum_legs",
    _LR
    + f""", ch AS (SELECT date, ticker, close * volume AS cap, {lag_sql('close', 4)} / {lag_sql('close', 52)} - 1 AS mom, lead(close) {over()} / close - 1 AS fwd FROM lr),
ok AS (SELECT *, median(cap) OVER (PARTITION BY date) AS mc, quantile_cont(mom, 0.3) OVER (PARTITION BY date) AS lo, quantile_cont(mom, 0.7) OVER (PARTITION BY date) AS hi FROM ch WHERE cap > 0 AND mom IS NOT NULL AND fwd IS NOT NULL),
lg AS (SELECT date, cap > mc AS big, CASE WHEN mom <= lo THEN 'loser' WHEN mom > hi THEN 'winner' ELSE 'mid' END AS leg, sum(cap * fwd) / sum(cap) AS ret FROM ok GROUP BY 1, 2, 3)
SELECT date, {r6_sql("avg(CASE WHEN leg = 'winner' THEN ret END) - avg(CASE WHEN leg = 'loser' THEN ret END)", 'umd')} FROM lg GROUP BY 1""",
)
def momentum_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Winners less losers across both sizes, value-weighted."""
    b = bars(spark, sf)
    ch = b.select("date", "ticker", (F.col("close") * F.col("volume")).alias("cap"), (P.lag("close", 4) / P.lag("close", 52) - 1).alias("mom"), P.forward_return("close", 1).alias("fwd"))
    ok = ch.where("cap > 0 and mom is not null and fwd is not null").withColumns({"mc": F.percentile("cap", F.lit(0.5)).over(P.cs()), "lo": F.percentile("mom", F.lit(0.3)).over(P.cs()), "hi": F.percentile("mom", F.lit(0.7)).over(P.cs())})
    leg = F.when(F.col("mom") <= F.col("lo"), "loser").when(F.col("mom") > F.col("hi"), "winner").otherwise("mid")
    lg = ok.groupBy("date", (F.col("cap") > F.col("mc")).alias("big"), leg.alias("leg")).agg((F.sum(F.col("cap") * F.col("fwd")) / F.sum("cap")).alias("ret"))
    return lg.groupBy("date").agg(r6(F.avg(F.when(F.col("leg") == "winner", F.col("ret"))) - F.avg(F.when(F.col("leg") == "loser", F.col("ret"))), "umd"))


@_add(
    "clamped_growth",
    _RET + f" SELECT ticker, count(*) AS n, {r6_sql('product(1 + greatest(least(ret, 0.2), -0.2))', 'growth')} FROM q GROUP BY 1",
)
def clamped_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Growth with each step kept within 20 %, as a fold over the ordered array of returns."""
    a = _returns(spark, sf).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "ret"))).alias("path"))  # one row a week
    fold = F.aggregate("path", F.lit(1.0), lambda acc, x: acc * (1 + F.greatest(F.least(x["ret"], F.lit(0.2)), F.lit(-0.2))))
    return a.select("ticker", F.size("path").cast("bigint").alias("n"), r6(fold, "growth"))


_ex = over("ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING")


@_add("regime_features", _LR + f", p AS (SELECT *, lag(r) {over()} AS q FROM lr) SELECT ticker, date, {r6_sql(f'corr(r, q) {_ex}', 'autocorrelation')}, {r6_sql(f'stddev_samp(r) {_ex} * {52**0.5!r}', 'volatility')}, {r6_sql(f'volume / nullif(avg(volume) {_ex}, 0)', 'volume_ratio')} FROM p QUALIFY count(q) {_ex} >= 21")
def regime_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the 21 rows before each row."""
    b = bars(spark, sf).withColumn("r", P.log_return("close")).withColumn("q", P.lag("r"))
    w = P.ts().rowsBetween(-21, -1)
    f = b.select("ticker", "date", F.corr("r", "q").over(w).alias("ac"), (F.stddev_samp("r").over(w) * 52**0.5).alias("vol"), (F.col("volume") / F.nullif(F.avg("volume").over(w), F.lit(0.0))).alias("vr"), F.count("q").over(w).alias("n"))
    return f.where("n >= 21").select("ticker", "date", r6("ac", "autocorrelation"), r6("vol", "volatility"), r6("vr", "volume_ratio"))


@_add(
    "baseline_portfolios",
    _LR
    + f""", m AS (SELECT date, ticker, {ret_sql('close', 4)} AS mom, lead(close) {over()} / close - 1 AS fwd FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS u FROM m WHERE mom IS NOT NULL AND fwd IS NOT NULL),
d AS (SELECT date, avg(fwd) AS equal, avg(CASE WHEN u <= 5 THEN fwd END) AS top5 FROM k GROUP BY 1)
SELECT year(date) AS year, count(*) AS n, {r6_sql('avg(equal) / nullif(stddev_samp(equal), 0) * sqrt(52)', 'equal_sharpe')}, {r6_sql('avg(top5) / nullif(stddev_samp(top5), 0) * sqrt(52)', 'top5_sharpe')} FROM d GROUP BY 1""",
)
def baseline_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    """Equal weight and five strongest names, by year."""
    m = bars(spark, sf).select("date", "ticker", P.simple_return("close", 4).alias("mom"), P.forward_return("close", 1).alias("fwd")).where("mom is not null and fwd is not null")
    k = m.withColumn("u", F.row_number().over(P.cs().orderBy(F.desc("mom"), "ticker")))
    d = k.groupBy("date").agg(F.avg("fwd").alias("equal"), F.avg(F.when(F.col("u") <= 5, F.col("fwd"))).alias("top5"))

    def sr(c: str):
        return F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * 52**0.5

    return d.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), r6(sr("equal"), "equal_sharpe"), r6(sr("top5"), "top5_sharpe"))


@_add("ridge_baseline")
def ridge_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge on past features, refitted every 13 weeks on the 52 before, one task per sector."""
    b = bars(spark, sf).withColumn("r", P.log_return("close"))
    f = b.select("sector", "ticker", "date", P.simple_return("close", 1).alias("x1"), P.simple_return("close", 4).alias("x2"), P.rolling(F.stddev_samp, "r", 4).alias("x3"), P.forward_return("close", 1).alias("y")).na.drop()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        days = np.sort(pdf["date"].unique())
        out = []
        for t in range(52, len(days), 13):
            train = pdf[(pdf["date"] >= days[t - 52]) & (pdf["date"] < days[t - 1])]  # the last label is not yet known
            test = pdf[(pdf["date"] >= days[t]) & (pdf["date"] < days[min(t + 13, len(days) - 1)])]
            if len(train) < 20 or test.empty:
                continue
            x, m, s = train[["x1", "x2", "x3"]].to_numpy(), train[["x1", "x2", "x3"]].mean().to_numpy(), train[["x1", "x2", "x3"]].std().to_numpy() + 1e-12
            z = (x - m) / s
            w = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (train["y"] - train["y"].mean()).to_numpy())
            out.append(test[["sector", "ticker", "date", "y"]].assign(forecast=(test[["x1", "x2", "x3"]].to_numpy() - m) / s @ w + train["y"].mean()))
        return pd.concat(out) if out else pd.DataFrame(columns=["sector", "ticker", "date", "y", "forecast"])

    return f.groupBy("sector").applyInPandas(run, "sector int, ticker string, date date, y double, forecast double")


@_add("recalibration")
def recalibration(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic recalibration of forecasts by year, on counts per forecast value (no task sees rows)."""
    b = _binary(spark, sf).groupBy(F.year("l_shipdate").alias("year"), F.round("p", 6).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k = pdf["n"].to_numpy(float), pdf["k"].to_numpy(float)
        slope, intercept = ST.logistic_recalibration(np.repeat(pdf["p"].to_numpy(float), 2), np.tile([0.0, 1.0], len(pdf)), weights=np.column_stack([n - k, k]).ravel())
        return pd.DataFrame({"year": [pdf["year"].iloc[0]], "n": [int(n.sum())], "slope": [slope], "intercept": [intercept]})

    return b.groupBy("year").applyInPandas(run, "year int, n bigint, slope double, intercept double")


__all__ = ["FA", "ORACLE", "QUERIES", "ST", "B", "_mom"]
