"""Pair statistics by Gram sums, characteristic legs, option cycles, archives, snapshots and files held against each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import panel as P
from tidemark.operators import backtest as BT
from tidemark.operators import pairs, schema_drift, snapshot_diff
from tidemark.plans.base import B, bars, lag_sql, over, r6, r6_sql, roll_sql
from tidemark.plans.panel import _LR
from tidemark.plans.relational import cdf_sql, ppf_sql
from tidemark.session import table
from tidemark.sources import store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


# --- pairs ---


@_add(
    "cointegration_scan",
    B
    + f""", k AS (SELECT ticker, date, ln(close) AS v, dense_rank() OVER (ORDER BY date) AS k FROM bars), pr AS (SELECT a.ticker AS y_name, b.ticker AS x_name, a.k, a.v AS y, b.v AS x FROM k a JOIN k b ON a.k = b.k AND a.ticker <> b.ticker),
f AS (SELECT y_name, x_name, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pr GROUP BY 1, 2), e AS (SELECT y_name, x_name, k, b, y - a - b * x AS e FROM pr JOIN f USING (y_name, x_name)),
l AS (SELECT e.*, e.e - p.e AS d, p.e AS e0 FROM e JOIN e p ON p.y_name = e.y_name AND p.x_name = e.x_name AND p.k = e.k - 1),
s AS (SELECT y_name, x_name, max(b) AS b, count(*) AS n, regr_slope(d, e0) AS g, regr_sxx(d, e0) AS sxx, regr_syy(d, e0) AS syy, regr_sxy(d, e0) AS sxy FROM l GROUP BY 1, 2),
t AS (SELECT y_name, x_name, n, b, g / sqrt((syy - g * sxy) / (n - 2) / sxx) AS t FROM s)
SELECT y_name, x_name, n, round(b, 5) + 0.0 AS hedge_ratio, round(t, 4) AS t_stat, row_number() OVER (ORDER BY t, y_name, x_name) AS position FROM t QUALIFY position <= 20""",
)
def cointegration_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty ordered pairs of names whose spread reverts most surely (a top-k report), from Gram sums."""
    b = bars(spark, sf).select("date", "ticker", F.log("close").alias("value"))
    names = pairs.universe(b)
    ratio, t, n = pairs.dickey_fuller(pairs.pair_sums(pairs.centred(b), names))
    t[np.diag_indices(len(names))] = np.nan
    found = sorted((t[i, j], names[i], names[j], int(n[i, j]), ratio[i, j]) for i, j in np.argwhere(np.isfinite(t)))[:20]
    rows = [(y, x, k, round(float(r), 5) + 0.0, round(float(s), 4), p) for p, (s, y, x, k, r) in enumerate(found, 1)]
    return spark.createDataFrame(rows, "y_name string, x_name string, n bigint, hedge_ratio double, t_stat double, position bigint")


@_add("pairs_backtest")
def pairs_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The state machine on the pairs that the scan chose; each name's series joins its pairs only."""
    chosen = cointegration_scan(spark, sf).select(F.concat_ws("/", "y_name", "x_name").alias("pair"), "y_name", "x_name")
    b = bars(spark, sf).select("ticker", "date", "close")
    y = b.join(F.broadcast(chosen), F.col("ticker") == F.col("y_name")).select("pair", "date", F.col("close").alias("y"))  # twenty pairs
    x = b.join(F.broadcast(chosen), F.col("ticker") == F.col("x_name")).select("pair", "date", F.col("close").alias("x"))
    return BT.pairs_trading(y.join(x, ["pair", "date"]))


# --- characteristic legs, formed each June ---

_CHARS = {"hml": "value", "rmw": "profit", "cma": "growth"}


def _legs_sql() -> str:
    parts = []
    for leg, c in _CHARS.items():
        parts.append(
            f"{leg}_r AS (SELECT q.date, cap > mc AS big, CASE WHEN {c} <= lo_{c} THEN 'low' WHEN {c} > hi_{c} THEN 'high' ELSE 'mid' END AS g, sum(cap * ret) / sum(cap) AS ret FROM q JOIN fo USING (ticker, fy) GROUP BY 1, 2, 3), "
            f"{leg} AS (SELECT date, avg(CASE WHEN g = 'high' THEN ret END) - avg(CASE WHEN g = 'low' THEN ret END) AS {leg}, avg(CASE WHEN NOT big THEN ret END) - avg(CASE WHEN big THEN ret END) AS {leg}_size FROM {leg}_r GROUP BY 1)"
        )
    return ", ".join(parts)


@_add(
    "june_legs",
    B
    + f""", c AS (SELECT ticker, date, close * volume AS cap, {lag_sql('close', 26)} / close AS value, close / open - 1 AS profit, volume / nullif({lag_sql('volume', 26)}, 0) - 1 AS growth FROM bars),
f0 AS (SELECT ticker, year(date) AS fy, arg_max(cap, date) AS cap, arg_max(value, date) AS value, arg_max(profit, date) AS profit, arg_max(growth, date) AS growth FROM c WHERE month(date) = 6 AND value IS NOT NULL AND growth IS NOT NULL AND cap > 0 GROUP BY 1, 2),
fo AS (SELECT *, median(cap) OVER w AS mc, {', '.join(f'quantile_cont({c}, 0.3) OVER w AS lo_{c}, quantile_cont({c}, 0.7) OVER w AS hi_{c}' for c in _CHARS.values())} FROM f0 WINDOW w AS (PARTITION BY fy)),
q AS (SELECT ticker, date, CASE WHEN month(date) >= 7 THEN year(date) ELSE year(date) - 1 END AS fy, close / {lag_sql('close')} - 1 AS ret FROM bars QUALIFY ret IS NOT NULL), {_legs_sql()}
SELECT date, {r6_sql('(hml_size + rmw_size + cma_size) / 3', 'smb')}, {', '.join(r6_sql(x, x) for x in _CHARS)} FROM hml JOIN rmw USING (date) JOIN cma USING (date)""",
)
def june_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Size, value, profitability and investment legs: 2 x 3 sorts formed each June, value-weighted from July on.

    The three sorts of a date are taken in one pass over the returns.
    """
    b = bars(spark, sf)
    c = b.select("ticker", "date", (F.col("close") * F.col("volume")).alias("cap"), (P.lag("close", 26) / F.col("close")).alias("value"), (F.col("close") / F.col("open") - 1).alias("profit"), (F.col("volume") / F.nullif(P.lag("volume", 26), F.lit(0.0)) - 1).alias("growth"))
    june = c.where("month(date) = 6 and value is not null and growth is not null and cap > 0")
    f = june.groupBy("ticker", F.year("date").alias("fy")).agg(F.max_by(F.struct("cap", *_CHARS.values()), "date").alias("c")).select("ticker", "fy", "c.*")
    w = Window.partitionBy("fy")
    f = f.withColumn("mc", F.percentile("cap", F.lit(0.5)).over(w)).withColumns({f"{s}_{x}": F.percentile(x, F.lit(q)).over(w) for x in _CHARS.values() for s, q in (("lo", 0.3), ("hi", 0.7))})

    def third(x: str) -> Column:
        return F.when(F.col(x) <= F.col(f"lo_{x}"), "low").when(F.col(x) > F.col(f"hi_{x}"), "high").otherwise("mid")

    sorts = F.array(*[F.struct(F.lit(leg).alias("leg"), third(x).alias("g")) for leg, x in _CHARS.items()])
    f = f.select("ticker", "fy", "cap", (F.col("cap") > F.col("mc")).alias("big"), F.inline(sorts))
    q = b.select("ticker", "date", S.formation_year(F.col("date")).alias("fy"), (F.col("close") / P.lag("close") - 1).alias("ret")).where("ret is not null")
    r = q.join(f, ["ticker", "fy"]).groupBy("date", "leg", "big", "g").agg((F.sum(F.col("cap") * F.col("ret")) / F.sum("cap")).alias("ret"))

    def mean(cond: Column) -> Column:
        return F.avg(F.when(cond, F.col("ret")))

    size = (sum((mean((F.col("leg") == leg) & ~F.col("big")) - mean((F.col("leg") == leg) & F.col("big")) for leg in _CHARS), F.lit(0.0))) / 3
    spreads = [r6(mean((F.col("leg") == leg) & (F.col("g") == "high")) - mean((F.col("leg") == leg) & (F.col("g") == "low")), leg) for leg in _CHARS]
    return r.groupBy("date").agg(r6(size, "smb"), *spreads)


# --- options ---


@_add("strike_search", f"WITH o AS (SELECT p_partkey, p_retailprice AS s, 0.2 + (p_size % 40) / 100.0 AS v, 0.3 + (p_partkey % 20) / 20.0 AS t, 0.1 + (p_partkey % 9) / 20.0 AS d FROM part), z AS (SELECT *, {ppf_sql('d')} AS z FROM o) SELECT p_partkey, round(s * exp(-z * v * sqrt(t) + (0.02 + v * v / 2) * t), 3) AS strike FROM z")
def strike_search(spark: SparkSession, sf: str) -> DataFrame:
    """Strike of a call's delta by a bracketed search: the bracket is doubled until it holds the root, then halved, as folds in generated code."""
    v, t, d = 0.2 + (F.col("p_size") % 40) / 100.0, 0.3 + (F.col("p_partkey") % 20) / 20.0, 0.1 + (F.col("p_partkey") % 9) / 20.0
    o = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("s"), v.alias("v"), t.alias("t"), d.alias("d"))

    def too_high(k: Column) -> Column:  # delta falls with the strike
        return S.bs_delta(F.col("s"), k, F.col("v"), F.col("t"), 0.02, True) < F.col("d")

    widened = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.col("s") * 2.0, lambda hi, _: F.when(too_high(hi), hi).otherwise(hi * 2.0))
    o = o.withColumn("top", widened)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        high = too_high(mid)
        return F.struct(F.when(high, acc["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(acc["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct((F.col("s") * 1e-3).alias("lo"), F.col("top").alias("hi")), halve)
    return o.select("p_partkey", F.round(found["hi"], 3).alias("strike"))


_RATE, _YEARS = 0.02, 4 / 52
_SPREAD = 0.05


def _d1_sql(k: str) -> str:
    return f"((ln(s / {k}) + ({_RATE} + v * v / 2) * {_YEARS!r}) / (v * sqrt({_YEARS!r})))"


@_add(
    "condor_cycles",
    _LR
    + f""", v AS (SELECT ticker, date, close AS s, {roll_sql('stddev_samp({})', 'r', 8)} * sqrt(52) AS v, row_number() {over()} AS k, lead(close, 4) {over()} AS e, lead(date, 4) {over()} AS expiry FROM lr), o AS (SELECT * FROM v WHERE k % 4 = 0 AND v > 0 AND e IS NOT NULL),
st AS (SELECT *, s * exp(-({ppf_sql('0.84::DOUBLE')}) * v * sqrt({_YEARS!r}) + ({_RATE} + v * v / 2) * {_YEARS!r}) AS kp, s * exp(-({ppf_sql('0.16::DOUBLE')}) * v * sqrt({_YEARS!r}) + ({_RATE} + v * v / 2) * {_YEARS!r}) AS kc FROM o),
lg AS (SELECT *, 1 AS sign, FALSE AS call, kp AS k0 FROM st UNION ALL SELECT *, -1, FALSE, kp - {_SPREAD} * s FROM st UNION ALL SELECT *, 1, TRUE, kc FROM st UNION ALL SELECT *, -1, TRUE, kc + {_SPREAD} * s FROM st),
dd AS (SELECT *, {_d1_sql('k0')} AS a, {_d1_sql('k0')} - v * sqrt({_YEARS!r}) AS b FROM lg),
legs AS (SELECT ticker, date, expiry, s, sign * (CASE WHEN call THEN s * {cdf_sql('a')} - k0 * exp({-_RATE * _YEARS!r}) * {cdf_sql('b')} ELSE k0 * exp({-_RATE * _YEARS!r}) * {cdf_sql('(-b)')} - s * {cdf_sql('(-a)')} END) AS credit, -sign * CASE WHEN call THEN greatest(e - k0, 0) ELSE greatest(k0 - e, 0) END AS payoff FROM dd)
SELECT ticker, date AS opened, expiry, round(sum(credit) / max(s), 6) + 0.0 AS credit, round(sum(payoff) / max(s), 6) + 0.0 AS payoff, round((sum(credit) + sum(payoff)) / max(s), 6) + 0.0 AS pnl FROM legs GROUP BY 1, 2, 3""",
)
def condor_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Iron condors opened every four weeks at 16 deltas and held to expiry: credit, payoff and profit as shares of the price."""
    b = bars(spark, sf).withColumn("r", P.log_return("close"))
    o = b.select("ticker", "date", F.col("close").alias("s"), (P.rolling(F.stddev_samp, "r", 8) * 52**0.5).alias("v"), F.row_number().over(P.ts()).alias("k"), P.lag("close", -4).alias("e"), P.lag("date", -4).alias("expiry"))
    o = o.where("k % 4 = 0 and v > 0 and e is not null")
    s, v = F.col("s"), F.col("v")
    o = o.withColumns({"kp": S.strike_for_delta(s, -0.16, v, _YEARS, _RATE, False), "kc": S.strike_for_delta(s, 0.16, v, _YEARS, _RATE, True)})
    legs = [(1, False, F.col("kp")), (-1, False, F.col("kp") - _SPREAD * s), (1, True, F.col("kc")), (-1, True, F.col("kc") + _SPREAD * s)]
    rows = o.select("*", F.inline(F.array(*[F.struct(F.lit(q).alias("sign"), F.lit(c).alias("call"), k.alias("strike")) for q, c, k in legs])))
    k, e = F.col("strike"), F.col("e")
    # a put is a call less the forward, so one price serves both
    call = S.bs_price(s, k, v, _YEARS, _RATE, True)
    rows = rows.withColumn("price", call).withColumn("price", F.when(F.col("call"), F.col("price")).otherwise(F.col("price") - s + k * float(np.exp(-_RATE * _YEARS))))
    pays = F.greatest(F.when(F.col("call"), e - k).otherwise(k - e), F.lit(0.0))
    g = rows.groupBy("ticker", F.col("date").alias("opened"), "expiry").agg(F.sum(F.col("sign") * F.col("price")).alias("c"), F.sum(-F.col("sign") * pays).alias("p"), F.max("s").alias("s"))
    return g.select("ticker", "opened", "expiry", r6(F.col("c") / s, "credit"), r6(F.col("p") / s, "payoff"), r6((F.col("c") + F.col("p")) / s, "pnl"))


# --- archives ---


@_add(
    "archive_ingest",
    "SELECT symbol, date_trunc('hour', make_timestamp(exchange_ts_ns // 1000)) AS hour, count(*) AS n, sum(CASE WHEN is_buyer_maker THEN 1 ELSE 0 END)::BIGINT AS n_sells, min(price) AS low, max(price) AS high, TRUE AS digest_ok FROM (SELECT DISTINCT agg_trade_id, symbol, exchange_ts_ns, price, is_buyer_maker FROM trade_events WHERE exchange_ts_ns IS NOT NULL AND price > 0 AND isfinite(price) AND is_buyer_maker IS NOT NULL) GROUP BY 1, 2",
)
def archive_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Trades packed into ZIP archives by symbol and hour, some with a header, flags in several spellings; read back, checked and put into hours.

    Archives are packed and unpacked in streams of lines; their digests are held against the manifest.
    """
    t = table(spark, sf, "trade_events").where("exchange_ts_ns is not null and price > 0 and not isnan(price) and price < double('inf') and is_buyer_maker is not null")
    t = t.select("agg_trade_id", "symbol", "exchange_ts_ns", "price", "is_buyer_maker").distinct()
    hour = F.expr("exchange_ts_ns div 3600000000000")
    odd = F.col("agg_trade_id") % 3
    flag = F.when(odd == 0, F.when(F.col("is_buyer_maker"), "True").otherwise("False")).when(odd == 1, F.when(F.col("is_buyer_maker"), "true").otherwise("false")).otherwise(F.when(F.col("is_buyer_maker"), "1").otherwise("0"))
    line = F.concat_ws(",", "agg_trade_id", F.col("price").cast("string"), "exchange_ts_ns", flag)
    lines = t.select(F.concat_ws("-", "symbol", hour).alias("path"), line.alias("line"), (hour % 2 == 0).alias("header"))
    packed = store.pack_archives(lines, "agg_trade_id,price,exchange_ts_ns,is_buyer_maker")
    from tidemark.session import materialise

    archives = materialise(packed, "archives")
    manifest = archives.select("path", F.sha2("content", 256).alias("sha256"))
    rows = store.read_archives(archives.select("path", "content"))
    good = store.parse_trades(rows).join(manifest.withColumnRenamed("sha256", "expected"), "path")
    at = F.date_trunc("hour", F.timestamp_micros(F.expr("exchange_ts_ns div 1000")))
    return good.groupBy(F.regexp_extract("path", "^(.*)-[0-9]+$", 1).alias("symbol"), at.alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_buyer_maker").alias("n_sells"), F.min("price").alias("low"), F.max("price").alias("high"), F.bool_and(F.col("sha256") == F.col("expected")).alias("digest_ok")
    )


# --- snapshots and files held against each other ---


@_add(
    "snapshot_changes",
    "WITH m AS (SELECT make_timestamp((epoch_us(min(recorded_at)) + epoch_us(max(recorded_at))) // 2) AS middle FROM snapshots), s AS (SELECT * FROM snapshots WHERE account_id IS NOT NULL AND date IS NOT NULL AND recorded_at IS NOT NULL AND nav IS NOT NULL), a AS (SELECT account_id || '|' || date AS key, max(nav) AS nav FROM s, m WHERE recorded_at <= middle GROUP BY 1), b AS (SELECT account_id || '|' || date AS key, max(nav) AS nav FROM s, m WHERE cash IS NOT NULL OR recorded_at > middle GROUP BY 1) "
    "SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM a FULL JOIN b ON a.key = b.key WHERE a.nav IS DISTINCT FROM b.nav",
)
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Records added, removed or changed between two full snapshots too large for one task: digests of content-defined chunks first, rows of unequal chunks then."""
    s = table(spark, sf, "snapshots").where("account_id is not null and date is not null and recorded_at is not null and nav is not null")
    s = s.select("account_id", "date", "nav", "cash", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("us"))
    first, last = s.agg(F.min("us"), F.max("us")).first()
    whole = table(spark, sf, "snapshots").agg(F.min(F.unix_micros(F.col("recorded_at").cast("timestamp"))), F.max(F.unix_micros(F.col("recorded_at").cast("timestamp")))).first()
    middle = 0 if first is None else (whole[0] + whole[1]) // 2
    old = s.where(F.col("us") <= middle).groupBy("account_id", "date").agg(F.max("nav").alias("nav"))
    new = s.where((F.col("cash").isNotNull()) | (F.col("us") > middle)).groupBy("account_id", "date").agg(F.max("nav").alias("nav"))
    return snapshot_diff.snapshot_diff(old, new, ["account_id", "date"], ["nav"])


@_add(
    "drifting_files",
    "SELECT f.file, count(*) AS n, sum(o_custkey)::BIGINT AS customers, round(sum(o_totalprice), 2) AS total, count(CASE WHEN f.file = 'third' THEN NULL ELSE o_orderpriority END) AS n_priorities FROM orders, (VALUES ('first', 0), ('second', 1), ('third', 2)) f(file, k) WHERE o_orderkey % 3 = f.k GROUP BY 1",
)
def drifting_files(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries of a table whose fields are renamed, retyped and dropped, read into one table by projections compiled from edit scripts."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    files = {
        "first": o.where("o_orderkey % 3 = 0"),
        "second": o.where("o_orderkey % 3 = 1").withColumnRenamed("o_totalprice", "total_price").withColumn("o_custkey", F.col("o_custkey").cast("string")),
        "third": o.where("o_orderkey % 3 = 2").drop("o_orderpriority").withColumnRenamed("o_totalprice", "total_price"),
    }
    alike = {("o_totalprice", "total_price"): 1.0}
    _, projections = schema_drift.drift_report(spark, files, lambda a, b: alike.get((a[-1], b[-1]), 0.0))
    out = None
    for name, df in files.items():
        one = df.select(F.lit(name).alias("file"), *projections[name])
        out = one if out is None else out.unionByName(one)
    return out.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("o_orderpriority").alias("n_priorities"))
