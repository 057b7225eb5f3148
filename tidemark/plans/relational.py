"""Queries of sources, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import prng
from tidemark.functions import scalars as S
from tidemark.operators import joins as J
from tidemark.operators import panel as P
from tidemark.operators.options import with_option_values, with_strike_for_delta
from tidemark.plans.base import B, bars, over, r6, r6_sql
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


# --- sources ---


@_add("scan_date_range", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R'")
def scan_date_range(spark: SparkSession, sf: str) -> DataFrame:
    """Range scan: both filters and the three columns reach the Parquet reader."""
    day = F.col("l_shipdate")
    rows = table(spark, sf, "lineitem").where((day >= F.lit("1997-01-01").cast("timestamp")) & (day < F.lit("1998-01-01").cast("timestamp")) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


@_add("load_aligned_inner", B + ", full_days AS (SELECT date FROM bars GROUP BY 1 HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)) SELECT ticker, date, close FROM bars WHERE date IN (SELECT date FROM full_days)")
def load_aligned_inner(spark: SparkSession, sf: str) -> DataFrame:
    """Histories on the dates that every ticker has."""
    b = bars(spark, sf).select("ticker", "date", "close")
    names = b.agg(F.countDistinct("ticker").alias("k"))
    full = b.groupBy("date").agg(F.countDistinct("ticker").alias("n")).join(names, F.col("n") == F.col("k"), "left_semi")
    return b.join(full, "date", "left_semi").select("ticker", "date", "close")


@_add("load_latest", B + "SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1")
def load_latest(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


@_add("normalise_keep_last", "SELECT order_id, ticker, upper(side) AS side, upper(status) AS status, coalesce(fill_quantity, 0) AS fill_quantity FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY submitted_at DESC, filled_at DESC NULLS LAST) AS k FROM exec_orders WHERE order_id IS NOT NULL) WHERE k = 1")
def normalise_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Orders normalised: one spelling of side and status, one row per id (the last), missing quantities 0."""
    o = table(spark, sf, "exec_orders").where("order_id is not null")
    one = J.keep_last(o, ["order_id"], ["submitted_at", "filled_at"])
    return one.select("order_id", "ticker", F.upper("side").alias("side"), F.upper("status").alias("status"), F.coalesce("fill_quantity", F.lit(0.0)).alias("fill_quantity"))


@_add("merge_upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 1.1, 4) ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A store merged with corrected rows (same keys replaced), then back-filled with rows it lacks."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store = o.where("o_orderstatus <> 'P'")
    fixed = store.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 1.1, 4))
    back = o.where("o_orderkey % 2 = 0")
    return J.append_missing(J.upsert(store, fixed, ["o_orderkey"]), back, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@_add("partitioned_store", B + "SELECT ticker, date, close, volume FROM bars WHERE year(date) = 1998 AND ticker IN ('Brand#11', 'Brand#22')")
def partitioned_store(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written by ticker and year, read back with partition pruning."""
    from tidemark.sources.store import BarStore

    store = BarStore.temporary(spark, "bars")
    store.write(bars(spark, sf).select("ticker", "date", "open", "high", "low", "close", "volume"))
    return store.load(["Brand#11", "Brand#22"], "1998-01-01", "1998-12-31").select("ticker", "date", "close", "volume")


@_add("jsonl_journal", "SELECT order_id AS entry_id, ticker, max(submitted_at) AS at FROM exec_orders WHERE order_id IS NOT NULL AND status = 'FILLED' GROUP BY 1, 2")
def jsonl_journal(spark: SparkSession, sf: str) -> DataFrame:
    """An append-only JSON-lines journal, written twice and settled once: the latest entry per key."""
    from tidemark.sources.store import Journal

    o = table(spark, sf, "exec_orders").where("order_id is not null and status = 'FILLED'").select(F.col("order_id").alias("entry_id"), "ticker", F.col("submitted_at").alias("at"))
    journal = Journal.temporary(spark, "orders", "entry_id string, ticker string, at string", ["entry_id", "ticker"], "at")
    journal.append(o)
    journal.append(o)  # nothing new
    return journal.latest()


@_add("props_json", "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def props_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@_add("weights_json", "SELECT w.key AS ticker, count(*) AS n, round(sum(CAST(w.value AS DOUBLE)), 6) + 0.0 AS total_weight FROM (SELECT DISTINCT account_id, date, recorded_at, weights FROM snapshots WHERE weights IS NOT NULL) s, json_each(s.weights) w GROUP BY 1")
def weights_json(spark: SparkSession, sf: str) -> DataFrame:
    """Weights stored as JSON text, as rows."""
    s = table(spark, sf, "snapshots").where("weights is not null").select("account_id", "date", "recorded_at", "weights").distinct()
    w = s.select(F.explode(F.from_json("weights", "map<string,double>")).alias("ticker", "weight"))
    return w.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight"), "total_weight"))


@_add("hourly_ticks", "SELECT symbol, date_trunc('hour', make_timestamp(exchange_ts_ns // 1000)) AS hour, count(*) AS n, min(agg_trade_id) AS first_id, max(agg_trade_id) AS last_id FROM (SELECT DISTINCT agg_trade_id, symbol, exchange_ts_ns FROM trade_events WHERE exchange_ts_ns IS NOT NULL) GROUP BY 1, 2")
def hourly_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks by symbol and UTC hour, as the archive's partitions hold them; deliveries counted once."""
    t = table(spark, sf, "trade_events").where("exchange_ts_ns is not null").select("agg_trade_id", "symbol", "exchange_ts_ns").distinct()
    hour = F.date_trunc("hour", F.timestamp_micros(F.expr("exchange_ts_ns div 1000")))
    return t.groupBy("symbol", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min("agg_trade_id").alias("first_id"), F.max("agg_trade_id").alias("last_id"))


# --- joins ---

_DEDUP = "t AS (SELECT DISTINCT agg_trade_id, symbol, exchange_ts_ns AS ts, price, size, is_buyer_maker FROM trade_events WHERE exchange_ts_ns IS NOT NULL), k AS (SELECT symbol, exchange_ts_ns AS ts, max(last_update_id) AS last_update_id FROM book_snapshots WHERE exchange_ts_ns IS NOT NULL GROUP BY 1, 2)"


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "trade_events").where("exchange_ts_ns is not null")
    return t.select("agg_trade_id", "symbol", F.col("exchange_ts_ns").alias("ts"), "price", "size", "is_buyer_maker").distinct()


@_add("asof_trade_book", f"WITH {_DEDUP} SELECT t.agg_trade_id, k.last_update_id FROM t ASOF LEFT JOIN k ON t.symbol = k.symbol AND t.ts >= k.ts")
def asof_trade_book(spark: SparkSession, sf: str) -> DataFrame:
    """Each trade with the last book state at or before it, blocked in time so that no symbol is one task."""
    book = table(spark, sf, "book_snapshots").where("exchange_ts_ns is not null").select("symbol", F.col("exchange_ts_ns").alias("book_ts"), "last_update_id")
    out = J.asof_backward(_trades(spark, sf).select("agg_trade_id", "symbol", "ts"), book, ["symbol"], "ts", "book_ts", ["last_update_id"], block=600_000_000_000)
    return out.select("agg_trade_id", "last_update_id")


@_add(
    "temporal_alignment",
    f"WITH {_DEDUP}, j AS (SELECT t.symbol, t.ts - k.ts AS lag FROM t ASOF LEFT JOIN k ON t.symbol = k.symbol AND t.ts >= k.ts) SELECT symbol, count(*) AS n, sum(CASE WHEN lag IS NULL THEN 1 ELSE 0 END)::BIGINT AS unmatched, sum(CASE WHEN lag > 5000000000 THEN 1 ELSE 0 END)::BIGINT AS stale FROM j GROUP BY 1",
)
def temporal_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Per symbol: trades without a book state before them, and with one older than five seconds."""
    book = table(spark, sf, "book_snapshots").where("exchange_ts_ns is not null").select("symbol", F.col("exchange_ts_ns").alias("book_ts"))
    out = J.asof_backward(_trades(spark, sf).select("symbol", "ts"), book, ["symbol"], "ts", "book_ts", ["book_ts"], block=600_000_000_000)
    lag = F.col("ts") - F.col("book_ts")
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(lag.isNull()).alias("unmatched"), F.count_if(lag > 5_000_000_000).alias("stale"))


@_add("value_as_of", "WITH f AS (SELECT o_custkey, o_orderdate AS filed, max(o_totalprice) AS val FROM orders GROUP BY 1, 2), p AS (SELECT o_orderkey, o_custkey, o_orderdate - INTERVAL 30 DAY AS as_of FROM orders) SELECT p.o_orderkey, f.val AS known_value FROM p ASOF LEFT JOIN f ON p.o_custkey = f.o_custkey AND p.as_of >= f.filed")
def value_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Bitemporal read: what was last filed for the customer 30 days before each order."""
    o = table(spark, sf, "orders")
    facts = o.select("o_custkey", F.col("o_orderdate").alias("filed"), F.col("o_totalprice").alias("val"))
    probes = o.select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("as_of"))
    return J.value_as_of(facts, probes, ["o_custkey"], "filed", "as_of", "val").select("o_orderkey", F.col("val").alias("known_value"))


@_add("next_bar_open", B + f"SELECT ticker, date, lead(open) {over()} AS next_open, lead(date) {over()} AS next_date FROM bars")
def next_bar_open(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("ticker", "date", P.lag("open", -1).alias("next_open"), P.lag("date", -1).alias("next_date"))


_SPANS = """WITH ev AS (SELECT o_custkey, o_orderdate::DATE AS day, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS act FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2),
tu AS (SELECT * FROM (SELECT *, lag(act) OVER (PARTITION BY o_custkey ORDER BY day) AS prev FROM ev) WHERE prev IS NULL OR prev <> act),
sp AS (SELECT o_custkey, day AS valid_from, act, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS valid_to FROM tu),
iv AS (SELECT o_custkey, valid_from, valid_to FROM sp WHERE act = 1)
"""


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "orders").where("o_orderstatus in ('O', 'F')").select("o_custkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "O", "ADD").otherwise("REMOVE").alias("action"))
    return J.membership_intervals(events, "o_custkey", "day", "action")


@_add("membership_intervals", _SPANS + "SELECT o_custkey, valid_from, valid_to FROM iv")
def membership_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals replayed from an add/remove event log."""
    return _intervals(spark, sf)


@_add("member_on_date", _SPANS + ", q AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'P') SELECT q.o_orderkey, iv.valid_from IS NOT NULL AND (iv.valid_to IS NULL OR q.day < iv.valid_to) AS is_member FROM q ASOF LEFT JOIN iv ON q.o_custkey = iv.o_custkey AND q.day >= iv.valid_from")
def member_on_date(spark: SparkSession, sf: str) -> DataFrame:
    """Interval join: was the customer a member on the order's day."""
    q = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return J.member_on(q, _intervals(spark, sf), "o_custkey", "day").select("o_orderkey", "is_member")


_NEAR = "FROM orders a WHERE o_orderstatus = 'F' AND {}EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'O' AND b.o_custkey = a.o_custkey AND abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 7)"


def _tolerance(spark: SparkSession, sf: str, anti: bool) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    return J.within_tolerance(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"], "day", "day", 7, anti).select("o_orderkey")


@_add("tolerance_semi", "SELECT o_orderkey " + _NEAR.format(""))
def tolerance_semi(spark: SparkSession, sf: str) -> DataFrame:
    return _tolerance(spark, sf, False)


@_add("tolerance_anti", "SELECT o_orderkey " + _NEAR.format("NOT "))
def tolerance_anti(spark: SparkSession, sf: str) -> DataFrame:
    return _tolerance(spark, sf, True)


_QUARTERS = "WITH q AS (SELECT o_custkey, last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH) AS period_end, round(sum(o_totalprice), 2) AS eps FROM orders GROUP BY 1, 2)"


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    end = F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 2))
    return table(spark, sf, "orders").groupBy("o_custkey", end.alias("period_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("eps"))


@_add("seasonal_predecessor", _QUARTERS + " SELECT a.o_custkey, a.period_end, a.eps, CASE WHEN count(b.eps) = 1 THEN min(b.eps) END AS previous FROM q a LEFT JOIN q b ON a.o_custkey = b.o_custkey AND date_diff('day', b.period_end, a.period_end) BETWEEN 350 AND 380 GROUP BY 1, 2, 3")
def seasonal_predecessor(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly values with that of the same quarter a year before."""
    return J.seasonal_predecessor(_quarters(spark, sf), "o_custkey", "period_end", "eps")


@_add(
    "standardised_surprise",
    _QUARTERS
    + f""", d AS (SELECT a.o_custkey, a.period_end, a.eps - b.eps AS diff FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND date_diff('day', b.period_end, a.period_end) BETWEEN 350 AND 380),
w AS (SELECT *, count(diff) OVER r AS n, stddev_samp(diff) OVER r AS sd FROM d WINDOW r AS (PARTITION BY o_custkey ORDER BY period_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT o_custkey, period_end, {r6_sql('diff / nullif(sd, 0)', 'sue')} FROM w WHERE n >= 4""",
)
def standardised_surprise(spark: SparkSession, sf: str) -> DataFrame:
    """Seasonal difference over the deviation of the eight before it (at least four)."""
    d = J.seasonal_predecessor(_quarters(spark, sf), "o_custkey", "period_end", "eps").where("previous is not null").withColumn("diff", F.col("eps") - F.col("previous"))
    w = Window.partitionBy("o_custkey").orderBy("period_end").rowsBetween(-8, -1)
    out = d.withColumns({"n": F.count("diff").over(w), "sd": F.stddev_samp("diff").over(w)}).where("n >= 4")
    return out.select("o_custkey", "period_end", r6(F.col("diff") / F.nullif("sd", F.lit(0.0)), "sue"))


@_add("restatement_chains", "SELECT o_custkey, last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH) AS period_end, count(*) AS n_filings, arg_min(o_totalprice, o_orderkey) AS first_value, arg_max(o_totalprice, o_orderkey) AS last_value FROM orders GROUP BY 1, 2 HAVING count(*) >= 2")
def restatement_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Periods filed more than once: first and last value."""
    end = F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 2))
    o = table(spark, sf, "orders").groupBy("o_custkey", end.alias("period_end"))
    return o.agg(F.count(F.lit(1)).alias("n_filings"), F.min_by("o_totalprice", "o_orderkey").alias("first_value"), F.max_by("o_totalprice", "o_orderkey").alias("last_value")).where("n_filings >= 2")


@_add("fallback_concept", "SELECT o_custkey, min(o_totalprice) AS val, 'primary' AS concept FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, min(o_totalprice), 'fallback' FROM orders a WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'O' AND b.o_custkey = a.o_custkey) GROUP BY 1")
def fallback_concept(spark: SparkSession, sf: str) -> DataFrame:
    """A second concept is read only where the first is absent."""
    o = table(spark, sf, "orders")

    def concept(status: str, name: str) -> DataFrame:
        return o.where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.min("o_totalprice").alias("val")).withColumn("concept", F.lit(name))

    return J.fallback(concept("O", "primary"), concept("F", "fallback"), ["o_custkey"])


_FIRSTLAST = "a AS (SELECT account_id, date, arg_min(nav, recorded_at) AS nav, arg_min(n_positions, recorded_at) AS n_positions FROM snapshots WHERE nav IS NOT NULL AND n_positions IS NOT NULL GROUP BY 1, 2), b AS (SELECT account_id, date, max(nav) AS nav, max(n_positions) AS n_positions FROM snapshots WHERE cash IS NOT NULL GROUP BY 1, 2)"


@_add("compare_live_archive", f"WITH {_FIRSTLAST} SELECT sum(CASE WHEN b.account_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_a, sum(CASE WHEN a.account_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_b, sum(CASE WHEN a.account_id IS NOT NULL AND b.account_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS in_both, sum(CASE WHEN a.account_id IS NOT NULL AND b.account_id IS NOT NULL AND a.nav IS DISTINCT FROM b.nav THEN 1 ELSE 0 END)::BIGINT AS differ_nav, sum(CASE WHEN a.account_id IS NOT NULL AND b.account_id IS NOT NULL AND a.n_positions IS DISTINCT FROM b.n_positions THEN 1 ELSE 0 END)::BIGINT AS differ_n_positions FROM a FULL JOIN b ON a.account_id = b.account_id AND a.date = b.date")
def compare_live_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a table held against each other: rows on one side only, mismatches per column."""
    s = table(spark, sf, "snapshots")
    a = s.where("nav is not null and n_positions is not null").groupBy("account_id", "date").agg(F.min_by("nav", "recorded_at").alias("nav"), F.min_by("n_positions", "recorded_at").alias("n_positions"))
    b = s.where("cash is not null").groupBy("account_id", "date").agg(F.max("nav").alias("nav"), F.max("n_positions").alias("n_positions"))
    return J.compare_tables(a, b, ["account_id", "date"], ["nav", "n_positions"])


@_add("one_to_one_join", "SELECT o_orderkey, o_totalprice, n_lines, quantity FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def one_to_one_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the totals of their lines; the join raises if a key repeats on either side."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return J.one_to_one(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "n_lines", "quantity")


@_add(
    "basket_turnover",
    B
    + f""", x AS (SELECT date, ticker, {'CASE WHEN lag(close, 4) ' + over() + ' > 0 THEN close / lag(close, 4) ' + over() + ' - 1 END'} AS m4 FROM bars),
k AS (SELECT date, ticker, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY m4, ticker) AS u FROM x WHERE m4 IS NOT NULL),
w AS (SELECT date, ticker, CASE WHEN u > n - 5 THEN 0.2 ELSE -0.2 END AS w FROM k WHERE u > n - 5 OR u <= 5),
d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM w)),
p AS (SELECT ticker, d.nx AS date, w.w AS w0 FROM w JOIN d USING (date) WHERE d.nx IS NOT NULL)
SELECT date, round(sum(abs(coalesce(w.w, 0) - coalesce(p.w0, 0))), 6) + 0.0 AS turnover FROM w FULL JOIN p USING (date, ticker) GROUP BY 1""",
)
def basket_turnover(spark: SparkSession, sf: str) -> DataFrame:
    """Turnover of long-short baskets of five from week to week."""
    x = bars(spark, sf).select("date", "ticker", P.simple_return("close", 4).alias("m4")).where("m4 is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    u = F.row_number().over(Window.partitionBy("date").orderBy("m4", "ticker"))
    w = x.withColumns({"n": n, "u": u}).where("u > n - 5 or u <= 5").select("date", "ticker", F.when(F.col("u") > F.col("n") - 5, 0.2).otherwise(-0.2).alias("w"))
    return J.turnover(w, "ticker", "date", "w").select("date", r6("turnover"))


@_add(
    "event_window",
    B
    + f""", p AS (SELECT ticker, date, close, row_number() {over()} AS k FROM bars), a AS (SELECT ticker, k FROM p WHERE month(date) = 6 AND day(date) <= 7)
SELECT p.k - a.k AS day_offset, count(*) AS n, {r6_sql('avg(p.close / b.close - 1)', 'mean_return')} FROM a JOIN p ON p.ticker = a.ticker AND p.k BETWEEN a.k - 3 AND a.k + 3 JOIN p b ON b.ticker = a.ticker AND b.k = a.k GROUP BY 1""",
)
def event_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rows three before to three after each anchor, by trading position."""
    p = bars(spark, sf).select("ticker", "date", "close", F.row_number().over(P.ts()).alias("k"))
    anchors = p.where((F.month("date") == 6) & (F.dayofmonth("date") <= 7)).select("ticker", F.col("k").alias("k0"), F.col("close").alias("c0"))
    wanted = anchors.withColumn("day_offset", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("k", F.col("k0") + F.col("day_offset"))
    return wanted.join(p, ["ticker", "k"]).groupBy("day_offset").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("close") / F.col("c0") - 1), "mean_return"))


# --- sets, sorts ---


@_add("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT ticker FROM exec_orders UNION SELECT symbol FROM trade_events) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n, c: table(spark, sf, n).select(F.col(c).alias("x"))
    parts = {
        "union": t("exec_orders", "ticker").union(t("trade_events", "symbol")).distinct(),
        "intersect": t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")),
        "except": t("orders", "o_custkey").subtract(table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("x"))),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_add("top_by_value", "SELECT symbol, sum(price * size)::FLOAT::DOUBLE AS traded FROM (SELECT DISTINCT agg_trade_id, symbol, price, size FROM trade_events WHERE price > 0 AND size > 0 AND isfinite(price) AND isfinite(size)) GROUP BY 1 HAVING count(*) >= 20 ORDER BY traded DESC, symbol LIMIT 10")
def top_by_value(spark: SparkSession, sf: str) -> DataFrame:
    """Ten symbols with the most traded value among those with enough trades (a top-k report)."""
    t = table(spark, sf, "trade_events").where("price > 0 and size > 0 and not isnan(price) and not isnan(size) and price < double('inf') and size < double('inf')").select("agg_trade_id", "symbol", "price", "size").distinct()
    g = t.groupBy("symbol").agg(F.sum(F.col("price") * F.col("size")).cast("float").cast("double").alias("traded"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    return g.orderBy(F.desc("traded"), "symbol").limit(10).select("symbol", "traded")


@_add("latest_orders", "SELECT * FROM (SELECT account_id, order_id, submitted_at, row_number() OVER (PARTITION BY account_id ORDER BY submitted_at DESC, order_id DESC) AS position FROM (SELECT DISTINCT account_id, order_id, submitted_at FROM exec_orders)) WHERE position <= 5")
def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The five latest orders of each account."""
    o = table(spark, sf, "exec_orders").select("account_id", "order_id", "submitted_at").distinct()
    k = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("submitted_at"), F.desc("order_id")))
    return o.withColumn("position", k).where("position <= 5")


# --- scalar functions ---


def _poly_sql(x: str, c: tuple[float, ...]) -> str:
    out = f"CAST({c[0]!r} AS DOUBLE)"
    for k in c[1:]:
        out = f"({out} * {x} + CAST({k!r} AS DOUBLE))"
    return out


def cdf_sql(x: str) -> str:
    z = f"abs({x})"
    bell = f"exp(-{z} * {z} / 2)"
    near = f"{bell} * {_poly_sql(z, S.CDF_TOP)} / {_poly_sql(z, S.CDF_BOTTOM)}"
    far = f"{bell} / (({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) * sqrt(2 * pi()))"
    tail = f"(CASE WHEN {z} > 37 THEN 0 WHEN {z} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def ppf_sql(p: str) -> str:
    q = f"sqrt(-2 * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    side = f"({_poly_sql(q, S.QUANTILE_C)} / ({_poly_sql(q, S.QUANTILE_D)} * {q} + 1))"
    c = f"({p} - 0.5)"
    r = f"({c} * {c})"
    middle = f"({_poly_sql(r, S.QUANTILE_A)} * {c} / ({_poly_sql(r, S.QUANTILE_B)} * {r} + 1))"
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN {p} < {S.QUANTILE_LOW} THEN {side} WHEN {p} > {1 - S.QUANTILE_LOW} THEN -{side} ELSE {middle} END END)"


@_add("normal_functions", f"WITH x AS (SELECT p_partkey, (p_partkey % 1601 - 800) / 100.0::DOUBLE AS x, (p_partkey % 999 + 1) / 1000.0::DOUBLE AS p FROM part) SELECT p_partkey, round({cdf_sql('x')}, 9) AS cdf, round({ppf_sql('p')}, 8) + 0.0 AS quantile FROM x")
def normal_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") % 1601 - 800) / 100.0).alias("x"), ((F.col("p_partkey") % 999 + 1) / 1000.0).alias("p"))
    return p.select("p_partkey", F.round(S.normal_cdf(F.col("x")), 9).alias("cdf"), (F.round(S.normal_quantile(F.col("p")), 8) + 0.0).alias("quantile"))


_D1 = "((ln(s / k) + (0.02 + v * v / 2) * t) / (v * sqrt(t)))"
_OPT = "WITH o AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.9 + (p_partkey % 21) / 100.0) AS k, 0.2 + (p_size % 40) / 100.0 AS v, 0.3 + (p_partkey % 20) / 20.0 AS t FROM part), d AS (SELECT *, " + _D1 + " AS a, " + _D1 + " - v * sqrt(t) AS b FROM o)"


@_add(
    "option_prices",
    f"{_OPT}, n AS (SELECT *, {cdf_sql('a')} AS na, {cdf_sql('b')} AS nb, {cdf_sql('(-a)')} AS ma, {cdf_sql('(-b)')} AS mb FROM d) SELECT p_partkey, round(s * na - k * exp(-0.02 * t) * nb, 4) + 0.0 AS call, round(k * exp(-0.02 * t) * mb - s * ma, 4) + 0.0 AS put, round(na, 6) + 0.0 AS call_delta, round(na - 1, 6) + 0.0 AS put_delta, round(k, 4) AS strike_back FROM n",
)
def option_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Black-Scholes prices and deltas, and the strike found back from the call's delta."""
    s, k = F.col("p_retailprice"), F.col("p_retailprice") * (0.9 + (F.col("p_partkey") % 21) / 100.0)
    v, t = 0.2 + (F.col("p_size") % 40) / 100.0, 0.3 + (F.col("p_partkey") % 20) / 20.0
    o = table(spark, sf, "part").select("p_partkey", s.alias("s"), k.alias("k"), v.alias("v"), t.alias("t"))
    o = with_option_values(o, "s", "k", "v", "t", 0.02)
    o = with_strike_for_delta(o, "s", "call_delta", "v", "t", 0.02, True)
    return o.select(
        "p_partkey", (F.round("call", 4) + 0.0).alias("call"), (F.round("put", 4) + 0.0).alias("put"), r6("call_delta"), r6("put_delta"), F.round("strike_back", 4).alias("strike_back")
    )


@_add(
    "condor_payoffs",
    "WITH o AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.7 + (p_partkey % 61) / 100.0) AS e FROM part) SELECT p_partkey, round(greatest(s * 0.85 - e, 0) - greatest(s * 0.9 - e, 0) - greatest(e - s * 1.1, 0) + greatest(e - s * 1.15, 0), 4) + 0.0 AS payoff FROM o",
)
def condor_payoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Iron condor payoffs at expiry over a range of moves."""
    s = F.col("p_retailprice")
    e = s * (0.7 + (F.col("p_partkey") % 61) / 100.0)
    return table(spark, sf, "part").select("p_partkey", (F.round(S.condor_payoff(e, s * 0.85, s * 0.9, s * 1.1, s * 1.15), 4) + 0.0).alias("payoff"))


@_add(
    "cost_models",
    "WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v, l_quantity AS q, l_discount AS d FROM lineitem WHERE l_orderkey % 7 >= 0) SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(least(10 * sqrt(v / (q * 1e5)), 500), 0.5), 6) AS impact, round(v * 30 / 1e4 * q / 365, 6) AS borrow, ceil(100 * 0.07 * q * (0.05 + d * 9) * (1 - (0.05 + d * 9)) - 1e-9) / 100 AS fee, round(pow(1 + d, 1 / 252.0::DOUBLE) - 1, 9) AS daily FROM o",
)
def cost_models(spark: SparkSession, sf: str) -> DataFrame:
    """Impact, borrow, contract fee and daily rate of every order line."""
    o = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return o.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(S.impact_bps(F.col("v"), F.col("q") * 1e5), 6).alias("impact"), F.round(S.borrow_cost(F.col("v"), 30.0, F.col("q")), 6).alias("borrow"),
        S.contract_fee(0.07, F.col("q"), 0.05 + F.col("d") * 9).alias("fee"), F.round(S.daily_rate(F.col("d")), 9).alias("daily"),
    )


@_add(
    "date_functions",
    "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, (last_day(day) - CAST((isodow(last_day(day)) - 4 + 7) % 7 AS INTEGER))::DATE AS expiry, CASE WHEN month(day) >= 7 THEN year(day) ELSE year(day) - 1 END AS formation_year, (SELECT count(*) FROM generate_series(date_trunc('month', day), last_day(day), INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6) AS business_days FROM d",
)
def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Expiry Thursday, formation year and business days of every order day's month."""
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    day = F.col("day")
    days = F.size(S.business_days(F.to_date(F.date_trunc("month", day)), F.last_day(day))).cast("bigint")
    return d.select("day", S.last_thursday(day).alias("expiry"), S.formation_year(day).alias("formation_year"), days.alias("business_days"))


@_add(
    "text_functions",
    r"SELECT p_partkey, regexp_replace(upper(trim(p_brand)), '\.', '-', 'g') AS ticker, regexp_matches(upper(p_brand), '^[A-Z][A-Z0-9.\-]{0,9}$') AS valid, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, substr(sha1(p_partkey || '|' || p_brand || '|' || p_size), 1, 16) AS event_id FROM part",
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select("p_partkey", S.normalise_ticker(F.col("p_brand")).alias("ticker"), S.valid_ticker(F.upper("p_brand")).alias("valid"), S.pad_cik(F.concat(F.lit("00"), k.cast("string"))).alias("cik"), S.event_id(k, F.col("p_brand"), F.col("p_size")).alias("event_id"))


@_add("string_hash", "SELECT p_partkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS hash FROM (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part)")
def string_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", prng.string_hash(F.col("p_name")).alias("hash"))


@_add(
    "category_regime",
    "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' OR p_type LIKE '%COPPER%' THEN 'metal' WHEN lower(p_name) LIKE '%a%' THEN 'a' ELSE 'other' END AS category, CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 25 THEN 'normal' WHEN p_size < 35 THEN 'high' ELSE 'extreme' END AS regime FROM part",
)
def category_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered substring rules with a default, and half-open regime buckets."""
    name, kind, size = F.lower("p_name"), F.col("p_type"), F.col("p_size")
    category = F.when(kind.contains("STEEL") | kind.contains("COPPER"), "metal").when(name.contains("a"), "a").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", category.alias("category"), F.when(size < 15, "low").when(size < 25, "normal").when(size < 35, "high").otherwise("extreme").alias("regime"))


@_add(
    "bucket_rules",
    "WITH r(rule, lo, hi) AS (VALUES ('a', -1e-9, 900.0), ('b', 900.0, 1000.0), ('c', 1000.0, 1e9)) SELECT p_partkey, rule FROM part JOIN r ON p_retailprice > lo AND p_retailprice <= hi",
)
def bucket_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Range join to a rule table of three rows (left-open buckets)."""
    rules = spark.createDataFrame([("a", -1e-9, 900.0), ("b", 900.0, 1000.0), ("c", 1000.0, 1e9)], "rule string, lo double, hi double")
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return p.join(F.broadcast(rules), (F.col("p_retailprice") > F.col("lo")) & (F.col("p_retailprice") <= F.col("hi"))).select("p_partkey", "rule")


@_add("safe_arithmetic", "SELECT event_id, CASE WHEN (event_id % 5) = 0 THEN 0.0 ELSE value / (event_id % 5) END AS ratio, greatest(least(value, 50), -1) AS clamped FROM events")
def safe_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.safe_divide(F.col("value"), F.col("event_id") % 5).alias("ratio"), S.clamp(F.col("value"), -1.0, 50.0).alias("clamped"))


@_add("sample_sizes", f"WITH x AS (SELECT DISTINCT p_size FROM part) SELECT p_size, ceil(pow(({ppf_sql('0.975::DOUBLE')} * sqrt(p * (1 - p)) + {ppf_sql('0.8::DOUBLE')} * sqrt(q * (1 - q))) / 0.05, 2)) AS n FROM (SELECT p_size, 0.1 + p_size / 100.0::DOUBLE AS p, 0.1 + p_size / 100.0::DOUBLE + 0.05 AS q FROM x)")
def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Trials needed to detect an edge of five points from each base rate."""
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", S.mde_sample(0.1 + F.col("p_size") / 100.0, 0.05).cast("double").alias("n"))


