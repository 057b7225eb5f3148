"""Queries on streams, replayed over the tables, and on generated series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import prng
from tidemark.session import table
from tidemark.streaming import order_book, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _sums() -> list:
    return [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]


def _flat(df: DataFrame, *by: str) -> DataFrame:
    return df.select(F.col("w.start").alias("start"), *by, "n", F.round("total", 4).alias("total"))


@_add("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows by type."""
    e = windows.file_stream(spark, sf, "events")
    return _flat(windows.run_available(windows.tumbling(e, "ts", "1 hour", ["event_type"], _sums()), "complete", "tumbling"), "event_type")


@_add("stream_sliding", "WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 90 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts), INTERVAL 30 MINUTE)) AS start, value FROM events) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Two-hour windows that slide by half an hour."""
    e = windows.file_stream(spark, sf, "events")
    return _flat(windows.run_available(windows.sliding(e, "ts", "2 hours", "30 minutes", [], _sums()), "complete", "sliding"))


@_add("stream_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user, ended by a pause of four hours."""
    e = windows.file_stream(spark, sf, "events")
    late = windows.whole_span(table(spark, sf, "events"), F.col("ts").cast("timestamp"))
    return _flat(windows.run_available(windows.sessions(e, "ts", "4 hours", ["user_id"], _sums(), late), "complete", "sessions"), "user_id")


@_add("stream_deduplicate", "SELECT symbol, count(DISTINCT agg_trade_id) AS n FROM trade_events WHERE exchange_ts_ns IS NOT NULL GROUP BY 1")
def stream_deduplicate(spark: SparkSession, sf: str) -> DataFrame:
    """Trades delivered again are dropped within the watermark, which spans the table."""
    ts = F.timestamp_micros(F.expr("exchange_ts_ns div 1000"))
    t = windows.file_stream(spark, sf, "trade_events").where("exchange_ts_ns is not null").withColumn("ts", ts)
    once = windows.deduplicate(t.select("agg_trade_id", "symbol", "ts"), "ts", ["agg_trade_id"], windows.whole_span(table(spark, sf, "trade_events"), ts))
    return windows.run_available(once.select("symbol"), "append", "dedup").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@_add("stream_hourly_sink", "SELECT event_type, ts::DATE AS day, hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3")
def stream_hourly_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to Parquet by day and hour, exactly once."""
    e = windows.file_stream(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    return windows.partitioned_sink(e, ["day", "hour"], "hourly").groupBy("event_type", "day", "hour").agg(F.count(F.lit(1)).alias("n"))


_ARRIVALS = 4


@_add(
    "stream_late_rows",
    f"""WITH sp AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events), e AS (SELECT ts, value, (epoch_us(ts) - a) * {_ARRIVALS} // (z - a + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS b FROM events, sp),
m AS (SELECT b, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM (SELECT b, max(ts) AS top FROM e GROUP BY 1)),
k AS (SELECT date_trunc('hour', ts) AS start, value FROM e JOIN m USING (b) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM k WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e) GROUP BY 1""",
)
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows in append mode over several arrivals, a tenth of the events one arrival late.

    A window comes out once, when the watermark (an hour behind the latest event) has passed it; late rows
    of windows that are out are dropped, those of open ones count, across restarts.
    """
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    us = F.unix_micros("ts")
    first, last = e.agg(F.min(us), F.max(us)).first()
    if first is None:
        return e.select(F.col("ts").alias("start"), F.lit(0).cast("bigint").alias("n"), F.col("value").alias("total"))
    quarter = F.expr(f"(unix_micros(ts) - {first}L) * {_ARRIVALS} div {last - first + 1}L")
    arriving = e.withColumn("arrival", quarter + (F.col("event_id") % 10 == 0).cast("int")).drop("event_id")
    out = windows.run_arrivals(arriving, "arrival", list(range(_ARRIVALS + 1)), lambda s: windows.tumbling(s, "ts", "1 hour", [], _sums(), "1 hour"), "late")
    return _flat(out)


#: A snapshot begins every range of so many update ids of a symbol; the sixth difference of a range is lost on the way.
_RANGE, _LOST = 96, 6


def book_events(spark: SparkSession, sf: str) -> DataFrame:
    """Book states as a snapshot per symbol and range of ids and differences after it, one of them lost."""
    k = table(spark, sf, "book_snapshots").where("symbol is not null and last_update_id is not null and bid_px_1 is not null and bid_sz_1 > 0 and ask_px_1 is not null and ask_sz_1 > 0")
    k = k.groupBy("symbol", "last_update_id").agg(*[F.max(c).alias(c) for c in ("exchange_ts_ns", "bid_px_1", "bid_sz_1", "ask_px_1", "ask_sz_1")])
    k = k.withColumn("segment", F.expr(f"last_update_id div {_RANGE}"))
    w = Window.partitionBy("symbol", "segment").orderBy("last_update_id")
    k = k.withColumns({"prev": F.lag("last_update_id").over(w), "b0": F.lag("bid_px_1").over(w), "a0": F.lag("ask_px_1").over(w), "rn": F.row_number().over(w)})

    def levels(old: str, px: str, sz: str):
        new = F.struct(F.col(px).alias("px"), F.col(sz).alias("sz"))
        return F.when(F.col(old).isNull(), F.array(new)).otherwise(F.array(F.struct(F.col(old).alias("px"), F.lit(0.0).alias("sz")), new))

    return k.where(F.col("rn") != _LOST).select(
        "symbol", "segment", F.when(F.col("prev").isNull(), "snapshot").otherwise("diff").alias("kind"), F.coalesce(F.col("prev") + 1, "last_update_id").alias("first_id"), F.col("last_update_id").alias("last_id"),
        F.col("prev").alias("prev_id"), F.coalesce("exchange_ts_ns", F.lit(0)).alias("ts"), levels("b0", "bid_px_1", "bid_sz_1").alias("bids"), levels("a0", "ask_px_1", "ask_sz_1").alias("asks"),
    )


@_add(
    "stream_order_book",
    f"WITH k AS (SELECT symbol, last_update_id AS last_id, max(bid_px_1) AS bid_px, max(bid_sz_1) AS bid_sz, max(ask_px_1) AS ask_px, max(ask_sz_1) AS ask_sz FROM book_snapshots WHERE last_update_id IS NOT NULL AND bid_px_1 IS NOT NULL AND bid_sz_1 > 0 AND ask_px_1 IS NOT NULL AND ask_sz_1 > 0 AND symbol IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, last_id // {_RANGE} ORDER BY last_id) AS rn FROM k) "
    f"SELECT symbol, last_id, CASE WHEN rn = 1 THEN 'snapshot' WHEN rn = {_LOST + 1} THEN 'gap' ELSE 'ok' END AS status, "
    + ", ".join(f"CASE WHEN rn <= {_LOST} THEN {c} END AS {c}" for c in ("bid_px", "bid_sz", "ask_px", "ask_sz"))
    + f", CASE WHEN rn <= {_LOST} THEN 2 ELSE 0 END AS n_levels FROM r WHERE rn < {_LOST} OR rn = {_LOST + 1}",
)
def stream_order_book(spark: SparkSession, sf: str) -> DataFrame:
    """Books rebuilt from differences of which some are lost: the top after each event, a gap row where the chain breaks, nothing until the next snapshot.

    The differences arrive in two deliveries, so books are carried over a restart.
    """
    events = book_events(spark, sf).withColumn("arrival", (F.col("last_id") % _RANGE >= _RANGE // 8).cast("int"))
    out = windows.run_arrivals(events, "arrival", [0, 1], lambda s: order_book.books(s, "segment"), "books")
    return out.select("symbol", "last_id", "status", "bid_px", "bid_sz", "ask_px", "ask_sz", "n_levels")


_NAMES = ["ALFA", "BRAVO", "CHARLIE", "DELTA"]


def _m32(a: str, b: str) -> str:
    return f"(({a})::HUGEINT * ({b})::HUGEINT % 4294967296)::BIGINT"


_MACROS = (
    "WITH n AS (SELECT t AS ticker, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM (SELECT unnest(['ALFA', 'BRAVO', 'CHARLIE', 'DELTA']) AS t)), "
    "m AS (SELECT ticker, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) + 42 AS s FROM n), "
    "k AS (SELECT ticker, s, k FROM m, (SELECT unnest(generate_series(1, 404)) AS k)), "
    f"a AS (SELECT ticker, k, (s + {_m32('k', str(prng.STEP))}) % 4294967296 AS x FROM k), "
    f"b AS (SELECT ticker, k, {_m32('xor(x, x >> 15)', 'x | 1')} AS t FROM a), "
    f"c AS (SELECT ticker, k, xor((t + {_m32('xor(t, t >> 7)', 't | 61')}) % 4294967296, t) AS t FROM b), "
    "d AS (SELECT ticker, k, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM c), "
    "p AS (SELECT ticker, max(CASE WHEN k = 1 THEN u END) AS p1, max(CASE WHEN k = 2 THEN u END) AS p2, max(CASE WHEN k = 3 THEN u END) AS p3, max(CASE WHEN k = 404 THEN u END) AS last FROM d GROUP BY 1), "
    "q AS (SELECT ticker, ((k - 4) // 4 + 1) AS day, max(CASE WHEN (k - 4) % 4 = 0 THEN u END) AS u1, max(CASE WHEN (k - 4) % 4 = 1 THEN u END) AS u2, max(CASE WHEN (k - 4) % 4 = 2 THEN u END) AS u3, max(CASE WHEN (k - 4) % 4 = 3 THEN u END) AS u4 FROM d WHERE k BETWEEN 4 AND 403 GROUP BY 1, 2), "
    "f AS (SELECT ticker, 0 AS day, 50 + p1 * 450 AS f, greatest(floor((1 + last * 5) * 1000000), 100000)::BIGINT AS volume FROM p UNION ALL SELECT ticker, day, 1 + greatest(least((p2 - 0.4) * 0.3 / 252 + (0.01 + p3 * 0.03) * CASE WHEN u3 < 0.05 THEN 2.0 ELSE 1.0 END * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)), 0.15), -0.15), greatest(floor((1 + u4 * 5) * 1000000), 100000)::BIGINT FROM q JOIN p USING (ticker)) "
)


@_add("synthetic_prices", _MACROS + "SELECT ticker, day::INTEGER AS day, round(product(f) OVER (PARTITION BY ticker ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS price, volume FROM f")
def synthetic_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Four seeded walks of a hundred days, every draw computed from its number."""
    return prng.synthetic_prices(spark, _NAMES, 100).select("ticker", "day", F.round("price", 6).alias("price"), "volume")
