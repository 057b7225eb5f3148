"""Queries of the general training-data operators (pN_ of the core) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import outliers, revisions, rolling_periods
from tidemark.session import table
from tidemark.sources import eod_files


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of data lines."""
    return eod_files.rejects(table(spark, sf_dir, "eod_lines")).select("line_id", "reason").distinct()


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conforming lines, typed."""
    return eod_files.strict_load(table(spark, sf_dir, "eod_lines")).drop("offset_hash", "file_name", "line_no")


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = rolling_periods.parse_day(F.col("date"))
    states = rolling_periods.latest_state(
        table(spark, sf_dir, "snapshots"), {"account_id": F.col("account_id"), "day": day}, "recorded_at", ["daily_return", "nav"]
    )
    orders = table(spark, sf_dir, "exec_orders").select("order_id", "account_id", "date", "slippage_bps").distinct()
    rolled = rolling_periods.rolling_periods(states, "account_id", F.col("day"), ["daily_return", "nav"]).unionByName(
        rolling_periods.rolling_periods(orders, "account_id", day, ["slippage_bps"])
    )
    return rolled.withColumnRenamed("entity", "account_id").withColumn("as_of_day", F.date_format("day", "yyyy-MM-dd")).drop("day")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that hold no value."""
    return _rolled(spark, sf_dir).where("n_values = 0").select("account_id", "as_of_day", "metric", "window_days")


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rolling totals and averages, in single precision for comparison."""
    return _rolled(spark, sf_dir).select(
        "account_id", "as_of_day", "metric", "window_days", "n_values",
        F.when(F.col("metric") == "nav", F.round("total", 2)).otherwise(F.col("total").cast("float").cast("double")).alias("total"),
        F.when(F.col("metric") == "nav", F.round("total", 2) / F.col("n_values")).otherwise(F.col("average").cast("float").cast("double")).alias("average"),
        *[F.col(c).cast("float").cast("double").alias(c) for c in ("minimum", "maximum")],
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members added, removed or changed from one revision to the next."""
    return revisions.member_changes(table(spark, sf_dir, "wiki_revisions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that cannot be true: impossible values, spikes, stuck runs."""
    trades = table(spark, sf_dir, "trade_events").select("agg_trade_id", "symbol", "exchange_ts_ns", "price", "size").where("exchange_ts_ns is not null")
    key = F.col("agg_trade_id").cast("string").alias("row_key")

    def case(df: DataFrame, tbl: str, row_key, field) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), row_key, field.alias("field_name"))

    readings = trades.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in ("price", "size")])).alias("r"))
    found = case(readings.where(outliers.impossible(F.col("r.v"))), "trade_events", F.col("row_key"), F.col("r.f"))
    sequence = outliers.sequence_outliers(trades, "symbol", "exchange_ts_ns", "agg_trade_id", "price", "size", slot=60_000_000_000)
    found = found.union(case(sequence, "trade_events", F.col("row_key").cast("string"), F.col("field")))
    found = found.union(case(outliers.level_outliers(trades.select("agg_trade_id", "symbol", "size"), "above", "symbol", "size"), "trade_events", key, F.lit("size")))

    filled_us = F.unix_micros(F.col("filled_at").try_cast("timestamp")).alias("filled_us")
    fills = table(spark, sf_dir, "exec_orders").where("fill_price is not null").select("order_id", "account_id", "ticker", filled_us, "fill_price").distinct()
    order = F.col("order_id").alias("row_key")
    for part in (
        fills.where(outliers.impossible(F.col("fill_price"))),
        outliers.level_outliers(fills, "level", "ticker", "fill_price"),
        outliers.stuck_readings(fills, ["account_id", "ticker"], "filled_us", "order_id", "fill_price", slot=86_400_000_000),
    ):
        found = found.union(case(part, "exec_orders", order, F.lit("fill_price")))
    return found.distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added, removed, renamed or retyped from one revision to the next."""
    return revisions.schema_changes(table(spark, sf_dir, "wiki_revisions")).distinct()


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision's members in one consistent table (fields as JSON)."""
    rows = revisions.unified_members(table(spark, sf_dir, "wiki_revisions"))
    return rows.withColumn("fields", F.to_json("fields"))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p2_found, p2_rolling, p3_found, p4_found, p5_found, p5_unified)}

_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_LINES = rf"""
WITH typed AS (
  SELECT line_id, file_name, line_no, raw, regexp_replace(regexp_replace(coalesce(raw, ''), '^﻿+', ''), '[\r\n]+$', '') AS line,
         regexp_matches(file_name, '(^|/)cm[^/]*bhav\.csv$') AS bar, regexp_matches(file_name, '(^|/)MTO_[^/]*\.DAT$') AS delivery
  FROM eod_lines),
heads AS (SELECT file_name, list_transform(string_split(min(line), ','), lambda x: upper(trim(x))) AS cols FROM typed WHERE bar AND line_no = 1 GROUP BY 1),
lines AS (
  SELECT t.*, h.cols, regexp_full_match(line, '{_FIELD}(,{_FIELD})*') AS quotes_ok,
         list_transform(regexp_extract_all(',' || line, ',{_FIELD}', 1),
           lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, chr(32) || chr(9) || chr(13) || chr(160))) AS f
  FROM typed t LEFT JOIN heads h USING (file_name)
  WHERE (bar AND line_no > 1) OR (delivery AND starts_with(raw, '20'))),
checked AS (
  SELECT *, CASE WHEN bar THEN len(cols) ELSE 7 END AS width,
    NOT bar OR (regexp_full_match(f[list_position(cols, 'TOTTRDQTY')], '[0-9]+') AND try_cast(f[list_position(cols, 'TOTTRDQTY')] AS BIGINT) IS NOT NULL) AS qty_ok,
    NOT bar OR (regexp_full_match(f[list_position(cols, 'TIMESTAMP')], '[0-9]{{1,2}}-(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)-[0-9]{{4}}')
       AND try_strptime(f[list_position(cols, 'TIMESTAMP')], '%-d-%b-%Y') IS NOT NULL) AS day_ok,
    bar OR (CASE WHEN f[7] = '-' THEN f[4] <> 'EQ' ELSE regexp_full_match(f[7], '[0-9]+(\.[0-9]+)?') AND try_cast(f[7] AS DOUBLE) <= 100 END) AS pct_ok
  FROM lines)
"""

ORACLE = {
    "p1_found": _LINES
    + """
SELECT line_id, 'quoting' AS reason FROM checked WHERE NOT quotes_ok
UNION ALL SELECT line_id, 'column_count' FROM checked WHERE quotes_ok AND len(f) <> width
UNION ALL SELECT line_id, 'tottrdqty' FROM checked WHERE quotes_ok AND len(f) = width AND NOT qty_ok
UNION ALL SELECT line_id, 'timestamp' FROM checked WHERE quotes_ok AND len(f) = width AND NOT day_ok
UNION ALL SELECT line_id, 'deliv_per' FROM checked WHERE quotes_ok AND len(f) = width AND NOT pct_ok
""",
    "p1_loaded": _LINES
    + """
SELECT line_id, CASE WHEN bar THEN 'bar' ELSE 'delivery' END AS file_kind,
  CASE WHEN bar THEN f[list_position(cols, 'SYMBOL')] ELSE f[3] END AS symbol,
  CASE WHEN bar THEN f[list_position(cols, 'SERIES')] ELSE f[4] END AS series,
  {prices},
  try_cast(CASE WHEN bar THEN f[list_position(cols, 'TOTTRDQTY')] ELSE f[5] END AS BIGINT) AS quantity,
  CASE WHEN bar THEN try_strptime(f[list_position(cols, 'TIMESTAMP')], '%-d-%b-%Y') ELSE try_strptime(regexp_extract(file_name, 'MTO_([0-9]{8})[.]DAT$', 1), '%d%m%Y') END::DATE AS day,
  CASE WHEN NOT bar THEN try_cast(f[6] AS BIGINT) END AS delivered,
  CASE WHEN NOT bar THEN try_cast(f[7] AS DOUBLE) END AS delivered_pct
FROM checked WHERE quotes_ok AND len(f) = width AND qty_ok AND day_ok AND pct_ok
""".replace("{prices}", ",\n  ".join(f"CASE WHEN bar THEN try_cast(f[list_position(cols, '{header}')] AS DOUBLE) END AS {name}" for name, header in eod_files._NUMBERS.items())),
}

_DAY = r"try_cast(CASE WHEN regexp_matches({0}, '^\d{{8}}') THEN substr({0}, 1, 4) || '-' || substr({0}, 5, 2) || '-' || substr({0}, 7, 2) ELSE replace(replace(substr({0}, 1, 10), '/', '-'), '.', '-') END AS DATE)".format("date")
_ROLLED = f"""
WITH states AS (
  SELECT account_id, {_DAY} AS day, arg_max({{'r': daily_return, 'n': nav}}, recorded_at) AS s FROM snapshots GROUP BY 1, 2),
daily AS (
  SELECT account_id, day, 'daily_return' AS metric, s.r AS v FROM states
  UNION ALL SELECT account_id, day, 'nav', s.n FROM states
  UNION ALL SELECT account_id, {_DAY}, 'slippage_bps', slippage_bps FROM (SELECT DISTINCT * FROM exec_orders)),
spans AS (SELECT account_id, metric, min(day) AS a, max(day) AS b FROM daily WHERE day IS NOT NULL AND account_id IS NOT NULL GROUP BY 1, 2),
calendar AS (SELECT account_id, metric, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM spans),
rolled AS (
  SELECT c.account_id, strftime(c.day, '%Y-%m-%d') AS as_of_day, c.metric, w.window_days, count(d.v) AS n_values, sum(d.v) AS total, avg(d.v) AS average, min(d.v) AS minimum, max(d.v) AS maximum
  FROM calendar c CROSS JOIN (SELECT unnest([7, 30])::BIGINT AS window_days) w
  LEFT JOIN daily d ON d.account_id = c.account_id AND d.metric = c.metric AND d.day <= c.day AND d.day > c.day - CAST(w.window_days AS INTEGER)
  GROUP BY 1, 2, 3, 4)
"""
ORACLE["p2_found"] = _ROLLED + "SELECT account_id, as_of_day, metric, window_days FROM rolled WHERE n_values = 0"
ORACLE["p2_rolling"] = _ROLLED + (
    "SELECT account_id, as_of_day, metric, window_days, n_values, CASE WHEN metric = 'nav' THEN round(total, 2) ELSE total::FLOAT::DOUBLE END AS total, CASE WHEN metric = 'nav' THEN round(total, 2) / n_values ELSE average::FLOAT::DOUBLE END AS average, "
    "minimum::FLOAT::DOUBLE AS minimum, maximum::FLOAT::DOUBLE AS maximum FROM rolled"
)
