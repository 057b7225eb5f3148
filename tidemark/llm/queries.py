"""Queries of the llm operators and the SQL that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import encoding, leakage, nearest_time, subjects
from tidemark.session import table

TOLERANCE_NS = 500_000_000


def _matched(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    states, trades = table(spark, sf_dir, "book_snapshots"), table(spark, sf_dir, "trade_events")
    return nearest_time.nearest_time(states, trades, "symbol", "exchange_ts_ns", "last_update_id", "agg_trade_id", TOLERANCE_NS, carry, "trade_")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest trade of each book state."""
    return _matched(spark, sf_dir).select("last_update_id", "agg_trade_id")


def p6_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the trade's price; of a trade delivered more than once any delivery has the same."""
    return _matched(spark, sf_dir, ("price",)).select("last_update_id", "agg_trade_id", "distance", "trade_price")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold text of test items."""
    found = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each test item leaked, and how much of it at most."""
    found = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    counts = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("words").alias("most_words"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite").join(counts, "item_id", "left").fillna(0, ["n_docs", "most_words"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that each document treats."""
    return subjects.label_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples")).distinct()


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of the corpus by subject."""
    areas = table(spark, sf_dir, "subject_areas").select("subject")
    return areas.join(p9_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs")), "subject", "left").fillna(0, ["n_docs"])


QUERIES = {f.__name__: f for f in (p6_found, p6_matched, p7_ids, p8_found, p8_report, p9_found, p9_makeup)}

_NEAREST = """
WITH l AS (SELECT DISTINCT last_update_id, symbol, exchange_ts_ns AS t FROM book_snapshots WHERE exchange_ts_ns IS NOT NULL AND symbol IS NOT NULL AND last_update_id IS NOT NULL),
r AS (SELECT symbol, exchange_ts_ns AS t, min(agg_trade_id) AS agg_trade_id, max(price) AS price FROM trade_events WHERE exchange_ts_ns IS NOT NULL AND symbol IS NOT NULL GROUP BY 1, 2),
b AS (SELECT l.last_update_id, r.agg_trade_id, r.price, l.t - r.t AS d, 0 AS side FROM l ASOF JOIN r ON l.symbol = r.symbol AND l.t >= r.t),
a AS (SELECT l.last_update_id, r.agg_trade_id, r.price, r.t - l.t AS d, 1 AS side FROM l ASOF JOIN r ON l.symbol = r.symbol AND l.t <= r.t),
n AS (SELECT *, row_number() OVER (PARTITION BY last_update_id ORDER BY d, side) AS k FROM (SELECT * FROM b UNION ALL SELECT * FROM a))
"""
ORACLE = {
    "p6_found": _NEAREST + "SELECT last_update_id, agg_trade_id FROM n WHERE k = 1 AND d <= 500000000",
    "p6_matched": _NEAREST + "SELECT last_update_id, agg_trade_id, d AS distance, price AS trade_price FROM n WHERE k = 1 AND d <= 500000000",
}
