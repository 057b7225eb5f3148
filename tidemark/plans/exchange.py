"""Bars joined to deliveries: the unified store, its conflicts, and the delivery factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.base import r6, r6_sql
from tidemark.plans.problems import ORACLE as _PROBLEMS
from tidemark.session import cached, table
from tidemark.sources import eod_files, store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


_KEY = ["day", "symbol", "series"]
_BAR = ["open", "high", "low", "close", "last", "prev_close", "quantity", "value"]
_STORE = (
    "WITH loaded AS (" + _PROBLEMS["p1_loaded"] + "), "
    f"b AS (SELECT *, count(*) OVER (PARTITION BY day, symbol, series) AS k FROM (SELECT DISTINCT {', '.join(_KEY + _BAR)} FROM loaded WHERE file_kind = 'bar' AND series = 'EQ')), "
    "d AS (SELECT *, count(*) OVER (PARTITION BY day, symbol, series) AS k FROM (SELECT DISTINCT day, symbol, series, quantity AS traded, delivered, delivered_pct FROM loaded WHERE file_kind = 'delivery' AND series = 'EQ')), "
    "j AS (SELECT b.*, d.traded, d.delivered, d.delivered_pct FROM b JOIN d USING (day, symbol, series) WHERE b.k = 1 AND d.k = 1)"
)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(bars, deliveries) of series EQ, files delivered twice once, each with `k`: rows of its key."""
    loaded = cached(spark, sf, ("eod_lines",), "eod_loaded", lambda: eod_files.strict_load(table(spark, sf, "eod_lines"))).where("series = 'EQ'")
    n = F.count(F.lit(1)).over(Window.partitionBy(*_KEY))
    b = loaded.where("file_kind = 'bar'").select(*_KEY, *_BAR).distinct().withColumn("k", n)
    d = loaded.where("file_kind = 'delivery'").select(*_KEY, F.col("quantity").alias("traded"), "delivered", "delivered_pct").distinct().withColumn("k", n)
    return b, d


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with their delivery, one to one: a key that repeats on either side joins nothing and is reported instead."""
    b, d = _sides(spark, sf)
    return b.where("k = 1").drop("k").join(d.where("k = 1").drop("k"), _KEY)


def _unified(j: DataFrame) -> DataFrame:
    return j.where("quantity = traded").select(
        F.col("day").alias("date"), "symbol", "series", "open", "high", "low", "close", "last", "prev_close", F.col("quantity").alias("volume"), "value",
        F.lit(None).cast("bigint").alias("num_trades"), F.col("delivered").alias("deliv_qty"), F.col("delivered_pct").alias("deliv_pct"), F.lit("legacy").alias("source_era"),
    )


_UNIFIED = "SELECT day AS date, symbol, series, open, high, low, close, last, prev_close, quantity AS volume, value, NULL::BIGINT AS num_trades, delivered AS deliv_qty, delivered_pct AS deliv_pct, 'legacy' AS source_era FROM j WHERE quantity = traded"


@_add("delivery_store", _STORE + " " + _UNIFIED)
def delivery_store(spark: SparkSession, sf: str) -> DataFrame:
    """The unified store of fifteen columns: bars and deliveries that agree on the traded quantity."""
    return _unified(_joined(spark, sf))


@_add("quantity_disagreements", _STORE + " SELECT day AS date, symbol, series, quantity AS bar_volume, traded AS delivery_volume, quantity - traded AS delta FROM j WHERE quantity <> traded")
def quantity_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """Joined rows whose two files differ on the traded quantity, set apart."""
    return _joined(spark, sf).where("quantity <> traded").select(
        F.col("day").alias("date"), "symbol", "series", F.col("quantity").alias("bar_volume"), F.col("traded").alias("delivery_volume"), (F.col("quantity") - F.col("traded")).alias("delta")
    )


@_add(
    "store_reconciliation",
    _STORE
    + ", a AS (SELECT day, symbol, max(b) AS b, max(d) AS d, max(q) AS q, max(t) AS t FROM (SELECT day, symbol, k AS b, 0 AS d, quantity AS q, NULL AS t FROM b UNION ALL SELECT day, symbol, 0, k, NULL, traded FROM d) GROUP BY 1, 2) "
    "SELECT day AS date, sum(b)::BIGINT AS bar_rows, sum(d)::BIGINT AS delivery_rows, count(CASE WHEN b > 1 OR d > 1 THEN 1 END) AS repeated, count(CASE WHEN d = 0 THEN 1 END) AS only_bar, count(CASE WHEN b = 0 THEN 1 END) AS only_delivery, count(CASE WHEN b = 1 AND d = 1 AND q = t THEN 1 END) AS agreed, count(CASE WHEN b = 1 AND d = 1 AND q <> t THEN 1 END) AS differing FROM a GROUP BY 1",
)
def store_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """By day: rows of both files, keys that repeat, stand on one side only, agree and differ; one shuffle, no join."""
    b, d = _sides(spark, sf)
    none = F.lit(None).cast("bigint")
    both = b.select("day", "symbol", F.col("k").alias("b"), F.lit(0).cast("bigint").alias("d"), F.col("quantity").alias("q"), none.alias("t")).unionByName(
        d.select("day", "symbol", F.lit(0).cast("bigint").alias("b"), F.col("k").alias("d"), none.alias("q"), F.col("traded").alias("t"))
    )
    a = both.groupBy("day", "symbol").agg(*[F.max(c).alias(c) for c in "bdqt"])
    one = (F.col("b") == 1) & (F.col("d") == 1)
    return a.groupBy(F.col("day").alias("date")).agg(
        F.sum("b").alias("bar_rows"), F.sum("d").alias("delivery_rows"), F.count_if((F.col("b") > 1) | (F.col("d") > 1)).alias("repeated"), F.count_if(F.col("d") == 0).alias("only_bar"),
        F.count_if(F.col("b") == 0).alias("only_delivery"), F.count_if(one & (F.col("q") == F.col("t"))).alias("agreed"), F.count_if(one & (F.col("q") != F.col("t"))).alias("differing"),
    )


@_add("store_by_year", _STORE + ", u AS (" + _UNIFIED + f") SELECT symbol, year(date) AS year, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, sum(volume)::BIGINT AS volume, {r6_sql('avg(deliv_pct)', 'mean_pct')} FROM u WHERE year(date) = 2006 GROUP BY 1, 2")
def store_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """The unified store built by symbol and year, one year of it read back by partition pruning."""
    built = store.BarStore.temporary(spark, "eod")
    built.write(_unified(_joined(spark, sf)).withColumnRenamed("symbol", "ticker"))
    rows = spark.read.parquet(built.path).where("year = 2006")
    return rows.groupBy(F.col("ticker").alias("symbol"), F.col("year")).agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("volume").alias("volume"), r6(F.avg("deliv_pct"), "mean_pct"))


_LOOK = 21
_w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {_LOOK - 1} PRECEDING AND CURRENT ROW)"


@_add(
    "factor_delivery",
    _STORE
    + ", u AS ("
    + _UNIFIED
    + f"), m AS (SELECT date, symbol, CASE WHEN close IS NOT NULL AND count(deliv_pct) {_w} >= {_LOOK // 2} THEN avg(deliv_pct) {_w} END AS m FROM u) SELECT date, symbol, round((m - avg(m) OVER (PARTITION BY date)) / nullif(stddev_samp(m) OVER (PARTITION BY date), 0), 5) + 0.0 AS score FROM m WHERE m IS NOT NULL",
)
def factor_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Share delivered: mean of 21 rows (half of them at least), as z-score over the day's names."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-_LOOK + 1, 0)
    mean = F.when(F.col("close").isNotNull() & (F.count("deliv_pct").over(w) >= _LOOK // 2), F.avg("deliv_pct").over(w))
    m = _unified(_joined(spark, sf)).select("date", "symbol", mean.alias("m")).where("m is not null")
    day = Window.partitionBy("date")
    z = (F.col("m") - F.avg("m").over(day)) / F.nullif(F.stddev_samp("m").over(day), F.lit(0.0))
    return m.select("date", "symbol", (F.round(z, 5) + 0.0).alias("score"))
