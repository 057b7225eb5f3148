"""Shared views of the driver tables for the panel queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cached, table


def r6(x: Column | str, name: str | None = None) -> Column:
    """Rounded for comparison; minus zero becomes zero."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.round(c, 6) + F.lit(0.0)).alias(name or x)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced trades: one row per order line with ticker, day, price and quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("ticker"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("value"),
    )


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Open, high, low, close and volume per ticker and week (or day), with a sector; built once a session."""
    return cached(spark, sf_dir, ("lineitem", "part"), f"bars_{unit}", lambda: _bars(spark, sf_dir, unit))


def _bars(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    order = F.struct("ts", "l_orderkey", "l_linenumber", "value", "qty")
    day = F.to_date(F.date_trunc(unit, "ts"))
    grouped = ticks(spark, sf_dir).groupBy("ticker", day.alias("date")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume")
    )
    return grouped.withColumn("sector", F.regexp_extract("ticker", r"(\d+)$", 1).cast("int") % 5)


def bars_sql(unit: str = "week") -> str:
    """CTE `bars`, to be followed by further CTEs or a SELECT."""
    key = f"p_brand, date_trunc('{unit}', l_shipdate)"
    return f"""WITH px AS (
  SELECT p_brand AS ticker, date_trunc('{unit}', l_shipdate)::DATE AS date, l_extendedprice / l_quantity AS price, l_quantity AS qty,
    row_number() OVER (PARTITION BY {key} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS a,
    row_number() OVER (PARTITION BY {key} ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS z
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT ticker, date, max(CASE WHEN a = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
    max(CASE WHEN z = 1 THEN price END) AS close, sum(qty) AS volume, CAST(regexp_extract(ticker, '([0-9]+)$', 1) AS INTEGER) % 5 AS sector
  FROM px GROUP BY 1, 2)
"""


B = bars_sql()


def over(frame: str = "", part: str = "ticker") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY date {frame})"


def lag_sql(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {over()}" if n >= 0 else f"lead({x}, {-n}) {over()}"


def ret_sql(x: str, n: int = 1) -> str:
    return f"CASE WHEN {lag_sql(x, n)} > 0 THEN {x} / {lag_sql(x, n)} - 1 END"


def roll_sql(agg: str, x: str, rows: int, least: int | None = None, shift: int = 0) -> str:
    """agg with {} for the value, e.g. 'avg({})'."""
    end = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    w = over(f"ROWS BETWEEN {rows - 1 + shift} PRECEDING AND {end}")
    return f"CASE WHEN count({x}) {w} >= {rows if least is None else least} THEN {agg.format(x)} {w} END"


def r6_sql(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"
