"""A 32-bit counter-based generator as Column expressions, and series drawn from it.

The generator's state after k draws is seed + k * step mod 2^32, so any draw is
computed from its number alone: rows need no order and no driver loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the generator and the string hash.
STEP, TWO32 = 0x6D2B79F5, 1 << 32


def _shift(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def multiply32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two unsigned 32-bit numbers, by halves of b (a BIGINT holds 48 bits)."""
    high, low = F.shiftright(b, 16), b.bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return (((a * high) % TWO32) * 65536 + a * low) % TWO32


def with_draw(df: DataFrame, seed: str, k: str, name: str) -> DataFrame:
    """df with its k-th draw (from 1) in [0, 1).

    Each step is a projection of its own, since it enters the next one several times.
    """
    one, mask = F.lit(1).cast("bigint"), F.lit(61).cast("bigint")
    s, t = F.col("_s"), F.col("_t")
    df = df.withColumn("_s", (F.col(seed) % TWO32 + multiply32(F.col(k).cast("bigint"), F.lit(STEP).cast("bigint"))) % TWO32)
    df = df.withColumn("_t", multiply32(s.bitwiseXOR(_shift(s, 15)), s.bitwiseOR(one)))
    df = df.withColumn("_t", ((t + multiply32(t.bitwiseXOR(_shift(t, 7)), t.bitwiseOR(mask))) % TWO32).bitwiseXOR(t))
    return df.withColumn(name, t.bitwiseXOR(_shift(t, 14)) / float(TWO32)).drop("_s", "_t")


def string_hash(text: Column) -> Column:
    """Absolute value of the signed 32-bit hash h = 31 h + c."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: (acc * 31 + c) % TWO32)
    return F.abs(F.when(h >= TWO32 // 2, h - TWO32).otherwise(h))


def synthetic_prices(spark: SparkSession, tickers: list[str], days: int, seed: int = 42) -> DataFrame:
    """(ticker, day, price, volume) of geometric walks with clamped steps.

    Draws 1..3 set level, drift and volatility; then four a day (two for the normal
    step, one for a doubled volatility, one for the volume), and a last one for the first volume.
    The path is a running product in order of days.
    """
    names = spark.createDataFrame([(t,) for t in tickers], "ticker string").withColumn("s", string_hash(F.col("ticker")) + seed)
    final = 4 + 4 * days
    drawn = with_draw(names.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(final)))), "s", "k", "u")
    k = F.col("k")
    params = drawn.where((k <= 3) | (k == final)).groupBy("ticker").agg(*[F.max(F.when(k == i, F.col("u"))).alias(f"p{i}") for i in (1, 2, 3)], F.max(F.when(k == final, F.col("u"))).alias("last"))
    day = F.floor((k - 4) / 4).cast("int") + 1
    steps = drawn.where((k > 3) & (k < final)).groupBy("ticker", day.alias("day")).agg(*[F.max(F.when((k - 4) % 4 == i - 1, F.col("u"))).alias(f"u{i}") for i in (1, 2, 3, 4)])
    start = params.select("ticker", F.lit(0).alias("day"), *[F.lit(None).cast("double").alias(f"u{i}") for i in (1, 2, 3, 4)])
    rows = steps.unionByName(start).join(params, "ticker")
    normal = F.sqrt(-2.0 * F.log("u1")) * F.cos(2.0 * math.pi * F.col("u2"))
    step = (F.col("p2") - 0.4) * 0.3 / 252 + (0.01 + F.col("p3") * 0.03) * F.when(F.col("u3") < 0.05, 2.0).otherwise(1.0) * normal
    factor = F.when(F.col("day") == 0, 50 + F.col("p1") * 450).otherwise(1 + F.greatest(F.least(step, F.lit(0.15)), F.lit(-0.15)))
    path = F.product("f").over(Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    volume = F.floor((1 + F.when(F.col("day") == 0, F.col("last")).otherwise(F.col("u4")) * 5) * 1000000)
    return rows.withColumn("f", factor).select("ticker", "day", F.greatest(path, F.lit(0.01)).alias("price"), F.greatest(volume, F.lit(100000)).alias("volume"))
