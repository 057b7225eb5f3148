"""Option values for whole tables, in stages so that each projection stays small enough for code generation.

d1 enters the normal distribution's polynomial some twenty times; as one expression the
generated method grows beyond what the JVM compiles.  Catalyst does not merge
projections that would repeat a costly expression, so stages stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def with_option_values(df: DataFrame, spot: str, strike: str, sigma: str, years: str, rate: float) -> DataFrame:
    """df with call, put, call_delta and put_delta (Black-Scholes)."""
    s, k, v, t = (F.col(c) for c in (spot, strike, sigma, years))
    live = df.withColumn("_a", S.d1(s, k, v, t, rate)).withColumn("_b", F.col("_a") - v * F.sqrt(t))
    live = live.withColumns({"_na": S.normal_cdf(F.col("_a"))}).withColumns({"_nb": S.normal_cdf(F.col("_b"))})
    disc = k * F.exp(-rate * t)
    call = s * F.col("_na") - disc * F.col("_nb")
    dead = (t <= 0) | (v <= 0)
    out = live.withColumns(
        {
            "call": F.when(dead, F.greatest(s - k, F.lit(0.0))).otherwise(call),
            "put": F.when(dead, F.greatest(k - s, F.lit(0.0))).otherwise(disc * (1 - F.col("_nb")) - s * (1 - F.col("_na"))),
            "call_delta": F.col("_na"),
            "put_delta": F.col("_na") - 1.0,
        }
    )
    return out.drop("_a", "_b", "_na", "_nb")


def with_strike_for_delta(df: DataFrame, spot: str, delta: str, sigma: str, years: str, rate: float, call: bool, name: str = "strike_back") -> DataFrame:
    """df with the strike at which the option has the given delta."""
    s, v, t = (F.col(c) for c in (spot, sigma, years))
    d = F.col(delta) if call else F.col(delta) + 1.0
    z = df.withColumn("_z", S.normal_quantile(d))
    return z.withColumn(name, s * F.exp(-F.col("_z") * v * F.sqrt(t) + (rate + v * v / 2.0) * t)).drop("_z")
