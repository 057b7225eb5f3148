"""The factor catalogue: each factor in its plan form and its parity form.

A factor is a function from a bars table to the same table with a score column.
Windows are row counts (`Horizons`), daily by default; `Horizons.weekly()` is the
scaled set for weekly bars.  `REGISTRY` is the plug-in surface: name -> form -> function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel as P


@dataclass(frozen=True)
class Horizons:
    """Rows of each look-back."""

    year: int = 252
    quarter: int = 63
    month: int = 21
    week: int = 5
    fortnight: int = 10
    surge: int = 20
    surge_short: int = 5
    vol: int = 60
    rsi: int = 14
    long_year: int = 1029
    annual: float = 252.0

    @staticmethod
    def weekly() -> "Horizons":
        return Horizons(52, 13, 4, 1, 2, 8, 2, 12, 14, 104, 52.0)


H = Horizons()
Factor = Callable[[DataFrame, Horizons], DataFrame]


def _score(df: DataFrame, expr) -> DataFrame:
    return df.withColumn("score", expr)


def momentum(df: DataFrame, h: Horizons = H) -> DataFrame:
    return _score(df, P.simple_return("close", h.year) - P.simple_return("close", h.month))


def momentum_parity(df: DataFrame, h: Horizons = H) -> DataFrame:
    old = P.lag("close", h.year)
    return _score(df, F.when(old > 0, (P.lag("close", h.month) - old) / old))


def mean_reversion(df: DataFrame, h: Horizons = H) -> DataFrame:
    return _score(df, -P.simple_return("close", h.week))


def volume_surge(df: DataFrame, h: Horizons = H) -> DataFrame:
    usual = P.rolling(F.avg, "volume", h.surge)
    return _score(df, F.when(usual > 0, F.col("volume") / usual * P.simple_return("close", 1)))


def volume_surge_parity(df: DataFrame, h: Horizons = H) -> DataFrame:
    usual = P.rolling(F.avg, "volume", h.surge)
    return _score(df, F.when(usual > 0, (P.rolling(F.avg, "volume", h.surge_short) - usual) / usual))


def rsi_divergence(df: DataFrame, h: Horizons = H) -> DataFrame:
    """Piecewise: oversold scores up, overbought down, linear between."""
    df = df.withColumn("_step", F.col("close") - P.lag("close", 1))
    r = P.rsi_of_steps("_step", h.rsi)
    df = df.withColumn("_rsi", r).drop("_step")
    r = F.col("_rsi")
    return _score(df, F.when(r < 30, (30 - r) / 30.0).when(r > 70, -(r - 70) / 30.0).otherwise((50 - r) / 50.0 * 0.5)).drop("_rsi")


def rsi_divergence_parity(df: DataFrame, h: Horizons = H) -> DataFrame:
    df = df.withColumn("_step", F.col("close") - P.lag("close", 1))
    return _score(df, (P.rsi_of_steps("_step", h.rsi) - 50.0) / 50.0).drop("_step")


def earnings_drift(df: DataFrame, h: Horizons = H) -> DataFrame:
    df = df.withColumn("_r", P.log_return("close"))
    vol = P.rolling(F.stddev_samp, "_r", h.surge) * h.annual**0.5
    return _score(df, P.simple_return("close", h.quarter) / F.greatest(vol, F.lit(0.01))).drop("_r")


def earnings_drift_parity(df: DataFrame, h: Horizons = H) -> DataFrame:
    return _score(df, P.simple_return("close", h.fortnight))


def low_volatility(df: DataFrame, h: Horizons = H) -> DataFrame:
    df = df.withColumn("_r", P.log_return("close"))
    return _score(df, -P.rolling(F.stddev_samp, "_r", h.vol) * h.annual**0.5).drop("_r")


def amihud_illiquidity(df: DataFrame, h: Horizons = H, floor: float = 1e-6) -> DataFrame:
    df = df.withColumn("_r", P.simple_return("close"))
    return _score(df, P.amihud("_r", "close", "volume", h.surge, min(10, h.surge), floor)).drop("_r")


def amihud_parity(df: DataFrame, h: Horizons = H) -> DataFrame:
    return amihud_illiquidity(df, h, 1.0)


def with_market(df: DataFrame) -> DataFrame:
    """Adds log returns and the market's: the mean of log returns over the date."""
    df = df.withColumn("_r", P.log_return("close"))
    return df.withColumn("_m", F.when(F.col("_r").isNotNull(), F.avg("_r").over(P.cs())))


def _residual(df: DataFrame, h: Horizons) -> DataFrame:
    """Adds the residual of each row's own rolling regression on the market."""
    df = with_market(df)
    frame = P.ts().rowsBetween(-(h.vol - 1), 0)
    full = F.count("_r").over(frame) == h.vol
    beta = F.when(full, F.covar_samp("_r", "_m").over(frame) / F.nullif(F.var_samp("_m").over(frame), F.lit(0.0)))
    df = df.withColumn("_b", beta)
    alpha = F.avg("_r").over(frame) - F.col("_b") * F.avg("_m").over(frame)
    return df.withColumn("_a", alpha).withColumn("_e", F.col("_r") - F.col("_a") - F.col("_b") * F.col("_m"))


def idiosyncratic_volatility(df: DataFrame, h: Horizons = H) -> DataFrame:
    """-sqrt(SSE / (n - 2)) of one fit on the last window, annualised."""
    df = with_market(df)
    frame = P.ts().rowsBetween(-(h.vol - 1), 0)
    full = F.count("_r").over(frame) == h.vol
    sse = (h.vol - 1) * (F.var_samp("_r").over(frame) - F.pow(F.covar_samp("_r", "_m").over(frame), 2.0) / F.nullif(F.var_samp("_m").over(frame), F.lit(0.0)))
    return _score(df, F.when(full, -F.sqrt(F.greatest(sse, F.lit(0.0)) / (h.vol - 2)) * h.annual**0.5)).drop("_r", "_m")


def idiosyncratic_volatility_parity(df: DataFrame, h: Horizons = H) -> DataFrame:
    df = _residual(df, h)
    return _score(df, -P.rolling(F.stddev_samp, "_e", h.vol) * h.annual**0.5).drop("_r", "_m", "_a", "_b", "_e")


def residual_reversal(df: DataFrame, h: Horizons = H) -> DataFrame:
    """-sum of the last five residuals of one fit on the last window."""
    df = with_market(df)
    frame, last = P.ts().rowsBetween(-(h.vol - 1), 0), P.ts().rowsBetween(-4, 0)
    full = F.count("_r").over(frame) == h.vol
    df = df.withColumn("_b", F.covar_samp("_r", "_m").over(frame) / F.nullif(F.var_samp("_m").over(frame), F.lit(0.0)))
    df = df.withColumn("_a", F.avg("_r").over(frame) - F.col("_b") * F.avg("_m").over(frame))
    return _score(df, F.when(full, -(F.sum("_r").over(last) - 5 * F.col("_a") - F.col("_b") * F.sum("_m").over(last)))).drop("_r", "_m", "_a", "_b")


def residual_reversal_parity(df: DataFrame, h: Horizons = H) -> DataFrame:
    df = _residual(df, h)
    return _score(df, -P.rolling(F.sum, "_e", 5)).drop("_r", "_m", "_a", "_b", "_e")


def risk_managed_momentum(df: DataFrame, h: Horizons = H) -> DataFrame:
    df = df.withColumn("_r", P.log_return("close"))
    raw = P.simple_return("close", h.year) - P.simple_return("close", h.month)
    return _score(df, raw / F.greatest(P.rolling(F.stddev_samp, "_r", h.quarter), F.lit(1e-3))).drop("_r")


def long_horizon_reversal(df: DataFrame, h: Horizons = H) -> DataFrame:
    old = P.lag("close", h.long_year)
    return _score(df, F.when(old > 0, -(P.lag("close", h.month) / old - 1.0)))


def execution_momentum(df: DataFrame, h: Horizons = H) -> DataFrame:
    near = -(F.col("close") / P.rolling(F.avg, "close", h.month) - 1.0)
    return _score(df, 0.4 * P.simple_return("close", h.month) + 0.4 * P.simple_return("close", h.week) + 0.2 * near)


REGISTRY: dict[str, dict[str, Factor]] = {
    "momentum": {"plan": momentum, "parity": momentum_parity},
    "mean_reversion": {"plan": mean_reversion, "parity": mean_reversion},
    "volume_surge": {"plan": volume_surge, "parity": volume_surge_parity},
    "rsi_divergence": {"plan": rsi_divergence, "parity": rsi_divergence_parity},
    "earnings_drift": {"plan": earnings_drift, "parity": earnings_drift_parity},
    "low_volatility": {"plan": low_volatility, "parity": low_volatility},
    "amihud_illiquidity": {"plan": amihud_illiquidity, "parity": amihud_parity},
    "idiosyncratic_volatility": {"plan": idiosyncratic_volatility, "parity": idiosyncratic_volatility_parity},
    "residual_reversal": {"plan": residual_reversal, "parity": residual_reversal_parity},
    "risk_managed_momentum": {"plan": risk_managed_momentum, "parity": risk_managed_momentum},
    "long_horizon_reversal": {"plan": long_horizon_reversal, "parity": long_horizon_reversal},
    "execution_momentum": {"plan": execution_momentum, "parity": execution_momentum},
}


def register(name: str, plan: Factor, parity: Factor | None = None) -> None:
    """Adds a factor to the catalogue."""
    REGISTRY[name] = {"plan": plan, "parity": parity or plan}


def scores(bars: DataFrame, h: Horizons = H, names: tuple[str, ...] | None = None, form: str = "plan") -> DataFrame:
    """(date, ticker, factor, score) of several factors: all windows share one exchange and sort of the bars, then a row a factor."""
    df, columns = bars, []
    for name in names or tuple(REGISTRY):
        df = REGISTRY[name][form](df, h).withColumnRenamed("score", f"_score_{name}")
        columns.append((name, f"_score_{name}"))
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(c).cast("double").alias("score")) for n, c in columns])
    return df.select("date", "ticker", F.inline(rows))


def composite(scores: DataFrame) -> DataFrame:
    """(date, ticker, composite, signal) from long scores (date, ticker, factor, score).

    Mean cross-sectional z-score (deviation at least 1e-8) times 40, within +-100; LONG above 40, SHORT below -40.
    """
    w = Window.partitionBy("date", "factor")
    z = (F.col("score") - F.avg("score").over(w)) / F.greatest(F.stddev_samp("score").over(w), F.lit(1e-8))
    zs = scores.where("score is not null").withColumn("z", z)
    out = zs.groupBy("date", "ticker").agg((F.avg("z") * 40.0).alias("raw"))
    out = out.select("date", "ticker", F.greatest(F.least("raw", F.lit(100.0)), F.lit(-100.0)).alias("composite"))
    signal = F.when(F.col("composite") > 40, "LONG").when(F.col("composite") < -40, "SHORT").otherwise("NEUTRAL")
    return out.withColumn("signal", signal)
