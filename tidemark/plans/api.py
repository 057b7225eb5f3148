"""The service's read routes as functions that return DataFrames; there is no server.

Each takes a bars table (ticker, date, open, high, low, close, volume[, sector]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats as ST
from tidemark.operators import backtest as BT
from tidemark.operators import factors as FA
from tidemark.operators import panel as P


def prices(bars: DataFrame, tickers: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Price series of the tickers in [start, end]."""
    out = bars.where(F.col("ticker").isin(tickers))
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out.select("ticker", "date", "close", "volume")


def universe(bars: DataFrame) -> DataFrame:
    """Tickers with their sector and the range of their dates."""
    return bars.groupBy("ticker").agg(F.max("sector").alias("sector"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"))


def check_request(bars: DataFrame, tickers: list[str], start: str, end: str, quarantined: tuple[str, ...] = ()) -> None:
    """Raises if a ticker is unknown or quarantined, or the range lies outside its data."""
    bad = sorted(set(tickers) & set(quarantined))
    if bad:
        raise ValueError(f"quarantined: {', '.join(bad)}")
    known = {r.ticker: r for r in universe(bars.where(F.col("ticker").isin(tickers))).collect()}  # one row a requested ticker
    missing = sorted(set(tickers) - set(known))
    if missing:
        raise ValueError(f"unknown: {', '.join(missing)}")
    for t, r in sorted(known.items()):
        if start < str(r.first_date) or end > str(r.last_date):
            raise ValueError(f"{t} has data from {r.first_date} to {r.last_date}")


def factor_scores(bars: DataFrame, names: list[str] | None = None, form: str = "parity", horizons: FA.Horizons = FA.H) -> DataFrame:
    """Long scores (date, ticker, factor, score) of factors of the catalogue."""
    return FA.scores(bars, horizons, tuple(names or sorted(FA.REGISTRY)), form)


def scanner(bars: DataFrame, min_score: float = 0.0, signal: str | None = None, horizons: FA.Horizons = FA.H) -> DataFrame:
    """Composite scores and signals, filtered."""
    found = FA.composite(factor_scores(bars, horizons=horizons)).where(F.abs("composite") >= min_score)
    return found.where(F.col("signal") == signal) if signal else found


def correlation(bars: DataFrame, horizons: FA.Horizons = FA.H) -> DataFrame:
    """(a, b, corr, n) of the factors' cross-sectional z-scores."""
    s = factor_scores(bars, horizons=horizons).where("score is not null")
    b = s.select("date", "ticker", F.col("factor").alias("b"), F.col("score").alias("y"))
    pairs = s.join(b, ["date", "ticker"]).where("factor < b")  # a dozen factors
    return pairs.groupBy(F.col("factor").alias("a"), "b").agg(F.corr("score", "y").alias("corr"), F.count(F.lit(1)).alias("n"))


def backtest(bars: DataFrame, factor: str = "momentum", every: int = 21, cost_bps: float = 10.0, horizons: FA.Horizons = FA.H) -> DataFrame:
    """Daily gross, turnover and net of the factor's long-short quintiles."""
    scored = FA.REGISTRY[factor]["plan"](bars, horizons)
    return BT.quintile_backtest(scored.select("ticker", "date", "close", "score"), every, cost_bps)


def metrics(returns: DataFrame, by: list[str], ret: str = "net", periods: float = 252.0) -> DataFrame:
    """Sharpe and Sortino ratio, volatility, win rate and annual return of return series."""
    r = F.col(ret)
    return returns.groupBy(*by).agg(
        ST.sharpe(ret, "metrics", periods).alias("sharpe"), ST.sortino(ret, periods).alias("sortino"), (F.stddev_samp(r) * periods**0.5).alias("volatility"), F.avg((r > 0).cast("double")).alias("win_rate"), ST.annual_return(ret, periods).alias("annual_return")
    )


def forward_ic(bars: DataFrame, factor: str, rows: int = 21, horizons: FA.Horizons = FA.H) -> DataFrame:
    """Spearman information coefficients of a factor by date."""
    scored = FA.REGISTRY[factor]["plan"](bars, horizons).withColumn("forward", P.forward_return("close", rows))
    return P.information_coefficient(scored, "score", "forward", ["date"])
