"""Statistics of return series as aggregates and Column expressions; resampling in batches.

The Sharpe ratio is defined in several ways that differ in the smallest sample, the
deviation's degrees of freedom and what a flat series gives; they are
parameters here, with the conventions in use as presets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf

EULER_GAMMA = 0.5772156649015329

#: Conventions: (least n, degrees of freedom, value below least n, value of a flat series, annualised).
SHARPE_PRESETS = {
    "metrics": (2, 1, 0.0, 0.0, True),
    "study": (30, 1, 0.0, 0.0, True),
    "portfolio": (2, 0, 0.0, 0.0, True),
    "gate": (2, 1, None, 0.0, True),
    "event": (2, 1, 0.0, 0.0, False),
    "tracker": (5, 1, 0.0, 0.0, True),
}


def sharpe(ret: Column | str, preset: str = "metrics", periods: float = 252.0) -> Column:
    """Sharpe ratio as an aggregate."""
    r = F.col(ret) if isinstance(ret, str) else ret
    least, ddof, short, flat, annual = SHARPE_PRESETS[preset]
    sd = F.stddev_samp(r) if ddof else F.stddev_pop(r)
    value = F.avg(r) / F.nullif(sd, F.lit(0.0)) * (math.sqrt(periods) if annual else 1.0)
    return F.when(F.count(r) < least, F.lit(short).cast("double")).when(sd < 1e-12, F.lit(flat)).otherwise(value)


def sortino(ret: str, periods: float = 252.0) -> Column:
    """Mean over the deviation of the negative returns; infinite with fewer than two of them and a gain."""
    r = F.col(ret)
    down = F.stddev_samp(F.when(r < 0, r))
    few = F.count(F.when(r < 0, 1)) < 2
    return F.when(few, F.when(F.avg(r) > 0, F.lit(float("inf"))).otherwise(0.0)).when(down < 1e-12, 0.0).otherwise(F.avg(r) / F.nullif(down, F.lit(0.0)) * math.sqrt(periods))


def annual_return(ret: str, periods: float = 252.0) -> Column:
    return F.pow(F.product(1.0 + F.col(ret)), periods / F.count(ret)) - 1.0


def sharpe_variance(sr: Column, n: Column, skew: Column, excess: Column) -> Column:
    """Sampling variance of a per-period Sharpe ratio under skew and kurtosis."""
    return (1.0 - skew * sr + (excess + 2.0) / 4.0 * sr * sr) / (n - 1.0)


def expected_max_sharpe(trials: float, variance: Column) -> Column:
    """Expected largest Sharpe ratio of `trials` that have none (the quantiles are constants, taken on the driver)."""
    if trials <= 1:
        return F.lit(0.0)
    nd = NormalDist()
    expected = (1.0 - EULER_GAMMA) * nd.inv_cdf(1.0 - 1.0 / trials) + EULER_GAMMA * nd.inv_cdf(1.0 - 1.0 / (trials * math.e))
    return F.sqrt(variance) * expected


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, excess: Column) -> Column:
    """Probability that the true per-period Sharpe ratio exceeds the benchmark."""
    return normal_cdf((sr - benchmark) / F.sqrt(F.greatest(sharpe_variance(sr, n, skew, excess), F.lit(1e-18))))


def deflated_sharpe(sr: Column, n: Column, skew: Column, excess: Column, trials: float, trial_variance: Column | None = None) -> Column:
    """Probabilistic Sharpe ratio against the best of `trials`.

    The benchmark's variance is the sampling variance (default) or the variance over the trials.
    """
    variance = sharpe_variance(F.lit(0.0), n, F.lit(0.0), F.lit(0.0)) if trial_variance is None else trial_variance
    return probabilistic_sharpe(sr, expected_max_sharpe(trials, variance), n, skew, excess)


def deflated_sharpe_events(sr: Column, n: Column, skew: Column, excess: Column, trials: float) -> Column:
    """The event-series variant: SR sqrt(n - 1) less the expected maximum in units of one trial."""
    spread = F.sqrt(F.greatest(1.0 - skew * sr + (excess + 2.0) / 4.0 * sr * sr, F.lit(1e-18)))
    return normal_cdf((sr * F.sqrt(n - 1.0) - expected_max_sharpe(trials, F.lit(1.0))) / spread)


def cornish_fisher_sharpe(sr: Column, skew: Column, excess: Column) -> Column:
    """Sharpe ratio adjusted for skew and excess kurtosis."""
    return sr * (1.0 + skew / 6.0 * sr - excess / 24.0 * sr * sr)


def moments(df: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """n, mean, deviation, skew and excess kurtosis (population), per-period Sharpe ratio."""
    r = F.col(ret)
    out = df.where(r.isNotNull() & ~F.isnan(r)).groupBy(*by).agg(
        F.count(r).cast("double").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess")
    )
    return out.withColumn("sr", F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)))


# --- resampling: replicates are rows, drawn and evaluated in vectorised batches ---


def stationary_indices(rng: np.random.Generator, n: int, block: float, reps: int) -> np.ndarray:
    """(reps, n) indices of the stationary bootstrap: blocks of geometric length that wrap around."""
    fresh = rng.random((reps, n)) < 1.0 / block
    fresh[:, 0] = True
    starts = rng.integers(0, n, (reps, n))
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    return (np.take_along_axis(starts, at, axis=1) + np.arange(n) - at) % n


def bootstrap_statistic(spark, series: np.ndarray, statistic, reps: int = 2000, block: float = 10.0, seed: int = 1, batch: int = 250) -> DataFrame:
    """(rep, value) of a statistic over stationary bootstrap samples of a series.

    statistic maps (reps, n[, k]) samples to (reps,) values.  The series travels with
    the task (it is one strategy's returns); replicates are spread over the cluster,
    each batch with a seed of its own, so the result does not depend on the partitioning.
    """
    data = np.asarray(series, dtype=float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"]:
                rng = np.random.default_rng([seed, int(number)])
                size = min(batch, reps - int(number) * batch)
                sample = data[stationary_indices(rng, len(data), block, size)]
                yield pd.DataFrame({"rep": np.arange(size) + int(number) * batch, "value": statistic(sample)})

    batches = -(-reps // batch)
    return spark.range(0, batches, 1, min(batches, spark.sparkContext.defaultParallelism)).mapInPandas(run, "rep bigint, value double")


def sharpe_of_samples(sample: np.ndarray, periods: float = 252.0) -> np.ndarray:
    sd = sample.std(axis=1, ddof=1)
    return np.where(sd > 1e-12, sample.mean(axis=1) / np.maximum(sd, 1e-300), 0.0) * math.sqrt(periods)


def superior_ability(performance: np.ndarray, reps: int = 1000, block: float = 10.0, seed: int = 1, recentre: str = "positive") -> tuple[float, float]:
    """(statistic, p) of the test that the best of K strategies beats the benchmark; performance: (T, K) excess.

    recentre 'positive' subtracts max(mean, 0) (superior predictive ability), 'mean' the mean (reality check).
    """
    t, _ = performance.shape
    mean = performance.mean(axis=0)
    sd = performance.std(axis=0, ddof=1)
    scale = np.where(sd > 1e-12, sd, np.inf) if recentre == "positive" else np.ones_like(sd)
    observed = float((math.sqrt(t) * mean / scale).max())
    centre = np.maximum(mean, 0.0) if recentre == "positive" else mean
    rng = np.random.default_rng(seed)
    hits = 0
    for lo in range(0, reps, 50):
        idx = stationary_indices(rng, t, block, min(50, reps - lo))
        drawn = performance[idx].mean(axis=1) - centre
        hits += int(((math.sqrt(t) * drawn / scale).max(axis=1) >= observed).sum())
    return observed, hits / reps


def superior_ability_rows(spark, performance: np.ndarray, reps: int = 1000, block: float = 10.0, seed: int = 1, batch: int = 50) -> DataFrame:
    """(test, statistic, p_value) of both tests; batches of replicates are spread over the cluster, each with its own seed."""
    t = len(performance)
    if t < 2:
        return spark.createDataFrame([], "test string, statistic double, p_value double")
    mean, sd = performance.mean(axis=0), performance.std(axis=0, ddof=1)
    tests = {"superior_ability": (np.where(sd > 1e-12, sd, np.inf), np.maximum(mean, 0.0)), "reality_check": (np.ones_like(sd), mean)}
    observed = {name: float((math.sqrt(t) * mean / scale).max()) for name, (scale, _) in tests.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"]:
                rng = np.random.default_rng([seed, int(number)])
                size = min(batch, reps - int(number) * batch)
                counts = np.zeros((size, t), np.float64)  # how often each date was drawn
                np.add.at(counts, (np.arange(size)[:, None], stationary_indices(rng, t, block, size)), 1.0)
                drawn = counts @ performance / t
                for name, (scale, centre) in tests.items():
                    hits = ((math.sqrt(t) * (drawn - centre) / scale).max(axis=1) >= observed[name]).sum()
                    yield pd.DataFrame({"test": [name], "hits": [int(hits)]})

    batches = -(-reps // batch)
    hits = spark.range(0, batches, 1, min(batches, spark.sparkContext.defaultParallelism)).mapInPandas(run, "test string, hits bigint")
    statistic = F.create_map(*[F.lit(x) for pair in observed.items() for x in pair])
    return hits.groupBy("test").agg((F.sum("hits") / reps).alias("p_value")).select("test", statistic[F.col("test")].alias("statistic"), "p_value")


def ols(y: np.ndarray, x: np.ndarray, robust: bool = False) -> dict[str, np.ndarray | float]:
    """Least squares with intercept first: coefficients, standard errors (HC0 if robust), R2, residuals."""
    z = np.column_stack([np.ones(len(y)), x])
    inverse = np.linalg.pinv(z.T @ z)
    beta = inverse @ z.T @ y
    e = y - z @ beta
    if robust:
        cov = inverse @ (z.T * e**2) @ z @ inverse
    else:
        cov = inverse * (e @ e) / max(1, len(y) - z.shape[1])
    total = ((y - y.mean()) ** 2).sum()
    return {"beta": beta, "se": np.sqrt(np.diag(cov)), "r2": 1.0 - (e @ e) / total if total > 0 else 0.0, "resid": e}


def rolling_residuals(y: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """Residual of each row under the fit on the `window` rows before it; NaN until there are so many.

    All fits are solved at once from the windows' cross-products.
    """
    n = len(y)
    out = np.full(n, np.nan)
    if n > window:
        z = np.column_stack([np.ones(n), x])
        rows = np.lib.stride_tricks.sliding_window_view(z, window, axis=0)[:-1]  # (fits, factors, window)
        past = np.lib.stride_tricks.sliding_window_view(y, window)[:-1]
        beta = np.linalg.pinv(rows @ rows.transpose(0, 2, 1), hermitian=True) @ (rows @ past[..., None])
        out[window:] = y[window:] - (z[window:] * beta[..., 0]).sum(axis=1)
    return out


def logistic_recalibration(p: np.ndarray, y: np.ndarray, steps: int = 100, weights: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, intercept) of outcomes on the log odds of forecasts, by reweighted least squares; weights are counts."""
    n = np.ones(len(p)) if weights is None else weights
    q = np.clip(p, 1e-9, 1 - 1e-9)
    z = np.column_stack([np.ones(len(q)), np.log(q / (1 - q))])
    w = np.zeros(2)
    for _ in range(steps):
        m = 1.0 / (1.0 + np.exp(-z @ w))
        step = np.linalg.solve((z * (n * m * (1 - m))[:, None]).T @ z + 1e-12 * np.eye(2), z.T @ (n * (y - m)))
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[1]), float(w[0])


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(covariance shrunk towards a scaled identity, intensity)."""
    n, k = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    mu = np.trace(s) / k
    spread = ((s - mu * np.eye(k)) ** 2).sum()
    noise = min(spread, float((((c[:, :, None] * c[:, None, :]) - s) ** 2).sum(axis=(1, 2)).sum()) / n**2)
    alpha = noise / spread if spread > 0 else 0.0
    return alpha * mu * np.eye(k) + (1 - alpha) * s, alpha


def mean_variance_weights(mu: np.ndarray, sigma: np.ndarray, risk: float = 1.0, cap: float = 0.25, steps: int = 2000) -> np.ndarray:
    """Long-only weights up to `cap` that sum to 1 and maximise mu w - risk / 2 w S w, by projected gradient."""
    k = len(mu)
    w = np.full(k, 1.0 / k)
    rate = 1.0 / max(risk * np.linalg.eigvalsh(sigma).max(), 1e-9)
    for _ in range(steps):
        moved = project_capped(w + rate * (mu - risk * sigma @ w), cap)
        if np.abs(moved - w).max() < 1e-10:
            break
        w = moved
    return w


def project_capped(v: np.ndarray, cap: float) -> np.ndarray:
    """Nearest point with 0 <= w <= cap and sum 1 (cap * len(v) >= 1)."""
    lo, hi = v.min() - 1.0, v.max()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1.0 else (lo, mid)
    return np.clip(v - (lo + hi) / 2, 0, cap)


def hurst(x: np.ndarray) -> float:
    """Rescaled-range exponent over segments of an eighth, a quarter and half of the window."""
    return float(hurst_of_windows(np.asarray(x, float)[None])[0])


def hurst_of_windows(x: np.ndarray) -> np.ndarray:
    """Rescaled-range exponent of each row of (windows, rows); 0.5 where fewer than two segment sizes tell."""
    m, n = x.shape
    logs = np.full((2, m, 3), np.nan)
    for i, size in enumerate((n // 8, n // 4, n // 2)):
        if size < 2:
            continue
        parts = x[:, : n // size * size].reshape(m, -1, size)
        walk = np.cumsum(parts - parts.mean(axis=2, keepdims=True), axis=2)
        spread, sd = walk.max(axis=2) - walk.min(axis=2), parts.std(axis=2)
        good = sd > 1e-12
        ratio = np.where(good, spread, 0.0) / np.where(good, sd, 1.0)
        mean = ratio.sum(axis=1) / np.maximum(good.sum(axis=1), 1)
        told = mean > 0
        logs[0, :, i] = np.where(told, math.log(size), np.nan)
        logs[1, told, i] = np.log(mean[told])
    n_told = (~np.isnan(logs[1])).sum(axis=1)
    two = n_told >= 2
    out = np.full(m, 0.5)
    if two.any():
        a, b = logs[0, two], logs[1, two]
        da, db = a - np.nanmean(a, axis=1, keepdims=True), b - np.nanmean(b, axis=1, keepdims=True)
        out[two] = np.clip(np.nansum(da * db, axis=1) / np.nansum(da * da, axis=1), 0.0, 1.0)
    return out


def deflated_sharpe_of(r: np.ndarray, trials: int) -> float:
    """Deflated Sharpe ratio of one series with its own skew and kurtosis; NaN where it is undefined."""
    n, sd = len(r), r.std(ddof=1) if len(r) > 1 else 0.0
    if n < 5:
        return math.nan
    sr, m2 = (r.mean() / sd if sd > 1e-12 else 0.0), r.var()
    skew, excess = (((r - r.mean()) ** 3).mean() / m2**1.5, ((r - r.mean()) ** 4).mean() / m2**2 - 3.0) if m2 > 0 else (0.0, 0.0)
    variance = (1.0 - skew * sr + (excess + 2.0) / 4.0 * sr * sr) / (n - 1)
    if variance <= 0:
        return 0.0
    nd = NormalDist()
    best = (1 - EULER_GAMMA) * nd.inv_cdf(1 - 1 / trials) + EULER_GAMMA * nd.inv_cdf(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    return nd.cdf(sr / math.sqrt(variance) - best)


def passes_gates(r: np.ndarray, rng: np.random.Generator, trials: int, block: float, boot: int) -> bool:
    """Deflation, sign and a two-sided 95 % bootstrap interval of the Sharpe ratio that excludes zero."""
    if not deflated_sharpe_of(r, trials) > 0.95 or not r.mean() > 0 or len(r) < block + 1:
        return False
    low, high = np.quantile(sharpe_of_samples(r[stationary_indices(rng, len(r), block, boot)]), (0.025, 0.975))
    return bool(low > 0 or high < 0)


def power_curve(spark, series: np.ndarray, sharpes: list[float], block: float, trials: int, periods: float = 252.0, paths: int = 300, boot: int = 300, seed: int = 3, batch: int = 25) -> DataFrame:
    """(sharpe, power): share of paths with a given true annual Sharpe ratio that are detected.

    A path is two windows, each a stationary bootstrap of the demeaned series with the drift added; it is
    detected if both pass all gates.  The series travels with the task; paths are rows over the cluster,
    each with a seed of its own, so the result does not depend on the partitioning.
    """
    data = np.asarray(series, dtype=float)
    noise = data - data.mean() if len(data) else data
    sd = noise.std(ddof=1) if len(noise) > 1 else 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hits = []
            for target, path in zip(frame["sharpe"], frame["path"], strict=True):
                rng = np.random.default_rng([seed, int(target * 1000), int(path)])
                windows = noise[stationary_indices(rng, len(noise), block, 2)] + target / math.sqrt(periods) * sd if len(noise) > 1 else ()
                hits.append(bool(len(windows)) and all(passes_gates(w, rng, trials, block, boot) for w in windows))
            yield pd.DataFrame({"sharpe": frame["sharpe"], "hit": hits})

    tasks = max(1, min(len(sharpes) * -(-paths // batch), 2 * spark.sparkContext.defaultParallelism))
    grid = spark.range(0, len(sharpes) * paths, 1, tasks).select(
        F.element_at(F.array(*[F.lit(float(s)) for s in sharpes]), (F.col("id") % len(sharpes) + 1).cast("int")).alias("sharpe"), F.expr(f"id div {len(sharpes)}").alias("path")
    )
    return grid.mapInPandas(run, "sharpe double, hit boolean").groupBy("sharpe").agg(F.avg(F.col("hit").cast("double")).alias("power"))
