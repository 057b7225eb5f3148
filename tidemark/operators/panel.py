"""Panel operators over long tables (ticker, date, ...): time series and cross-section.

All time-series operators share one window, partitioned by ticker and ordered by
date, so Catalyst plans one exchange and one sort for a whole set of features;
all cross-section operators share the partitioning by date.  Rolling operators
return null until their window is full (min_periods), as named.
"""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ts() -> WindowSpec:
    """A ticker's rows in order of date."""
    return Window.partitionBy("ticker").orderBy("date")


def cs() -> WindowSpec:
    """All tickers of a date."""
    return Window.partitionBy("date")


def _over(make):
    """Fills a missing window argument `w` (specs need a session, so they cannot be defaults)."""

    def wrap(f):
        signature = inspect.signature(f)

        @functools.wraps(f)
        def call(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            if bound.arguments["w"] is None:
                bound.arguments["w"] = make()
            return f(*bound.args, **bound.kwargs)

        return call

    return wrap


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@_over(ts)
def lag(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(_c(x), n).over(w) if n >= 0 else F.lead(_c(x), -n).over(w)


@_over(ts)
def simple_return(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    """x / x[n rows ago] - 1, null where the base is not positive."""
    base = lag(x, n, w)
    return F.when(base > 0, _c(x) / base - 1.0)


@_over(ts)
def log_return(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    base = lag(x, n, w)
    return F.when((base > 0) & (_c(x) > 0), F.log(_c(x) / base))


@_over(ts)
def rolling(agg, x, rows: int, min_periods: int | None = None, shift: int = 0, w: WindowSpec | None = None) -> Column:
    """agg(x) over the `rows` rows ending `shift` rows ago, null with fewer than min_periods values."""
    frame = w.rowsBetween(-(rows - 1) - shift, -shift)
    x = _c(x)
    return F.when(F.count(x).over(frame) >= (rows if min_periods is None else min_periods), agg(x).over(frame))


@_over(ts)
def exclusive(agg, x, rows: int, min_periods: int | None = None, w: WindowSpec | None = None) -> Column:
    """rolling() over the rows before the current one."""
    return rolling(agg, x, rows, min_periods, 1, w)


@_over(ts)
def rolling_pair(agg, x, y, rows: int, shift: int = 0, w: WindowSpec | None = None) -> Column:
    """agg(x, y) over full windows of rows where both are there."""
    frame = w.rowsBetween(-(rows - 1) - shift, -shift)
    both = F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), 1)).over(frame)
    return F.when(both >= rows, agg(_c(x), _c(y)).over(frame))


@_over(ts)
def rolling_median(x, rows: int, shift: int = 0, w: WindowSpec | None = None) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(0.5)), x, rows, None, shift, w)


@_over(ts)
def zscore_window(x, rows: int, w: WindowSpec | None = None) -> Column:
    """z-score against the window of rows + 1 values ending here."""
    frame = w.rowsBetween(-rows, 0)
    x = _c(x)
    return F.when(F.count(x).over(frame) == rows + 1, (x - F.avg(x).over(frame)) / F.nullif(F.stddev_samp(x).over(frame), F.lit(0.0)))


@_over(ts)
def rsi(x, rows: int = 14, w: WindowSpec | None = None) -> Column:
    """Relative strength by simple averages: 100 without losses, 50 without any moves."""
    step = _c(x) - lag(x, 1, w)
    return rsi_of_steps(step, rows, w)


@_over(ts)
def rsi_of_steps(step, rows: int = 14, w: WindowSpec | None = None) -> Column:
    step = _c(step)
    gain = rolling(F.avg, F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), rows, None, 0, w)
    loss = rolling(F.avg, F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))), rows, None, 0, w)
    return F.when(loss > 0, 100.0 - 100.0 / (1.0 + gain / loss)).when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0))


@_over(ts)
def forward_return(x, n: int, w: WindowSpec | None = None) -> Column:
    """x[n rows ahead] / x - 1."""
    return F.when(_c(x) > 0, F.lead(_c(x), n).over(w) / _c(x) - 1.0)


@_over(ts)
def forward_mean(x, rows: int, w: WindowSpec | None = None) -> Column:
    """Mean of the next `rows` values, the current one included."""
    frame = w.rowsBetween(0, rows - 1)
    return F.when(F.count(_c(x)).over(frame) == rows, F.avg(_c(x)).over(frame))


@_over(ts)
def ffill(x, limit: int | None = None, w: WindowSpec | None = None) -> Column:
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(_c(x), ignorenulls=True).over(w.rowsBetween(start, 0))


@_over(ts)
def cumulative_max(x, w: WindowSpec | None = None) -> Column:
    return F.max(_c(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


@_over(ts)
def nav(ret, w: WindowSpec | None = None) -> Column:
    """Product of 1 + ret up to here; missing returns count as 0."""
    return F.product(1.0 + F.coalesce(_c(ret), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


@_over(ts)
def drawdown(level, w: WindowSpec | None = None) -> Column:
    """Loss from the running peak, as a positive share."""
    return 1.0 - _c(level) / cumulative_max(level, w)


# --- cross-section ---


@_over(cs)
def cs_zscore(x, w: WindowSpec | None = None) -> Column:
    """(x - mean) / sample deviation over the date; null where nothing deviates."""
    x = _c(x)
    return (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))


def average_rank(x, by: list[str]) -> Column:
    """Rank from 1 with ties sharing their mean rank; nulls have none."""
    x = _c(x)
    low = F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), low + (ties - 1) / 2.0)


def rank_pct(x, by: list[str]) -> Column:
    return average_rank(x, by) / F.count(_c(x)).over(Window.partitionBy(*by))


def group_demean(x, by: list[str], least: int = 2) -> Column:
    """x less its group's mean; null in groups of fewer than `least` values."""
    w = Window.partitionBy(*by)
    return F.when(F.count(_c(x)).over(w) >= least, _c(x) - F.avg(_c(x)).over(w))


def winsorise(x, by: list[str], low: float = 0.01, high: float = 0.99, least: int = 10) -> Column:
    """x cut at its group's quantiles; untouched in groups of fewer than `least` values."""
    x, w = _c(x), Window.partitionBy(*by)
    cut = F.greatest(F.least(x, F.percentile(x, F.lit(high)).over(w)), F.percentile(x, F.lit(low)).over(w))
    return F.when(F.count(x).over(w) >= least, F.when(x.isNotNull(), cut)).otherwise(x)


def bucket_size(rule: str, n: Column, value: float) -> Column:
    """Names in a basket by one of the conventions in use.

    floor: floor(n / value); least_one: that, at least 1; share: max(1, floor(n * value));
    rounded: max(1, round(n * value) to even); percent: max(1, floor(n * value / 100)).
    """
    one = F.lit(1).cast("bigint")
    if rule == "floor":
        return F.floor(n / F.lit(value))
    if rule == "least_one":
        return F.greatest(one, F.floor(n / F.lit(value)))
    if rule == "share":
        return F.greatest(one, F.floor(n * F.lit(value)))
    if rule == "rounded":
        return F.greatest(one, F.bround(n * F.lit(value), 0).cast("bigint"))
    return F.greatest(one, F.floor(n * F.lit(value) / 100.0))


def baskets(df: DataFrame, score: str, by: list[str], rule: str, value: float, least: int = 1, name: str = "side") -> DataFrame:
    """Adds 1 for the top basket, -1 for the bottom one, 0 between; null where fewer than `least` names score.

    Ties are broken by ticker, so the result does not depend on row order.
    """
    scored = df.where(F.col(score).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).asc(), F.col("ticker").asc()))
    k = bucket_size(rule, F.col("_n"), value)
    ranked = scored.withColumn("_n", n).withColumn("_up", up).withColumn("_k", k)
    side = F.when(F.col("_n") < least, None).when(F.col("_up") > F.col("_n") - F.col("_k"), 1).when(F.col("_up") <= F.col("_k"), -1).otherwise(0)
    return ranked.withColumn(name, side).drop("_n", "_up", "_k")


def information_coefficient(df: DataFrame, score: str, forward: str, by: list[str], least: int = 10, spearman: bool = True) -> DataFrame:
    """Per date the correlation of score and forward return over names that have both."""
    both = df.where(F.col(score).isNotNull() & F.col(forward).isNotNull())
    a, b = (average_rank(score, by), average_rank(forward, by)) if spearman else (F.col(score), F.col(forward))
    ranked = both.select(*by, a.alias("_a"), b.alias("_b"))
    return ranked.groupBy(*by).agg(F.corr("_a", "_b").alias("ic"), F.count(F.lit(1)).alias("n_names")).where(F.col("n_names") >= least)


def ic_summary(ic: DataFrame, by: list[str]) -> DataFrame:
    """Mean, t, ratio and hit rate of information coefficients."""
    good = ic.where(F.col("ic").isNotNull() & ~F.isnan("ic"))
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    hit = (F.col("ic") > 1e-12).cast("double")  # zero but for rounding is no hit
    return good.groupBy(*by).agg(
        n.alias("n_dates"), m.alias("mean_ic"), (m / F.nullif(s, F.lit(0.0))).alias("ic_ratio"),
        (m / F.nullif(s, F.lit(0.0)) * F.sqrt(n)).alias("t_stat"), F.avg(hit).alias("hit_rate"),
    )


# --- price and volume features ---


@_over(ts)
def amihud(ret, close, volume, rows: int = 20, least: int = 10, floor: float = 1e-6, w: WindowSpec | None = None) -> Column:
    """Mean of |return| per traded value, times a million."""
    dollar = F.greatest(_c(close) * _c(volume), F.lit(floor))
    return rolling(F.avg, F.abs(_c(ret)) / dollar, rows, least, 0, w) * 1e6


@_over(ts)
def corwin_schultz(df: DataFrame, rows: int = 21, w: WindowSpec | None = None) -> DataFrame:
    """Adds `spread`: mean of the two-day high-low spread estimates, negative ones as 0."""
    h, l = F.col("high"), F.col("low")  # noqa: E741
    k = 3.0 - 2.0 * 2.0**0.5
    df = df.withColumns({"_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w)})
    square = F.pow(F.log(h / l), 2.0)
    beta = square + F.pow(F.log(F.col("_ph") / F.col("_pl")), 2.0)
    gamma = F.pow(F.log(F.greatest(h, F.col("_ph")) / F.least(l, F.col("_pl"))), 2.0)
    alpha = (F.sqrt(2.0 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    two_day = F.when(F.col("_ph").isNotNull(), F.greatest(2.0 * (F.exp(alpha) - 1.0) / (1.0 + F.exp(alpha)), F.lit(0.0)))
    return df.withColumn("_s", two_day).withColumn("spread", rolling(F.avg, "_s", rows, None, 0, w)).drop("_ph", "_pl", "_s")


@_over(ts)
def lag_autocorrelation(x, rows: int, k: int = 1, w: WindowSpec | None = None) -> Column:
    """Correlation of x with its value k rows before, over the `rows` rows before this one."""
    # nested windows are not allowed, so callers lag first where k rows back is a column already
    return rolling_pair(F.corr, x, f"_lag{k}", rows - k, 1, w)


def islands(df: DataFrame, by: list[str], order: str, flag: Column, name: str = "run") -> DataFrame:
    """Numbers runs of consecutive rows with the same flag."""
    w = Window.partitionBy(*by).orderBy(order)
    turned = F.when(F.lag(flag).over(w).eqNullSafe(flag), 0).otherwise(1)
    return df.withColumn("_turn", turned).withColumn(name, F.sum("_turn").over(w)).drop("_turn")
