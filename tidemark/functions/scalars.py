"""Scalar functions as Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float


def lit(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    v = x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def safe_divide(a: Num, b: Num, fallback: float = 0.0) -> Column:
    """a / b, the fallback where b is null, NaN or 0, or the result is not finite."""
    a, b = lit(a), lit(b)
    return F.when(b.isNull() | F.isnan(b.cast("double")) | (b == 0), F.lit(fallback)).otherwise(F.coalesce(finite(a / F.nullif(b, F.lit(0.0))), F.lit(fallback)))


def clamp(x: Num, low: float, high: float) -> Column:
    """x kept within [low, high]; null stays null."""
    x = lit(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner's rule, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# The normal quantile's rational approximations (Acklam), relative error below 1.2e-9.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_LOW = 0.02425

# The normal distribution's tail as a ratio of polynomials (Hart 5666), absolute error below 1e-14.
CDF_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Num) -> Column:
    """Distribution function of the standard normal (Spark has no erf)."""
    x = lit(x)
    z = F.abs(x)
    bell = F.exp(-z * z / 2.0)
    near = bell * _poly(z, CDF_TOP) / _poly(z, CDF_BOTTOM)
    chain = z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))
    far = bell / (chain * math.sqrt(2 * math.pi))
    tail = F.when(z > 37.0, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x.isNotNull(), F.when(x > 0, 1.0 - tail).otherwise(tail))


def normal_pdf(x: Num) -> Column:
    x = lit(x)
    return F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi)


def normal_quantile(p: Num) -> Column:
    """Inverse of normal_cdf; null outside (0, 1)."""
    p = lit(p)
    q = F.sqrt(-2.0 * F.log(F.when(p < 0.5, p).otherwise(1.0 - p)))
    side = _poly(q, QUANTILE_C) / (_poly(q, QUANTILE_D) * q + 1.0)
    c = p - 0.5
    r = c * c
    middle = _poly(r, QUANTILE_A) * c / (_poly(r, QUANTILE_B) * r + 1.0)
    inside = (p > 0) & (p < 1)
    return F.when(inside, F.when(p < QUANTILE_LOW, side).when(p > 1 - QUANTILE_LOW, -side).otherwise(middle))


# --- options ---


def d1(spot: Num, strike: Num, sigma: Num, years: Num, rate: Num) -> Column:
    s, k, v, t, r = map(lit, (spot, strike, sigma, years, rate))
    return (F.log(s / k) + (r + v * v / 2.0) * t) / (v * F.sqrt(t))


def bs_price(spot: Num, strike: Num, sigma: Num, years: Num, rate: Num, call: bool) -> Column:
    """Black-Scholes price; the payoff where no time or volatility is left."""
    s, k, v, t, r = map(lit, (spot, strike, sigma, years, rate))
    a = d1(s, k, v, t, r)
    b = a - v * F.sqrt(t)
    disc = k * F.exp(-r * t)
    live = s * normal_cdf(a) - disc * normal_cdf(b) if call else disc * normal_cdf(-b) - s * normal_cdf(-a)
    return F.when((t <= 0) | (v <= 0), F.greatest(s - k if call else k - s, F.lit(0.0))).otherwise(live)


def bs_delta(spot: Num, strike: Num, sigma: Num, years: Num, rate: Num, call: bool) -> Column:
    n = normal_cdf(d1(spot, strike, sigma, years, rate))
    return n if call else n - 1.0


def strike_for_delta(spot: Num, delta: Num, sigma: Num, years: Num, rate: Num, call: bool) -> Column:
    """Strike at which an option has the given delta, in closed form."""
    s, d, v, t, r = map(lit, (spot, delta, sigma, years, rate))
    z = normal_quantile(d if call else d + 1.0)
    return s * F.exp(-z * v * F.sqrt(t) + (r + v * v / 2.0) * t)


def condor_payoff(spot: Num, long_put: Num, short_put: Num, short_call: Num, long_call: Num) -> Column:
    """What an iron condor pays at expiry (never above 0 for its seller)."""
    s, a, b, c, d = map(lit, (spot, long_put, short_put, short_call, long_call))

    def pos(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0))

    return pos(a - s) - pos(b - s) - pos(s - c) + pos(s - d)


# --- costs, sizes, rates ---


def impact_bps(notional: Num, adv: Num, k: float = 10.0, low: float = 0.5, high: float = 500.0) -> Column:
    """Square-root market impact in basis points, kept within [low, high]."""
    share = lit(notional) / F.nullif(lit(adv), F.lit(0.0))
    return F.coalesce(clamp(k * F.sqrt(F.greatest(share, F.lit(0.0))), low, high), F.lit(high))


def borrow_cost(notional: Num, annual_bps: Num, days: Num, year: float = 365.0) -> Column:
    return lit(notional) * lit(annual_bps) / 1e4 * lit(days) / year


def contract_fee(rate: Num, contracts: Num, price: Num) -> Column:
    """Fee on a binary contract, rounded up to the cent."""
    c, p = lit(contracts), lit(price)
    return F.ceil(100.0 * lit(rate) * c * p * (1.0 - p) - 1e-9) / 100.0


def settlement_pnl(side: Column, price: Num, outcome: Column, contracts: Num, fee: Num) -> Column:
    """Profit of a binary contract bought at `price` on the yes or no side."""
    won = F.when(side == "yes", outcome == 1).otherwise(outcome == 0)
    return lit(contracts) * (F.when(won, 1.0).otherwise(0.0) - lit(price)) - lit(fee)


def inverse_vol_size(target: float, vol: Num, cap: float = 1.0) -> Column:
    return F.least(F.lit(target) / F.nullif(lit(vol), F.lit(0.0)), F.lit(cap))


def daily_rate(annual: Num, days: int = 252) -> Column:
    """The rate that compounds to `annual` over a year."""
    return F.pow(1.0 + lit(annual), F.lit(1.0 / days)) - 1.0


def mde_sample(p0: Num, edge: Num, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Trials needed to tell p0 + edge from p0 (two-sided test of a share)."""
    a, b = normal_quantile(F.lit(1 - alpha / 2)), normal_quantile(F.lit(power))
    p, q = lit(p0), lit(p0) + lit(edge)
    return F.ceil(F.pow((a * F.sqrt(p * (1 - p)) + b * F.sqrt(q * (1 - q))) / lit(edge), 2.0))


# --- dates ---


def last_thursday(day: Column) -> Column:
    """Last Thursday of the day's month."""
    end = F.last_day(day)
    return F.date_sub(end, F.pmod(F.dayofweek(end) - 5, F.lit(7)).cast("int"))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end] as an array."""
    return F.filter(F.sequence(start, end), lambda d: ~F.dayofweek(d).isin(1, 7))


def formation_year(day: Column) -> Column:
    """Year of the June whose characteristics hold from July on."""
    return F.when(F.month(day) >= 7, F.year(day)).otherwise(F.year(day) - 1)


# --- text, hashes ---


def normalise_ticker(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(x)), r"\.", "-")


def valid_ticker(x: Column) -> Column:
    return x.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$")


def pad_cik(x: Column) -> Column:
    """Central index key as ten digits, null if it is no number."""
    digits = F.regexp_replace(F.trim(x), "^0+(?=[0-9])", "")
    return F.when(digits.rlike("^[0-9]{1,10}$"), F.lpad(digits, 10, "0"))


def strip_suffix(name: Column) -> Column:
    """Company name without legal form and punctuation, upper case."""
    bare = F.regexp_replace(F.upper(F.trim(name)), r"[.,&'()]", " ")
    bare = F.regexp_replace(bare, r"\b(LIMITED|LTD|INC|CORP|CORPORATION|CO|PLC|GROUP|HOLDINGS|COMPANY)\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def event_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)


def calibration_logloss(p: Column, y: Column, floor: float = 1e-12) -> Column:
    q = clamp(p, floor, 1 - floor)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))
