"""Backtests: window SQL where the weights do not depend on the past's profit, grouped pandas where they do.

Path-dependent simulations run one task per strategy, pair or trial; their input
is that strategy's own panel, which is bounded by names times dates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel as P


def rebalance_weights(scored: DataFrame, every: int, rule: str = "floor", value: float = 5.0, least: int = 10) -> DataFrame:
    """(date, ticker, weight) on every `every`-th date: +1/k for the top basket, -1/k for the bottom one.

    Dates are few; their numbering is the only global order taken.
    """
    dates = scored.where("score is not null").select("date").distinct()
    numbered = dates.withColumn("_k", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("_k") % every == 0).drop("_k")
    chosen = P.baskets(scored.join(numbered, "date", "left_semi"), "score", ["date"], rule, value, least).where("side <> 0")
    n = F.count(F.lit(1)).over(Window.partitionBy("date", "side"))
    return chosen.select("date", "ticker", (F.col("side") / n).alias("weight"))


def hold_weights(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """panel with the weight held on each row: that of the last rebalance at or before it, 0 for names not in it."""
    marks = weights.select(F.col("date").alias("_rebal")).distinct()
    dates = panel.select("date").distinct()
    both = dates.join(marks, F.col("date") == F.col("_rebal"), "left")
    last = both.select("date", F.last("_rebal", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("_at"))
    held = weights.select(F.col("date").alias("_at"), "ticker", "weight")
    return panel.join(last, "date").join(held, ["_at", "ticker"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_at")


def weighted_returns(held: DataFrame, cost_bps: float = 10.0, impact: float = 0.0) -> DataFrame:
    """(date, gross, turnover, net): yesterday's weight times today's return, less cost on what was traded.

    Costs are linear in turnover plus `impact` times its square.
    """
    rows = held.withColumn("_w1", F.lag("weight").over(P.ts())).withColumn("_ret", P.simple_return("close"))
    move = F.abs(F.col("weight") - F.coalesce("_w1", F.lit(0.0)))
    daily = rows.groupBy("date").agg(F.sum(F.coalesce(F.col("_w1") * F.col("_ret"), F.lit(0.0))).alias("gross"), F.sum(move).alias("turnover"))
    cost = F.col("turnover") * cost_bps / 1e4 + impact * F.col("turnover") * F.col("turnover")
    return daily.withColumn("net", F.col("gross") - cost)


def quintile_backtest(scored: DataFrame, every: int = 4, cost_bps: float = 10.0, impact: float = 0.0) -> DataFrame:
    """Long-short quintiles of a scored panel (ticker, date, close, score)."""
    return weighted_returns(hold_weights(scored, rebalance_weights(scored, every)), cost_bps, impact)


def time_series_momentum(bars: DataFrame, look: int = 52, vol_rows: int = 13, target: float = 0.1, periods: float = 52.0, cap: float = 2.0) -> DataFrame:
    """bars with the weight sign(past return) * min(target / volatility, 1), gross exposure of a date at most `cap`."""
    b = bars.withColumn("_r", P.log_return("close"))
    vol = P.rolling(F.stddev_samp, "_r", vol_rows) * periods**0.5
    raw = F.signum(P.simple_return("close", look)) * F.least(target / F.nullif(vol, F.lit(0.0)), F.lit(1.0))
    b = b.withColumn("_raw", F.coalesce(raw, F.lit(0.0)))
    names = F.nullif(F.sum(F.when(F.col("_raw") != 0, 1).otherwise(0)).over(P.cs()), F.lit(0))
    b = b.withColumn("_w", F.coalesce(F.col("_raw") / names, F.lit(0.0)))
    gross = F.sum(F.abs("_w")).over(P.cs())
    return b.withColumn("weight", F.col("_w") * F.least(F.lit(cap) / F.nullif(gross, F.lit(0.0)), F.lit(1.0))).withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_r", "_raw", "_w")


def funding_signal(df: DataFrame, look: int = 3) -> DataFrame:
    """Cross-sectional z-score of the median of the `look` fundings before the event (the event itself excluded)."""
    w = Window.partitionBy("symbol").orderBy("funding_time")
    frame = w.rowsBetween(-look, -1)
    median = F.when(F.count("funding_rate").over(frame) == look, F.percentile("funding_rate", F.lit(0.5)).over(frame))
    return df.withColumn("signal", median).withColumn("score", P.cs_zscore("signal", Window.partitionBy("funding_time")))


def funding_baskets(df: DataFrame, every: int = 3, names: int = 3, least: int = 8, round_trip_bps: float = 12.0) -> DataFrame:
    """(funding_time, pnl_bps, n): short the highest scores, long the lowest, between rebalances the old baskets stay.

    A short collects funding, a long pays it and its borrow; half of each leg, cost on rebalance.
    """
    events = df.select("funding_time").distinct().withColumn("_k", F.row_number().over(Window.orderBy("funding_time")) - 1)
    scored = df.join(events, "funding_time")
    by = Window.partitionBy("funding_time")
    ranked = scored.where("score is not null").withColumns(
        {
            "_n": F.count(F.lit(1)).over(by),
            "_up": F.row_number().over(by.orderBy("score", "symbol")),
            "_down": F.row_number().over(by.orderBy(F.desc("score"), "symbol")),
        }
    )
    side = F.when(F.col("_down") <= names, -1).when(F.col("_up") <= names, 1)
    picks = ranked.where((F.col("_k") % every == 0) & (F.col("_k") >= every) & (F.col("_n") >= least)).withColumn("side", side).where("side is not null")
    picks = picks.select(F.col("_k").alias("_at"), "symbol", "side")
    marks = picks.select("_at").distinct()
    last = events.join(marks, F.col("_k") == F.col("_at"), "left").select(
        "funding_time", "_k", F.last("_at", ignorenulls=True).over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)).alias("_at")
    )
    held = last.where("_at is not null").join(picks, "_at").join(df.select("funding_time", "symbol", "funding_rate"), ["funding_time", "symbol"], "left")
    leg = F.when(F.col("side") == -1, F.col("funding_rate") * 1e4).otherwise(-F.col("funding_rate") * 1e4 - 30.0 * 8.0 / 8766.0)
    per = held.groupBy("funding_time", "_k", "_at").agg(
        F.coalesce(F.avg(F.when(F.col("side") == 1, leg)), F.lit(0.0)).alias("_long"), F.coalesce(F.avg(F.when(F.col("side") == -1, leg)), F.lit(0.0)).alias("_short"), F.count("funding_rate").alias("n")
    )
    cost = F.when(F.col("_k") == F.col("_at"), round_trip_bps * 0.5).otherwise(0.0)
    return per.select("funding_time", (0.5 * F.col("_long") + 0.5 * F.col("_short") - cost).alias("pnl_bps"), "n")


# --- path-dependent simulations ---


@dataclass(frozen=True)
class Execution:
    """Costs and limits of simulated fills."""

    slippage_bps: float = 5.0
    commission_bps: float = 1.0
    min_notional: float = 100.0
    capital: float = 1_000_000.0


def event_driven(panel: DataFrame, execution: Execution = Execution()) -> DataFrame:
    """Marks and fills of target weights, one task per strategy.

    panel: (strategy, date, ticker, open, close, target), target null where nothing is to be
    changed.  A decision is made at a date's close on that date's NAV and filled at the ticker's next open, so
    no fill is at or before its decision.  Returns (strategy, date, nav, cash, n_fills, cost).
    """
    e = execution

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        days, at = np.unique(pdf["date"].to_numpy(), return_inverse=True)
        names, of = np.unique(pdf["ticker"].to_numpy(dtype=str), return_inverse=True)
        grid = np.full((3, len(days), len(names)), np.nan)
        for i, c in enumerate(("open", "close", "target")):
            grid[i, at, of] = pdf[c].to_numpy(float)
        held, price, orders = np.zeros(len(names)), np.zeros(len(names)), np.full(len(names), np.nan)
        cash, out = e.capital, []
        for opened, closed, target in grid.transpose(1, 0, 2):
            due = ~np.isnan(orders) & (opened > 0)
            shares = np.where(due, orders, 0.0)
            orders[due] = np.nan
            shares[np.abs(shares) * np.where(due, opened, 0.0) < e.min_notional] = 0.0
            fills = shares != 0
            q, o = shares[fills], opened[fills]
            paid = o * (1 + np.sign(q) * e.slippage_bps / 1e4)
            fee = np.abs(q) * paid * e.commission_bps / 1e4
            cash -= float((q * paid + fee).sum())
            held[fills] += q
            price = np.where(closed > 0, closed, price)
            nav = cash + float(held @ price)
            fresh = ~np.isnan(target) & (closed > 0)
            orders[fresh] = target[fresh] * nav / closed[fresh] - held[fresh]
            out.append((nav, cash, int(fills.sum()), float((fee + np.abs(q) * np.abs(paid - o)).sum())))
        return pd.DataFrame(out, columns=["nav", "cash", "n_fills", "cost"]).assign(strategy=pdf["strategy"].iloc[0], date=days)[["strategy", "date", "nav", "cash", "n_fills", "cost"]]

    return panel.groupBy("strategy").applyInPandas(run, "strategy string, date date, nav double, cash double, n_fills bigint, cost double")


def pairs_trading(pairs: DataFrame, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0, window: int = 26, refit: int = 13) -> DataFrame:
    """State machine of each pair (pair, date, y, x): hedge ratio refitted every `refit` rows on the `window` before.

    Enters against the spread beyond `enter`, leaves within `leave`, stops beyond `stop`.
    Returns (pair, date, z, position, pnl); the position of a row earns from the next one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        y, x = np.log(pdf["y"].to_numpy(float)), np.log(pdf["x"].to_numpy(float))
        z, position, pnl = np.full(len(y), np.nan), np.zeros(len(y), int), np.zeros(len(y))
        beta = alpha = mean = sd = 0.0
        for t in range(len(y)):
            if t >= window and (t - window) % refit == 0:
                a, b = x[t - window : t], y[t - window : t]
                beta = np.cov(a, b)[0, 1] / max(a.var(ddof=1), 1e-12)
                alpha = b.mean() - beta * a.mean()
                spread = b - alpha - beta * a
                mean, sd = spread.mean(), max(spread.std(ddof=1), 1e-12)
            now = position[t - 1] if t else 0
            if t:
                pnl[t] = now * ((y[t] - y[t - 1]) - beta * (x[t] - x[t - 1]))
            if t >= window:
                z[t] = (y[t] - alpha - beta * x[t] - mean) / sd
                if now == 0 and enter <= abs(z[t]) < stop:
                    now = -int(np.sign(z[t]))
                elif now != 0 and (abs(z[t]) <= leave or abs(z[t]) >= stop):
                    now = 0
            position[t] = now
        return pd.DataFrame({"pair": pdf["pair"], "date": pdf["date"], "z": z, "position": position, "pnl": pnl})

    return pairs.groupBy("pair").applyInPandas(run, "pair string, date date, z double, position int, pnl double")


@dataclass(frozen=True)
class EtpRules:
    """Entry and exit rules of the volatility trade."""

    threshold: float = 1.0
    hold: int = 10
    stop: float = 0.1
    cooldown: int = 5
    cost_bps: float = 15.0
    target_vol: float = 20.0


def volatility_trades(panel: DataFrame, rules: EtpRules = EtpRules(), capital: float = 100_000.0) -> DataFrame:
    """Stateful single-instrument trade per (trial): panel (trial, date, open, close, vol, signal).

    Order of a day: pending entry or exit at the open (sized by yesterday's volatility), mark at the
    close, then hard stop, time exit, signal exit, else entry for the next day.
    """
    r = rules

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        cash, shares, entry, age, wait, pending, out = capital, 0.0, 0.0, 0, 0, "", []
        before = np.nan
        for row in pdf.itertuples():
            event = ""
            if pending == "enter" and row.open > 0:
                notional = cash * min(r.target_vol / before, 1.0) if before > 0 else 0.0
                cost = notional * r.cost_bps / 1e4
                if notional > 0 and notional + cost <= cash:
                    shares, entry, age, event = notional / row.open, row.open, 0, "enter"
                    cash -= notional + cost
            elif pending == "exit" and shares and row.open > 0:
                cash += shares * row.open * (1 - r.cost_bps / 1e4)
                shares, event = 0.0, "exit"
            pending = ""
            value = cash + shares * row.close
            wait = max(0, wait - 1)
            if shares:
                age += 1
                if row.close <= entry * (1 - r.stop):
                    pending, wait = "exit", r.cooldown
                elif age >= r.hold or not row.signal > r.threshold:
                    pending = "exit"
            elif wait == 0 and row.signal > r.threshold:
                pending = "enter"
            before = row.vol
            out.append((row.trial, row.date, value, int(shares > 0), event))
        return pd.DataFrame(out, columns=["trial", "date", "nav", "in_trade", "event"])

    return panel.groupBy("trial").applyInPandas(run, "trial string, date date, nav double, in_trade int, event string")


def capacity(returns: DataFrame, aums: list[float], adv: float, k: float = 0.1) -> DataFrame:
    """(aum, final_nav, mean_cost_bps): impact grows with the fund's own size.

    returns: (date, gross, turnover), one row a date; each starting size folds over the ordered array.
    """
    path = returns.agg(F.array_sort(F.collect_list(F.struct("date", "gross", "turnover"))).alias("path"))
    grid = path.select("path", F.explode(F.array(*[F.lit(float(a)) for a in aums])).alias("aum"))

    def step(acc, x):
        cost = F.when(x["turnover"] > 0, x["turnover"] * k * F.sqrt(F.greatest(acc["nav"] * x["turnover"], F.lit(0.0)) / adv)).otherwise(0.0)
        return F.struct((acc["nav"] * (1 + x["gross"] - F.least(cost, F.lit(0.5)))).alias("nav"), (acc["cost"] + cost).alias("cost"))

    folded = F.aggregate("path", F.struct(F.col("aum").alias("nav"), F.lit(0.0).alias("cost")), step)
    out = grid.select("aum", F.size("path").alias("n"), folded.alias("f"))
    return out.select("aum", F.col("f.nav").alias("final_nav"), (1e4 * F.col("f.cost") / F.nullif("n", F.lit(0))).alias("mean_cost_bps"))


def loss_streaks(df: DataFrame, by: str, order: str, ret: str) -> DataFrame:
    """df with `streak`: consecutive losses up to and including the row (missing returns end none and add none)."""
    w = Window.partitionBy(by).orderBy(order)
    known = df.where(F.col(ret).isNotNull())
    gains = F.sum(F.when(F.col(ret) >= 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = known.withColumn("_g", gains)
    return runs.withColumn("streak", F.sum(F.when(F.col(ret) < 0, 1).otherwise(0)).over(Window.partitionBy(by, "_g").orderBy(order))).drop("_g")
