"""Gates as rows, resampled edges, stress periods, labels, calendars, reports, quality and limits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import stats as ST
from tidemark.operators import backtest as BT
from tidemark.operators import panel as P
from tidemark.plans import research as R
from tidemark.plans.base import B, bars, bars_sql, lag_sql, over, r6, r6_sql, ret_sql, roll_sql
from tidemark.plans.desk import _STRESS, _STRESS_SQL
from tidemark.plans.panel import ORACLE as _PANEL
from tidemark.plans.panel import _LR, gap_runs
from tidemark.plans.relational import cdf_sql
from tidemark.session import _written, shared_folder, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


# --- gates: one row a trial and gate ---

#: A caller's list of gates: (name, value column, threshold, whether the value must lie above it).
GATES = (("dsr", "dsr", 0.95, True), ("sign_agreement", "worse_half", 0.0, True), ("cost_survival", "stressed", 0.0, True), ("max_drawdown", "drawdown", 0.3, False), ("cornish_fisher", "cf", 0.5, True))
_COST = 0.002  # doubled costs of a week
_SR = "avg({0}) / nullif(stddev_samp({0}), 0) * sqrt(52)"


def gate_rows(values: DataFrame, by: list[str], gates=GATES) -> DataFrame:
    """(by..., gate, value, threshold, passed) of a caller's gates; a missing value fails its gate."""
    rows = [
        F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.coalesce(F.col(c) > t if above else F.col(c) <= t, F.lit(False)).alias("passed"))
        for g, c, t, above in gates
    ]
    return values.select(*by, F.inline(F.array(*rows)))


_GATED = (
    R._MOM
    + f""", k AS (SELECT ticker, date, ret, row_number() {over()} AS k, count(*) OVER (PARTITION BY ticker) AS n, product(1 + ret) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS nav FROM q),
pk AS (SELECT *, max(nav) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS peak FROM k),
v AS (SELECT ticker, least({_SR.format('CASE WHEN 2 * k <= n THEN ret END')}, {_SR.format('CASE WHEN 2 * k > n THEN ret END')}) AS worse_half, {_SR.format(f'(ret - {_COST})')} AS stressed, max(1 - nav / peak) AS drawdown FROM pk GROUP BY 1),
d AS (SELECT s.ticker, (sr - {R._expected_max_sql('1 / (n - 1) * (1 + 0)')}) / sqrt({R._VAR}) AS z, sr * (1 + skew / 6.0 * sr - excess / 24.0 * sr * sr) AS cf FROM s),
a AS (SELECT ticker, {cdf_sql('z')} AS dsr, cf, worse_half, stressed, drawdown FROM d JOIN v USING (ticker)),
g AS ("""
    + " UNION ALL ".join(f"SELECT ticker, '{g}' AS gate, {c} AS value, CAST({t} AS DOUBLE) AS threshold, coalesce({c} {'>' if above else '<='} {t}, FALSE) AS passed FROM a" for g, c, t, above in GATES)
    + ")"
)


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    r = R._returns(spark, sf)
    m = ST.moments(r, ["ticker"])
    sr, n, k, x = (F.col(c) for c in ("sr", "n", "skew", "excess"))
    m = m.select("ticker", ST.deflated_sharpe(sr, n, k, x, R._TRIALS, 1.0 / (n - 1.0)).alias("dsr"), ST.cornish_fisher_sharpe(sr, k, x).alias("cf"))
    whole = P.ts().rowsBetween(Window.unboundedPreceding, 0)
    p = r.withColumns({"k": F.row_number().over(P.ts()), "n": F.count(F.lit(1)).over(Window.partitionBy("ticker")), "nav": F.product(1 + F.col("ret")).over(whole)}).withColumn("peak", F.max("nav").over(whole))

    def sharpe(c: Column) -> Column:
        return F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * 52**0.5

    first = 2 * F.col("k") <= F.col("n")
    halves = p.groupBy("ticker").agg(
        sharpe(F.when(first, F.col("ret"))).alias("a"), sharpe(F.when(~first, F.col("ret"))).alias("b"), sharpe(F.col("ret") - _COST).alias("stressed"), F.max(1 - F.col("nav") / F.col("peak")).alias("drawdown")
    )
    return gate_rows(m.join(halves.withColumn("worse_half", F.least("a", "b")), "ticker"), ["ticker"])


@_add("gates", _GATED + f" SELECT ticker, gate, {r6_sql('value', 'value')}, threshold, passed FROM g")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    """Deflation, sign of both halves, doubled costs, drawdown and tail-adjusted Sharpe ratio, one row a trial and gate."""
    return _gates(spark, sf).select("ticker", "gate", r6("value"), "threshold", "passed")


@_add("gate_report", _GATED + " SELECT ticker, bool_and(passed) AS deploy_ready, count(CASE WHEN passed THEN 1 END) AS n_passed, count(*) AS n_gates FROM g GROUP BY 1")
def gate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Gates folded per trial."""
    return _gates(spark, sf).groupBy("ticker").agg(F.bool_and("passed").alias("deploy_ready"), F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_gates"))


_REGIONS = (("longshot", 0.0, 0.4, -1.0), ("favourite", 0.6, 1.0, 1.0))
_REGION_SQL = "CASE WHEN p <= 0.4 THEN 'longshot' WHEN p > 0.6 THEN 'favourite' END"


@_add(
    "binary_gates",
    R._BIN
    + f""", e AS (SELECT {_REGION_SQL} AS region, count(*) AS n, avg(y) - avg(p) AS edge, avg(0.07 * p * (1 - p)) AS fee FROM b WHERE p <= 0.4 OR p > 0.6 GROUP BY 1), s AS (SELECT *, CASE WHEN region = 'favourite' THEN edge ELSE -edge END AS along FROM e)
SELECT region, n, 'calibration_gap' AS gate, {r6_sql('along', 'value')}, 0.01 AS threshold, round(along, 9) >= 0.01 AS passed FROM s UNION ALL SELECT region, n, 'net_of_fee', round(abs(edge) - fee, 6) + 0.0, 0.0, abs(edge) - fee > 0 FROM s UNION ALL SELECT region, n, 'net_of_double_fee', round(abs(edge) - 2 * fee, 6) + 0.0, 0.0, abs(edge) - 2 * fee > 0 FROM s""",
)
def binary_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration gap in its direction, and the edge net of one and two fees, of both ends of the forecasts."""
    p = F.col("p")
    region = F.when(p <= 0.4, "longshot").when(p > 0.6, "favourite")
    e = R._binary(spark, sf).where("p <= 0.4 or p > 0.6").groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"), (F.avg("y") - F.avg("p")).alias("edge"), F.avg(0.07 * p * (1 - p)).alias("fee"))
    edge, fee = F.col("edge"), F.col("fee")
    along = F.when(F.col("region") == "favourite", edge).otherwise(-edge)
    rows = [("calibration_gap", along, 0.01, F.round(along, 9) >= 0.01), ("net_of_fee", F.abs(edge) - fee, 0.0, F.abs(edge) - fee > 0), ("net_of_double_fee", F.abs(edge) - 2 * fee, 0.0, F.abs(edge) - 2 * fee > 0)]
    g = F.array(*[F.struct(F.lit(n).alias("gate"), r6(v, "value"), F.lit(t).alias("threshold"), ok.alias("passed")) for n, v, t, ok in rows])
    return e.select("region", "n", F.inline(g))


def edge_bootstrap_rows(spark: SparkSession, counts: DataFrame, reps: int = 4000, seed: int = 5, batch: int = 250) -> DataFrame:
    """(region, n, edge, low, high, excludes_zero) of an iid bootstrap of events.

    counts: (region, p, y, n), events counted by forecast and outcome: drawing n events with
    replacement is one multinomial draw over the distinct values, so no replicate touches the rows.
    """
    held = counts.toPandas().sort_values(["region", "p", "y"])  # one row a distinct forecast and outcome
    parts = {r: (g["n"].to_numpy(np.int64), (g["y"] - g["p"]).to_numpy(float)) for r, g in held.groupby("region")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"]:
                size = min(batch, reps - int(number) * batch)
                for i, (region, (n, gap)) in enumerate(sorted(parts.items())):
                    rng = np.random.default_rng([seed, i, int(number)])
                    yield pd.DataFrame({"region": region, "edge": rng.multinomial(n.sum(), n / n.sum(), size) @ gap / n.sum()})

    batches = -(-reps // batch)
    drawn = spark.range(0, batches, 1, min(batches, spark.sparkContext.defaultParallelism)).mapInPandas(run, "region string, edge double")
    q = drawn.groupBy("region").agg(F.percentile("edge", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = counts.groupBy("region").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * (F.col("y") - F.col("p"))) / F.sum("n")).alias("edge"))
    low, high = F.col("q")[0], F.col("q")[1]
    return point.join(q, "region").select("region", "n", "edge", low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("excludes_zero"))


@_add("edge_bootstrap")
def edge_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap interval of the calibration edge of both ends of the forecasts."""
    region = F.when(F.col("p") <= 0.4, "longshot").when(F.col("p") > 0.6, "favourite")
    counts = R._binary(spark, sf).where("p <= 0.4 or p > 0.6").groupBy(region.alias("region"), F.round("p", 9).alias("p"), "y").agg(F.count(F.lit(1)).alias("n"))
    return edge_bootstrap_rows(spark, counts)


def sharpe_difference(spark: SparkSession, a: np.ndarray, b: np.ndarray, reps: int = 2000, block: float = 10.0) -> DataFrame:
    """(n, difference, low, high, p_value) of a paired stationary bootstrap: both series are drawn at the same dates."""
    pair = np.column_stack([a, b])

    def gap(x: np.ndarray) -> np.ndarray:
        return ST.sharpe_of_samples(x[:, :, 0], 52.0) - ST.sharpe_of_samples(x[:, :, 1], 52.0)

    observed = float(gap(pair[None])[0])
    draws = ST.bootstrap_statistic(spark, pair, gap, reps, block)
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    beyond = F.avg((F.abs(F.col("value") - observed) >= abs(observed)).cast("double")).alias("p_value")
    return draws.agg(F.count(F.lit(1)).alias("n"), q, beyond).select("n", F.lit(observed).alias("difference"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_value")


@_add("paired_bootstrap")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Sharpe difference of the five strongest names and all names, resampled in pairs (one row a week)."""
    m = bars(spark, sf).select("date", "ticker", P.simple_return("close", 4).alias("mom"), P.forward_return("close", 1).alias("fwd")).where("mom is not null and fwd is not null")
    k = m.withColumn("u", F.row_number().over(P.cs().orderBy(F.desc("mom"), "ticker")))
    d = k.groupBy("date").agg(F.avg(F.when(F.col("u") <= 5, F.col("fwd"))).alias("a"), F.avg("fwd").alias("b")).orderBy("date").toPandas()
    return sharpe_difference(spark, d["a"].to_numpy(float), d["b"].to_numpy(float))


@_add(
    "stress_gates",
    R._RET
    + f""", x AS (SELECT st.period, ticker, date, ret FROM q JOIN {_STRESS_SQL} ON date BETWEEN st.a AND st.z), mo AS (SELECT period, ticker, date_trunc('month', date) AS m, sum(ret) AS total FROM x GROUP BY 1, 2, 3),
sh AS (SELECT period, ticker, count(*) AS n, {_SR.format('ret')} AS sharpe FROM x GROUP BY 1, 2), ps AS (SELECT period, ticker, avg(CASE WHEN total > 0 THEN 1.0 ELSE 0.0 END) AS share FROM mo GROUP BY 1, 2),
al AS (SELECT t.ticker, st.period FROM (SELECT DISTINCT ticker FROM q) t, {_STRESS_SQL})
SELECT al.ticker, al.period, coalesce(n, 0) AS n, {r6_sql('sharpe', 'sharpe')}, {r6_sql('share', 'positive_months')}, CASE WHEN coalesce(n, 0) = 0 THEN 'NOT_COVERED' WHEN n < 5 THEN 'PARTIAL' ELSE 'COVERED' END AS coverage, coalesce(n >= 5 AND sharpe > 0 AND share >= 0.6, FALSE) AS passed, bool_and(coalesce(n >= 5 AND sharpe > 0 AND share >= 0.6, FALSE)) OVER (PARTITION BY al.ticker) AS all_passed FROM al LEFT JOIN sh USING (ticker, period) LEFT JOIN ps USING (ticker, period)""",
)
def stress_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Each stress period must have a positive Sharpe ratio and six months in ten positive; all must pass, and one without data fails."""
    st = spark.createDataFrame(list(_STRESS), "period string, a string, z string").select("period", F.to_date("a").alias("a"), F.to_date("z").alias("z"))
    r = R._returns(spark, sf)
    x = r.join(F.broadcast(st), F.col("date").between(F.col("a"), F.col("z")))  # three periods
    months = x.groupBy("period", "ticker", F.date_trunc("month", "date").alias("m")).agg(F.sum("ret").alias("total"), F.count("ret").alias("n"), F.sum(F.col("ret") * F.col("ret")).alias("sq"))
    n, total, sq = F.sum("n"), F.sum("total"), F.sum("sq")
    sd = F.sqrt(F.greatest((sq - total * total / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    per = months.groupBy("period", "ticker").agg(n.alias("n"), (total / n / F.nullif(sd, F.lit(0.0)) * 52**0.5).alias("sharpe"), F.avg((F.col("total") > 0).cast("double")).alias("share"))
    every = r.select("ticker").distinct().withColumn("period", F.explode(F.array(*[F.lit(p) for p, _, _ in _STRESS])))
    j = every.join(per, ["ticker", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = F.coalesce((F.col("n") >= 5) & (F.col("sharpe") > 0) & (F.col("share") >= 0.6), F.lit(False))
    coverage = F.when(F.col("n") == 0, "NOT_COVERED").when(F.col("n") < 5, "PARTIAL").otherwise("COVERED")
    j = j.withColumn("passed", ok)
    return j.select("ticker", "period", "n", r6("sharpe"), r6("share", "positive_months"), coverage.alias("coverage"), "passed", F.bool_and("passed").over(Window.partitionBy("ticker")).alias("all_passed"))


# --- series ---

_D = bars_sql("day")
_DR = _D + f", dr AS (SELECT *, {ret_sql('close')} AS ret FROM bars)"


_w63 = over("ROWS BETWEEN 62 PRECEDING AND CURRENT ROW")


@_add("rolling_sharpe", _DR + f" SELECT ticker, date, {r6_sql(f'CASE WHEN count(ret) {_w63} >= 63 THEN avg(ret) {_w63} / nullif(stddev_samp(ret) {_w63}, 0) * sqrt(252) END', 'sharpe')} FROM dr")
def rolling_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """Annualised Sharpe ratio of the last 63 days."""
    b = bars(spark, sf, "day").withColumn("ret", P.simple_return("close"))
    w = P.ts().rowsBetween(-62, 0)
    sharpe = F.when(F.count("ret").over(w) >= 63, F.avg("ret").over(w) / F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0)) * 252**0.5)
    return b.select("ticker", "date", r6(sharpe, "sharpe"))


@_add("month_starts", _D + " SELECT ticker, date_trunc('month', date)::DATE AS month, min(date) AS first_date, arg_min(open, date) AS first_open FROM bars GROUP BY 1, 2")
def month_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each month."""
    return bars(spark, sf, "day").groupBy("ticker", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.min("date").alias("first_date"), F.min_by("open", "date").alias("first_open"))


@_add(
    "carry_to_month_ends",
    _D + ", sp AS (SELECT ticker, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM bars GROUP BY 1), me AS (SELECT ticker, last_day(m::DATE) AS month_end FROM sp) SELECT me.ticker, me.month_end, b.date AS as_of, b.close FROM me ASOF LEFT JOIN bars b ON b.ticker = me.ticker AND me.month_end >= b.date",
)
def carry_to_month_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The last value at or before each month end, months without rows included: one row a month first, then carried."""
    last = bars(spark, sf, "day").groupBy("ticker", F.last_day("date").alias("month_end")).agg(F.max(F.struct("date", "close")).alias("v"))
    span = last.groupBy("ticker").agg(F.min("month_end").alias("a"), F.max("month_end").alias("z"))
    months = F.transform(F.sequence(F.trunc("a", "month"), F.trunc("z", "month"), F.expr("interval 1 month")), F.last_day)
    grid = span.select("ticker", F.explode(months).alias("month_end")).join(last, ["ticker", "month_end"], "left")
    v = F.last("v", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn("v", v).select("ticker", "month_end", F.col("v.date").alias("as_of"), F.col("v.close").alias("close"))


@_add(
    "fill_back",
    _D + f", days AS (SELECT DISTINCT date FROM bars), names AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT n.ticker, d.date, b.close FROM days d CROSS JOIN names n LEFT JOIN bars b ON b.ticker = n.ticker AND b.date = d.date) SELECT ticker, date, first_value(close IGNORE NULLS) {over('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS filled, first_value(close IGNORE NULLS) {over('ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING')} AS filled2 FROM g",
)
def fill_back(spark: SparkSession, sf: str) -> DataFrame:
    """The daily panel on the union of dates, filled from later rows, without limit and from two days at most."""
    b = bars(spark, sf, "day").select("ticker", "date", "close")
    names = b.select("ticker").distinct().withColumn("one", F.lit(1))
    g = b.select("date").distinct().withColumn("one", F.lit(1)).join(names, "one").drop("one").join(b, ["ticker", "date"], "left")  # a calendar per name

    def next_known(rows: int) -> Column:
        return F.first("close", ignorenulls=True).over(P.ts().rowsBetween(0, rows))

    return g.select("ticker", "date", next_known(Window.unboundedFollowing).alias("filled"), next_known(2).alias("filled2"))


@_add(
    "event_labels",
    _D
    + f", p AS (SELECT ticker, date, close, lead(close, 5) {over()} AS later FROM bars), an AS (SELECT ticker, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH))::DATE + 14 AS anchor FROM bars GROUP BY 1) SELECT an.ticker, an.anchor, p.date AS entry, {r6_sql('p.later / p.close - 1', 'label')} FROM an ASOF LEFT JOIN p ON p.ticker = an.ticker AND an.anchor <= p.date",
)
def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Forward label of five rows from the first trading date at or after an anchor (the 15th of each month)."""
    p = bars(spark, sf, "day").select("ticker", "date", F.struct("date", "close", P.lag("close", -5).alias("later")).alias("v"))
    span = p.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    anchors = span.select("ticker", F.explode(F.transform(F.sequence(F.trunc("a", "month"), F.trunc("z", "month"), F.expr("interval 1 month")), lambda d: F.date_add(d, 14))).alias("date"))
    both = p.withColumn("anchor", F.lit(False)).unionByName(anchors.withColumns({"v": F.lit(None).cast(p.schema["v"].dataType), "anchor": F.lit(True)}))
    v = F.first("v", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date", F.desc("anchor")).rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("v", v).where("anchor").select("ticker", F.col("date").alias("anchor"), F.col("v.date").alias("entry"), r6(F.col("v.later") / F.col("v.close") - 1, "label"))


@_add(
    "spot_perp_basis",
    "WITH s AS (SELECT symbol, ts // 60000000000 AS minute, median(price) AS spot FROM (SELECT DISTINCT agg_trade_id, symbol, exchange_ts_ns AS ts, price FROM trade_events WHERE exchange_ts_ns IS NOT NULL AND price > 0 AND isfinite(price)) GROUP BY 1, 2), p AS (SELECT symbol, ts // 60000000000 AS minute, median(mid) AS perp FROM (SELECT DISTINCT last_update_id, symbol, exchange_ts_ns AS ts, mid FROM book_snapshots WHERE exchange_ts_ns IS NOT NULL AND mid > 0) GROUP BY 1, 2) SELECT symbol, minute, round((perp / spot - 1) * 1e4, 4) + 0.0 AS basis_bps FROM s JOIN p USING (symbol, minute)",
)
def spot_perp_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Two markets joined on the minute: their basis; both sides are grouped before the join."""
    minute = F.expr("exchange_ts_ns div 60000000000").alias("minute")
    t = table(spark, sf, "trade_events").where("exchange_ts_ns is not null and price > 0 and not isnan(price) and price < double('inf')").select("agg_trade_id", "symbol", minute, "exchange_ts_ns", "price").distinct()
    k = table(spark, sf, "book_snapshots").where("exchange_ts_ns is not null and mid > 0").select("last_update_id", "symbol", minute, "exchange_ts_ns", "mid").distinct()
    s = t.groupBy("symbol", "minute").agg(F.median("price").alias("spot"))
    p = k.groupBy("symbol", "minute").agg(F.median("mid").alias("perp"))
    return s.join(p, ["symbol", "minute"]).select("symbol", "minute", (F.round((F.col("perp") / F.col("spot") - 1) * 1e4, 4) + 0.0).alias("basis_bps"))


# --- facts ---

_TAGS = ("2-HIGH", "1-URGENT", "3-MEDIUM")


@_add(
    "concept_priority",
    "SELECT o_custkey, fiscal_year, tag, val FROM (SELECT o_custkey, year(o_orderdate) AS fiscal_year, o_orderpriority AS tag, o_totalprice AS val, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderpriority IN ('2-HIGH', '1-URGENT', '3-MEDIUM')) WHERE k = 1",
)
def concept_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Each period's value under the first tag of a list that has one, the latest filing of it; combined on the map side."""
    tags = F.array(*[F.lit(t) for t in _TAGS])
    rank = (-F.array_position(tags, F.col("o_orderpriority"))).alias("rank")
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin(*_TAGS))
    best = o.groupBy("o_custkey", F.year("o_orderdate").alias("fiscal_year")).agg(F.max(F.struct(rank, "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("tag"), F.col("o_totalprice").alias("val"))).alias("m"))
    return best.select("o_custkey", "fiscal_year", "m.tag", "m.val")


@_add(
    "fiscal_value_known",
    "WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS filed, year(o_orderdate::DATE - 180) AS fiscal_year, o_totalprice AS val FROM orders), y AS (SELECT unnest(generate_series(min(year(filed)), max(year(filed)) + 1)) AS y FROM f), k AS (SELECT o_custkey, make_date(y, 6, 30) AS as_of, fiscal_year, val, row_number() OVER (PARTITION BY o_custkey, y ORDER BY fiscal_year DESC, filed DESC, o_orderkey DESC) AS k FROM f JOIN y ON filed <= make_date(y, 6, 30)) SELECT o_custkey, as_of, fiscal_year, val FROM k WHERE k = 1",
)
def fiscal_value_known(spark: SparkSession, sf: str) -> DataFrame:
    """Value of the latest fiscal year as known each June: a fact is put under every June that knows it, then the best is kept."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("filed"), F.year(F.date_sub(day, 180)).alias("fiscal_year"), F.col("o_totalprice").alias("val"))
    last = o.agg(F.max(F.year("filed")) + 1).first()[0]
    if last is None:
        return o.select("o_custkey", F.col("filed").alias("as_of"), "fiscal_year", "val")
    first = F.when(F.month("filed") <= 6, F.year("filed")).otherwise(F.year("filed") + 1)
    known = o.select("*", F.explode(F.sequence(first, F.lit(last))).alias("y"))
    best = known.groupBy("o_custkey", F.make_date("y", F.lit(6), F.lit(30)).alias("as_of")).agg(F.max(F.struct("fiscal_year", "filed", "o_orderkey", "val")).alias("m"))
    return best.select("o_custkey", "as_of", "m.fiscal_year", "m.val")


@_add(
    "facts_json",
    "SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS concept, count(*) AS n_facts, max(o_orderdate::DATE) AS last_end, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
)
def facts_json(spark: SparkSession, sf: str) -> DataFrame:
    """Facts kept as one nested JSON document a company, taken apart again: concepts, units and rows exploded with a fixed schema."""
    fact = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"))
    concept = F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed")
    per = table(spark, sf, "orders").groupBy("o_custkey", concept.alias("concept")).agg(F.collect_list(fact).alias("facts"))  # one customer's orders
    docs = per.groupBy("o_custkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("concept", F.create_map(F.lit("USD"), F.col("facts")).alias("units")))).alias("facts"))).alias("doc"))
    parsed = docs.select("o_custkey", F.from_json("doc", "facts map<string, map<string, array<struct<end: string, val: double>>>>").alias("d"))
    rows = parsed.select("o_custkey", F.explode("d.facts").alias("concept", "units")).select("o_custkey", "concept", F.explode("units").alias("unit", "facts")).select("o_custkey", "concept", F.inline("facts"))
    return rows.groupBy("o_custkey", "concept").agg(F.count(F.lit(1)).alias("n_facts"), F.to_date(F.max("end")).alias("last_end"), F.round(F.sum("val"), 2).alias("total"))


# --- reports, manifests ---


def _fresh(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_SUMMARY = B + f", r AS (SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, {r6_sql('avg(close)', 'mean_close')} FROM bars GROUP BY 1) "


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), r6(F.avg("close"), "mean_close"))


@_add("report_sinks", _SUMMARY + " ".join(["SELECT f.format, r.* FROM r, (VALUES ('csv'), ('json'), ('markdown')) f(format)"]))
def report_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as CSV, JSON lines and a Markdown table, read back from each."""
    report = _summary(spark, sf)
    schema = "ticker string, n_rows bigint, first_date date, last_date date, mean_close double"
    paths = {f: _fresh(spark, f) for f in ("csv", "json", "markdown")}
    report.write.option("header", True).csv(paths["csv"])
    report.write.json(paths["json"])
    cells = [F.col(c).cast("string") for c in report.columns]
    report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.text(paths["markdown"])
    cut = F.split(F.trim(F.regexp_replace("value", r"^\| | \|$", "")), r" \| ")
    marked = spark.read.text(paths["markdown"]).select(*[cut[i].cast(t.split()[1]).alias(t.split()[0]) for i, t in enumerate(schema.split(", "))])
    out = {"csv": spark.read.schema(schema).option("header", True).csv(paths["csv"]), "json": spark.read.schema(schema).json(paths["json"]), "markdown": marked}
    union = None
    for name, df in out.items():
        one = df.select(F.lit(name).alias("format"), *report.columns)
        union = one if union is None else union.unionByName(one)
    return union


@_add("universe_manifest", _SUMMARY + "SELECT ticker, n_rows, first_date, last_date, 'bars/ticker=' || ticker AS path FROM r")
def universe_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The universe's manifest as one JSON document, read back as rows."""
    path = _fresh(spark, "manifest")
    spec = F.struct("ticker", "n_rows", F.col("first_date").cast("string").alias("start"), F.col("last_date").cast("string").alias("end"), F.concat(F.lit("bars/ticker="), "ticker").alias("path"))
    _summary(spark, sf).agg(F.array_sort(F.collect_list(spec)).alias("tickers")).coalesce(1).write.json(path)  # one row a ticker
    back = spark.read.schema("tickers array<struct<ticker: string, n_rows: bigint, start: string, `end`: string, path: string>>").json(path)
    return back.select(F.inline("tickers")).select("ticker", "n_rows", F.to_date("start").alias("first_date"), F.to_date("end").alias("last_date"), "path")


# --- quality ---

_ADJ = "adj AS (SELECT p_brand AS ticker, l_shipdate::DATE AS date, avg(1 - l_discount) AS factor, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS action FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@_add(
    "data_quality",
    _D
    + f""", {_ADJ}, p AS (SELECT bars.*, {ret_sql('close')} AS ret, factor / nullif(lag(factor) {over()}, 0) - 1 AS jump, action FROM bars JOIN adj USING (ticker, date)), gaps AS ({_PANEL['gap_runs']}),
i AS (SELECT ticker, date, 'nan_values' AS code FROM p WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR isnan(close) UNION ALL SELECT ticker, date, 'bad_prices' FROM p WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < low
 UNION ALL SELECT ticker, date, 'zero_volume' FROM p WHERE volume <= 0 UNION ALL SELECT ticker, date, 'extreme_return' FROM p WHERE abs(ret) > 0.5 UNION ALL SELECT ticker, date, 'adj_close_divergence' FROM p WHERE abs(jump) > 0.05 AND action = 0 UNION ALL SELECT ticker, first_missing, 'missing_days' FROM gaps)
SELECT ticker, code, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM i GROUP BY 1, 2""",
)
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of daily bars as one report: missing and impossible values, moves beyond one half, adjustments without an action, runs of missing days."""
    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    adj = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(F.avg(1 - F.col("l_discount")).alias("factor"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("action"))
    b = bars(spark, sf, "day").join(adj, ["ticker", "date"]).withColumns({"ret": P.simple_return("close"), "jump": F.col("factor") / F.nullif(P.lag("factor"), F.lit(0.0)) - 1})
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing, bad = F.isnan("close"), F.col("high") < F.col("low")
    for c in [*prices, F.col("volume")]:
        missing = missing | c.isNull()
    for c in prices:
        bad = bad | (c <= 0)
    checks = {"nan_values": missing, "bad_prices": bad, "zero_volume": F.col("volume") <= 0, "extreme_return": F.abs("ret") > 0.5, "adj_close_divergence": (F.abs("jump") > 0.05) & (F.col("action") == 0)}
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    i = b.select("ticker", "date", F.explode(codes).alias("code")).unionByName(gap_runs(spark, sf).select("ticker", F.col("first_missing").alias("date"), F.lit("missing_days").alias("code")))
    return i.groupBy("ticker", "code").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# --- limits and halts ---

_FILLED = f"(SELECT DISTINCT * FROM exec_orders)"
_DRAG = f"fl AS (SELECT account_id, median(slippage_bps) AS med, sum(fill_price * fill_quantity * (slippage_bps - 5.0) * 1e-4) AS drag FROM {_FILLED} WHERE status = 'FILLED' AND slippage_bps IS NOT NULL AND fill_price > 0 AND isfinite(fill_price) AND fill_quantity IS NOT NULL GROUP BY 1)"
_HALTS = (
    R._LOSS
    + f", {_DRAG}, dd AS (SELECT account_id, date, nav, max(nav) OVER (PARTITION BY account_id ORDER BY date) AS peak FROM d WHERE nav IS NOT NULL), t AS (SELECT l.account_id, l.date, l.ret, l.streak, 1 - dd.nav / dd.peak AS drawdown, fl.med, fl.drag / nullif(dd.nav, 0) AS drag FROM l LEFT JOIN dd USING (account_id, date) LEFT JOIN fl USING (account_id)), "
    "c AS (SELECT account_id, date, coalesce(drawdown > 0.12, FALSE) AS drawdown_hit, ret < -0.03 AS loss_hit, streak >= 5 AS streak_hit, coalesce(med > 15, FALSE) AS slippage_hit, coalesce(drag > 0.02, FALSE) AS drag_hit FROM t)"
)
_HITS = ("drawdown_hit", "loss_hit", "streak_hit", "slippage_hit", "drag_hit")


def _halts(spark: SparkSession, sf: str) -> DataFrame:
    states = R._states(spark, sf)
    whole = Window.partitionBy("account_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = states.where("nav is not null").select("account_id", "date", "nav", F.max("nav").over(whole).alias("peak"))
    o = table(spark, sf, "exec_orders").distinct().where("status = 'FILLED' and slippage_bps is not null and fill_price > 0 and not isnan(fill_price) and fill_price < double('inf') and fill_quantity is not null")
    fl = o.groupBy("account_id").agg(F.median("slippage_bps").alias("med"), F.sum(F.col("fill_price") * F.col("fill_quantity") * (F.col("slippage_bps") - 5.0) * 1e-4).alias("drag"))
    t = BT.loss_streaks(states, "account_id", "date", "ret").select("account_id", "date", "ret", "streak").join(d, ["account_id", "date"], "left").join(fl, "account_id", "left")
    no = F.lit(False)
    return t.select(
        "account_id", "date", F.coalesce(1 - F.col("nav") / F.col("peak") > 0.12, no).alias("drawdown_hit"), (F.col("ret") < -0.03).alias("loss_hit"), (F.col("streak") >= 5).alias("streak_hit"),
        F.coalesce(F.col("med") > 15, no).alias("slippage_hit"), F.coalesce(F.col("drag") / F.nullif("nav", F.lit(0.0)) > 0.02, no).alias("drag_hit"),
    )


@_add("kill_switch", _HALTS + f" SELECT * FROM c WHERE {' OR '.join(_HITS)}")
def kill_switch(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which an account's triggers fire: drawdown, one day's loss, losing streak, median slippage, cumulated drag of fills."""
    return _halts(spark, sf).where(" or ".join(_HITS))


@_add(
    "unwind_ladder",
    _HALTS + f", h AS (SELECT account_id, min(date) AS halt_date FROM c WHERE {' OR '.join(_HITS)} GROUP BY 1) SELECT c.account_id, c.date, h.halt_date, CASE WHEN h.halt_date IS NULL OR c.date < h.halt_date THEN 0.0 WHEN c.date = h.halt_date THEN 0.5 ELSE 1.0 END AS close_fraction FROM c LEFT JOIN h USING (account_id)",
)
def unwind_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the book is to be closed on each day: half on the day of the first halt, all after it."""
    h = _halts(spark, sf)
    fired = F.expr(" or ".join(_HITS))
    halt = F.min(F.when(fired, F.col("date"))).over(Window.partitionBy("account_id"))
    return h.withColumn("halt_date", halt).select("account_id", "date", "halt_date", F.when(F.col("date") == F.col("halt_date"), 0.5).when(F.col("date") > F.col("halt_date"), 1.0).otherwise(0.0).alias("close_fraction"))


@_add(
    "turnover_limits",
    "WITH w AS (SELECT s.account_id, s.recorded_at, w.key AS ticker, CAST(w.value AS DOUBLE) AS w FROM (SELECT account_id, recorded_at, max(weights) AS weights FROM snapshots WHERE weights IS NOT NULL AND recorded_at IS NOT NULL GROUP BY 1, 2) s, json_each(s.weights) w), d AS (SELECT account_id, recorded_at, lag(recorded_at) OVER (PARTITION BY account_id ORDER BY recorded_at) AS before FROM (SELECT DISTINCT account_id, recorded_at FROM w)), "
    "m AS (SELECT account_id, recorded_at, ticker, sum(w) AS w FROM (SELECT account_id, recorded_at, ticker, w FROM w UNION ALL SELECT d.account_id, d.recorded_at, w.ticker, -w.w FROM d JOIN w ON w.account_id = d.account_id AND w.recorded_at = d.before) GROUP BY 1, 2, 3) SELECT account_id, recorded_at, round(sum(abs(w)), 6) + 0.0 AS turnover, round(sum(abs(w)), 6) > 0.3 AS over_limit FROM m GROUP BY 1, 2",
)
def turnover_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Turnover of weights from one snapshot of an account to the next, against a limit; each weight is sent to its own and the next snapshot."""
    s = table(spark, sf, "snapshots").where("weights is not null and recorded_at is not null").groupBy("account_id", "recorded_at").agg(F.max("weights").alias("weights"))
    s = s.withColumn("w", F.from_json("weights", "map<string,double>")).where(F.size("w") > 0)
    nxt = F.lead("recorded_at").over(Window.partitionBy("account_id").orderBy("recorded_at"))
    w = s.withColumn("nxt", nxt).select("account_id", "recorded_at", "nxt", F.explode("w").alias("ticker", "w"))
    both = w.select("account_id", "ticker", F.inline(F.array(F.struct(F.col("recorded_at").alias("at"), F.col("w").alias("d")), F.struct(F.col("nxt").alias("at"), (-F.col("w")).alias("d"))))).where("at is not null")
    m = both.groupBy("account_id", "at", "ticker").agg(F.sum("d").alias("d"))
    t = m.groupBy("account_id", F.col("at").alias("recorded_at")).agg(r6(F.sum(F.abs("d")), "turnover"))
    return t.withColumn("over_limit", F.col("turnover") > 0.3)


# --- scalars ---


@_add(
    "vol_sizing",
    _LR + f", v AS (SELECT ticker, date, {roll_sql('stddev_samp({})', 'r', 8)} * {52**0.5!r} AS vol FROM lr) SELECT ticker, date, {r6_sql('least(0.2 / nullif(vol, 0), 1.0) * CASE WHEN date < DATE ' + chr(39) + '1995-06-01' + chr(39) + ' THEN 1.0 ELSE 0.5 END', 'size')} FROM v WHERE vol IS NOT NULL",
)
def vol_sizing(spark: SparkSession, sf: str) -> DataFrame:
    """Size inverse to volatility, with the instrument's multiplier of the date."""
    v = bars(spark, sf).withColumn("r", P.log_return("close")).select("ticker", "date", (P.rolling(F.stddev_samp, "r", 8) * 52**0.5).alias("vol")).where("vol is not null")
    multiplier = F.when(F.col("date") < F.lit("1995-06-01").cast("date"), 1.0).otherwise(0.5)
    return v.select("ticker", "date", r6(S.inverse_vol_size(0.2, F.col("vol")) * multiplier, "size"))


_HOLIDAYS = ("1995-12-28", "1996-04-25", "1997-01-30", "1997-01-29", "1998-05-28")


@_add(
    "calendar_functions",
    "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), e AS (SELECT day, (last_day(day) - CAST((isodow(last_day(day)) - 4 + 7) % 7 AS INTEGER))::DATE AS thursday FROM d), c AS (SELECT day, thursday, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS back FROM e) "
    f"SELECT c.day, max(thursday - back) FILTER (WHERE isodow(thursday - back) < 6 AND (thursday - back) NOT IN ({', '.join(f'DATE {chr(39)}{h}{chr(39)}' for h in _HOLIDAYS)})) AS expiry, date_trunc('month', c.day)::DATE + CASE isodow(date_trunc('month', c.day)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS month_start, epoch_ns(c.day::TIMESTAMP) AS ns, strftime(c.day, '%Y-%m-%dT00:00:00Z') AS iso FROM c GROUP BY c.day",
)
def calendar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Expiry moved back over holidays and weekends, first business day of the month, days as nanoseconds and ISO text and back."""
    day = F.col("day")
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    thursday = S.last_thursday(day)
    open_days = F.filter(F.sequence(F.date_sub(thursday, 7), thursday), lambda x: ~F.dayofweek(x).isin(1, 7) & ~F.date_format(x, "yyyy-MM-dd").isin(*_HOLIDAYS))
    start = F.trunc(day, "month")
    ns = F.unix_date("day") * F.lit(86_400_000_000_000)
    back = F.date_format(F.timestamp_micros(F.expr("unix_date(day) * 86400000000")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return d.select("day", F.array_max(open_days).alias("expiry"), F.date_add(start, F.when(F.dayofweek(start) == 7, 2).when(F.dayofweek(start) == 1, 1).otherwise(0)).alias("month_start"), ns.alias("ns"), back.alias("iso"))


_SPELL = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) || ' ' WHEN 2 THEN c_name || ' Holdings, Ltd.' ELSE replace(c_name, '#', ' -- ') || ' Inc' END"


def _folded_sql(x: str) -> str:
    return f"upper(trim({x}))"


def _bare_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(upper(trim({x})), '[.,&''()]', ' ', 'g'), '\b(LIMITED|LTD|INC|CORP|CORPORATION|CO|PLC|GROUP|HOLDINGS|COMPANY)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def _tight_sql(x: str) -> str:
    return f"regexp_replace({_bare_sql(x)}, '[^A-Z0-9]', '', 'g')"


@_add(
    "name_cascade",
    f"WITH n AS (SELECT c_custkey, {_SPELL} AS name FROM customer), k AS (SELECT c_custkey AS id, c_name AS exact, {_folded_sql('c_name')} AS folded, {_bare_sql('c_name')} AS bare, {_tight_sql('c_name')} AS tight FROM customer) "
    f"SELECT n.c_custkey, n.name, coalesce(a.id, b.id, c.id, d.id) AS resolved, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'folded' WHEN c.id IS NOT NULL THEN 'stripped' WHEN d.id IS NOT NULL THEN 'tight' END AS layer FROM n LEFT JOIN k a ON a.exact = n.name LEFT JOIN k b ON b.folded = {_folded_sql('n.name')} LEFT JOIN k c ON c.bare = {_bare_sql('n.name')} LEFT JOIN k d ON d.tight = {_tight_sql('n.name')}",
)
def name_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names in four spellings resolved layer by layer: as written, folded, without legal form, letters and digits only.

    Every spelling's keys go through one shuffle: the best layer of each name is kept.
    """
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lower("c_name"), F.lit(" "))).when(k == 2, F.concat("c_name", F.lit(" Holdings, Ltd."))).otherwise(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(" -- ")), F.lit(" Inc")))
    names = c.select("c_custkey", name.alias("name"))

    def layers(x: Column) -> Column:
        bare = S.strip_suffix(x)
        forms = [x, F.upper(F.trim(x)), bare, F.regexp_replace(bare, "[^A-Z0-9]", "")]
        return F.explode(F.array(*[F.struct(F.lit(i).alias("layer"), f.alias("form")) for i, f in enumerate(forms)]))

    known = c.select(F.col("c_custkey").alias("id"), layers(F.col("c_name")).alias("l")).select("id", "l.layer", "l.form")
    asked = names.select("c_custkey", layers(F.col("name")).alias("l")).select("c_custkey", "l.layer", "l.form")
    best = asked.join(known, ["layer", "form"]).groupBy("c_custkey").agg(F.min(F.struct("layer", "id")).alias("m"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("exact", "folded", "stripped", "tight")]), F.col("m.layer") + 1)
    return names.join(best, "c_custkey", "left").select("c_custkey", "name", F.col("m.id").alias("resolved"), label.alias("layer"))


@_add(
    "episode_reward",
    R._RET
    + f""", m AS (SELECT *, ret - avg(ret) OVER (PARTITION BY date) AS active, row_number() {over()} AS k, product(1 + ret) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS nav, abs(sign(ret) - sign(lag(ret) {over()})) AS turn FROM q), p AS (SELECT *, max(nav) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS peak FROM m),
c AS (SELECT ticker, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS good FROM (SELECT ticker, (k - 1) // 21 AS chunk, sum(ret) AS s FROM p GROUP BY 1, 2) GROUP BY 1), a AS (SELECT ticker, {_SR.format('ret')} AS sr, {_SR.format('active')} AS act, max(1 - nav / peak) AS dd, avg(turn) AS turn FROM p GROUP BY 1)
SELECT ticker, {r6_sql('0.7 * sr + 0.3 * act - 2 * greatest(0, dd - 0.1) + CASE WHEN good > 0.55 THEN 0.2 ELSE 0 END - 0.1 * turn', 'reward')} FROM a JOIN c USING (ticker)""",
)
def episode_reward(spark: SparkSession, sf: str) -> DataFrame:
    """Reward of an episode: Sharpe ratio and that of the active return, less drawdown and turnover, with a bonus for steady chunks of 21 rows."""
    whole = P.ts().rowsBetween(Window.unboundedPreceding, 0)
    r = R._returns(spark, sf).withColumn("active", F.col("ret") - F.avg("ret").over(P.cs()))
    p = r.withColumns({"k": F.row_number().over(P.ts()), "nav": F.product(1 + F.col("ret")).over(whole), "turn": F.abs(F.signum("ret") - F.signum(P.lag("ret")))}).withColumn("peak", F.max("nav").over(whole))
    p = p.withColumn("chunk_sum", F.sum("ret").over(Window.partitionBy("ticker", F.floor((F.col("k") - 1) / 21)))).withColumn("first", (F.col("k") - 1) % 21 == 0)

    def sharpe(c: str) -> Column:
        return F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * 52**0.5

    good = F.avg(F.when(F.col("first"), (F.col("chunk_sum") > 0).cast("double")))
    a = p.groupBy("ticker").agg(sharpe("ret").alias("sr"), sharpe("active").alias("act"), F.max(1 - F.col("nav") / F.col("peak")).alias("dd"), F.avg("turn").alias("turn"), good.alias("good"))
    return a.select("ticker", r6(0.7 * F.col("sr") + 0.3 * F.col("act") - 2 * F.greatest(F.lit(0.0), F.col("dd") - 0.1) + F.when(F.col("good") > 0.55, 0.2).otherwise(0.0) - 0.1 * F.col("turn"), "reward"))


# --- factor returns ---

_AM = roll_sql("avg({})", "il", 8, 4)


@_add(
    "market_size_liquidity",
    _LR
    + f""", i AS (SELECT *, abs(sr) / nullif(close * volume, 0) AS il FROM lr), am AS (SELECT *, {_AM} AS am FROM i), v AS (SELECT ticker, date, sr, lag(close * volume) {over()} AS cap, lag(am) {over()} AS am FROM am), mk AS (SELECT date, avg(sr) AS mkt FROM v GROUP BY 1 HAVING count(sr) > 0),
sz AS (SELECT *, median(cap) OVER (PARTITION BY date) AS mc, count(*) OVER (PARTITION BY date) AS n FROM v WHERE cap IS NOT NULL AND sr IS NOT NULL), smb AS (SELECT date, avg(CASE WHEN cap <= mc THEN sr END) - avg(CASE WHEN cap > mc THEN sr END) AS smb FROM sz WHERE n >= 4 GROUP BY 1),
lq AS (SELECT *, quantile_cont(am, 0.2) OVER (PARTITION BY date) AS lo, quantile_cont(am, 0.8) OVER (PARTITION BY date) AS hi, count(*) OVER (PARTITION BY date) AS n FROM v WHERE am IS NOT NULL AND sr IS NOT NULL), liq AS (SELECT date, avg(CASE WHEN am <= lo THEN sr END) - avg(CASE WHEN am >= hi THEN sr END) AS liq FROM lq WHERE n >= 10 GROUP BY 1)
SELECT mk.date, {r6_sql('mkt', 'mkt')}, {r6_sql('coalesce(smb, 0)', 'smb')}, {r6_sql('coalesce(liq, 0)', 'liq')} FROM mk LEFT JOIN smb USING (date) LEFT JOIN liq USING (date)""",
)
def market_size_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    """Market, size and liquidity returns; names are sorted by what was known the row before."""
    b = bars(spark, sf).withColumn("sr", P.simple_return("close")).withColumn("il", F.abs("sr") / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)))
    b = b.withColumns({"cap": F.col("close") * F.col("volume"), "am": P.rolling(F.avg, "il", 8, 4)})
    v = b.select("ticker", "date", "sr", P.lag("cap").alias("cap"), P.lag("am").alias("am")).where("sr is not null")
    sized, told = F.when(F.col("cap").isNotNull(), F.col("cap")), F.col("am")
    v = v.withColumns({"mc": F.percentile(sized, F.lit(0.5)).over(P.cs()), "lo": F.percentile(told, F.lit(0.2)).over(P.cs()), "hi": F.percentile(told, F.lit(0.8)).over(P.cs())})

    def mean(c: Column) -> Column:
        return F.avg(F.when(c, F.col("sr")))

    g = v.groupBy("date").agg(
        F.avg("sr").alias("mkt"), F.when(F.count("cap") >= 4, mean(F.col("cap") <= F.col("mc")) - mean(F.col("cap") > F.col("mc"))).alias("smb"), F.when(F.count("am") >= 10, mean(F.col("am") <= F.col("lo")) - mean(F.col("am") >= F.col("hi"))).alias("liq")
    )
    return g.select("date", r6("mkt"), r6(F.coalesce("smb", F.lit(0.0)), "smb"), r6(F.coalesce("liq", F.lit(0.0)), "liq"))


__all__ = ["ORACLE", "QUERIES", "lag_sql"]
