"""Implausible readings per source: extreme-value cutoffs, stuck values, plausibility.

Peaks over threshold: what a source shows beyond the 95 % quantile of its
residuals is fitted by a generalised Pareto distribution, and the cutoff is the
value it would exceed with a fixed risk a reading.  Residuals are

* prices in a sequence: the distance of the log price from the median of nine
  trades around it, over the scatter of that time (median step of the 101 trades
  around it), so calm and lively seasons have their own scale; only excursions of
  at most three trades count, since a lasting move pulls the median along;
* sizes: the log size above the source's median;
* fill prices: the distance of the log price from the source's median.

The fits never see rows: each source's residuals are counted into fine bins
(exact counts of all rows, combined on the map side), and one task per source
fits some thousand bins.  A stuck run is flagged from eight equal readings on, or
from the length that the source's own repeats would exceed only by chance.  Runs that
touch the edge of a segment are put together over segments, so none is measured short.

Sizes and fill prices have no season: a size must lie above, a fill price outside all that
its source otherwise shows, at whatever time.

Defined cases: null readings are no cases and break no run; zero, negative,
infinite and NaN readings are always cases and take no part in fits; rows without
source or order take no part in sequences; repeated rows of a key count once; a source
with fewer than MIN_READINGS gets cutoffs from twelve times its median distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.segments import segmented
from tidemark.session import materialise

#: Risk per reading at which a cutoff is set, and of a natural run as long as a flagged one.
RISK = 1e-7
RUN_RISK = 0.01
MIN_READINGS = 40
STUCK_FROM = 8
LONGEST_SPIKE = 3
#: Residuals below this many local scatters are never spikes; keeps candidates few.
LEAST_SCATTERS = 4.0
BINS = 32  # a unit of log scatter and log size
PRICE_BINS = 1024  # a unit of log price


def gpd_cutoff(x: np.ndarray, n: np.ndarray, risk: float = RISK) -> float:
    """Value that a reading exceeds with probability `risk`; x: residuals >= 0 (sorted), n: their counts.

    The bulk ends at the first natural break beyond the 95 % quantile (a gap of
    three tenths of the value before it); without one, where a quantile fit puts the
    risk.  The bulk's peaks are fitted by probability-weighted moments until what
    counts as bulk no longer changes.
    """
    total = n.sum()
    below = np.cumsum(n) / total

    def quantile(q: float) -> float:
        return float(x[min(np.searchsorted(below, q), len(x) - 1)])

    if total < MIN_READINGS:
        return max(12.0 * quantile(0.5), float(np.finfo(float).tiny))
    u = quantile(0.95)
    tail = np.flatnonzero(x >= u)
    gaps = [i for i in tail[:-1] if x[i + 1] - x[i] > 0.3 * x[i]]
    if gaps:
        cap = float(x[gaps[0]])
    else:
        a, b = quantile(0.975) - u, quantile(0.9875) - u
        shape = float(np.clip(np.log2(max(b - a, 1e-12) / max(a, 1e-12)), -1.0, 0.25)) if a > 0 else 0.0
        scale = a * shape / (2.0**shape - 1.0) if abs(shape) > 1e-6 else a / np.log(2.0)
        cap = u + _gpd_quantile(scale, shape, 0.05, risk)
    cutoff = np.inf
    for _ in range(20):
        keep = x <= cap
        kx, kn = x[keep], n[keep]
        over = kx > u
        share = kn[over].sum() / total
        if share <= 0 or kn[over].sum() < 5:
            cutoff = 1.5 * max(float(kx.max()), u)
            break
        y, w = kx[over] - u, kn[over] / kn[over].sum()
        rank = np.cumsum(w) - 0.5 * w
        b0, b1 = float((w * y).sum()), float((w * y * (1.0 - rank)).sum())
        shape = float(np.clip(2.0 - b0 / max(b0 - 2.0 * b1, 1e-12), -1.0, 0.25))
        scale = b0 * (1.0 - shape)
        cutoff = max(u + _gpd_quantile(scale, shape, share, risk), 1.2 * float(kx.max()))
        grown = x[x <= cutoff]
        if not len(grown) or grown.max() <= cap:
            break
        cap = float(grown.max())
    return float(cutoff)


def _gpd_quantile(scale: float, shape: float, share: float, risk: float) -> float:
    if abs(shape) < 1e-6:
        return scale * np.log(share / risk)
    return scale / shape * ((risk / share) ** -shape - 1.0)


def stuck_length(lengths: np.ndarray, n: np.ndarray, risk: float = RUN_RISK) -> float:
    """Run length from which a source's runs are stuck, not its natural repeats.

    The chance that a reading repeats is estimated from the runs themselves (share
    of runs that go on; for sources that stand still by nature, from their median
    run), and the length is that which all its runs would reach by chance with `risk`.
    """
    total = n.sum()
    order = np.argsort(lengths)
    lengths, n = lengths[order], n[order]
    median = lengths[np.searchsorted(np.cumsum(n), 0.5 * total)]
    go_on = n[lengths >= 2].sum() / total
    p = max(go_on, 1.0 - 1.0 / median) if median > 1 else go_on
    if p <= 0.0:
        return STUCK_FROM
    if p >= 1.0:
        return np.inf
    return max(STUCK_FROM, 1 + int(np.ceil(np.log(risk / total) / np.log(p))))


_CUT_SCHEMA = "kind string, source string, center double, cutoff double"


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    kind, source = pdf["kind"].iloc[0], pdf["source"].iloc[0]
    pdf = pdf.sort_values("bin")
    b, n = pdf["bin"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
    center = 0.0
    if kind.startswith("stuck"):
        cutoff = stuck_length(b, n)
    elif kind == "scatter":
        cutoff = max(LEAST_SCATTERS, gpd_cutoff(np.exp((b + 0.5) / BINS), n))
    else:
        per = PRICE_BINS if kind == "level" else BINS
        x = (b + 0.5) / per
        center = float(x[np.searchsorted(np.cumsum(n), 0.5 * n.sum())])
        away = np.abs(x - center) if kind == "level" else np.maximum(x - center, 0.0)
        order = np.argsort(away, kind="stable")
        cutoff = gpd_cutoff(away[order], n[order])
    return pd.DataFrame({"kind": [kind], "source": [source], "center": [center], "cutoff": [cutoff]})


def cutoffs(histogram: DataFrame) -> DataFrame:
    """(kind, source, center, cutoff) from bins (kind, source, bin, n)."""
    summed = histogram.groupBy("kind", "source", "bin").agg(F.sum("n").alias("n"))
    return summed.groupBy("kind", "source").applyInPandas(_fit, _CUT_SCHEMA)


def impossible(value: Column) -> Column:
    """Zero, negative, infinite or not a number."""
    v = value.cast("double")
    return F.isnan(v) | (v <= 0) | (v == float("inf"))


def log_bins(df: DataFrame, kind: str, source: str, value: str, per: int) -> DataFrame:
    """Counts of log values by source."""
    good = df.where(F.col(source).isNotNull() & F.col(value).isNotNull() & ~impossible(F.col(value)))
    return (
        good.groupBy(F.lit(kind).alias("kind"), F.col(source).alias("source"), F.floor(F.log(value) * per).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sequence_residuals(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scatters, side) of log prices in order: distance from the local median over the local scatter."""
    s = pd.Series(price)
    away = (s - s.rolling(9, center=True, min_periods=1).median()).to_numpy()
    step = s.diff().abs()
    step[step == 0.0] = np.nan  # a source that stands still is measured by the steps it takes
    usual = float(np.nanmedian(step)) if step.notna().any() else 0.0
    local = step.rolling(101, center=True, min_periods=10).median().fillna(usual).to_numpy()
    scale = np.maximum(np.maximum(local, 0.25 * usual), 1e-12)
    return np.abs(away) / scale, np.sign(away)


def _runs(equal_to_previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of its run, position in it) of each element."""
    start = np.flatnonzero(~equal_to_previous)
    length = np.diff(np.append(start, len(equal_to_previous)))
    return np.repeat(length, length), np.arange(len(equal_to_previous)) - np.repeat(start, length)


_ROWS = "kind string, source string, row_key bigint, value double, bin bigint, n bigint"


def _sequence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates and bin counts of segments (source, seg, row_key, price, size, own), sorted by order."""
    schema = pa.schema([("kind", pa.string()), ("source", pa.string()), ("row_key", pa.int64()), ("value", pa.float64()), ("bin", pa.int64()), ("n", pa.int64())])

    def rows(kind, source, keys=None, values=None, bins=None, n=None) -> pa.RecordBatch:
        size = len(keys if keys is not None else bins)
        nulls = pa.nulls(size)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * size, pa.string()),
                pa.array([source] * size, pa.string()),
                pa.array(keys, pa.int64()) if keys is not None else nulls.cast(pa.int64()),
                pa.array(values, pa.float64()) if values is not None else nulls.cast(pa.float64()),
                pa.array(bins, pa.int64()) if bins is not None else nulls.cast(pa.int64()),
                pa.array(n, pa.int64()) if n is not None else nulls.cast(pa.int64()),
            ],
            schema=schema,
        )

    def segment(source: str, seg: int, key: np.ndarray, price: np.ndarray, size: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.append(True, key[1:] != key[:-1])  # delivered again: same key, same time
        key, price, size, own = key[first], price[first], size[first], own[first]
        with np.errstate(invalid="ignore"):
            good = np.isfinite(price) & (price > 0)
        k, o = key[good], own[good]
        if len(k):
            z, side = sequence_residuals(np.log(price[good]))
            high = z >= LEAST_SCATTERS
            same = np.append(False, high[1:] & high[:-1] & (side[1:] == side[:-1]))
            length, _ = _runs(same)
            spike = high & (length <= LONGEST_SPIKE) & o
            yield rows("scatter", source, k[spike], z[spike])
            bins, n = np.unique(np.floor(np.log(np.maximum(z[o], 1e-3)) * BINS).astype(np.int64), return_counts=True)
            yield rows("scatter_bins", source, bins=bins, n=n)
        for name, v in (("price", price[own]), ("size", size[own])):
            there = ~np.isnan(v)
            k, v = key[own][there], v[there]
            if not len(k):
                continue
            length, position = _runs(np.append(False, v[1:] == v[:-1]))
            first, last = np.arange(len(v)) < length[0], np.arange(len(v)) >= len(v) - length[-1]
            inner = ~first & ~last
            held = inner & (length >= STUCK_FROM) & (position > 0)
            yield rows(f"stuck_{name}", source, k[held], length[held].astype(float))
            lengths, n = np.unique(length[inner & (position == 0)], return_counts=True)
            yield rows(f"stuck_{name}_bins", source, bins=lengths, n=n)
            whole = bool(first[-1])
            for part, where in ((0, first), (2, last))[: 1 if whole else 2]:
                size_ = int(where.sum())
                yield rows(f"edge_{name}", source, k[where], v[where], np.full(size_, 3 * seg + (1 if whole else part)), position[where])

    held_at, parts = None, []

    def close():
        if held_at is not None:
            yield from segment(*held_at, *(np.concatenate(p) for p in zip(*parts, strict=True)))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes = batch.column(0).dictionary_encode()
        index, seg = codes.indices.to_numpy(), batch.column(1).to_numpy()
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
        cols[1], cols[2] = cols[1].astype(float), cols[2].astype(float)
        cuts = np.flatnonzero((np.diff(index) != 0) | (np.diff(seg) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(index)], strict=True):
            at = (codes.dictionary[int(index[lo])].as_py(), int(seg[lo]))
            if at != held_at:
                yield from close()
                held_at, parts = at, []
            parts.append([c[lo:hi] for c in cols])
    yield from close()


def sequence_outliers(df: DataFrame, source: str, order: str, key: str, price: str, size: str, slot: int, rows: int = 100_000) -> DataFrame:
    """(row_key, field) of spikes in `price` and stuck readings of `price` and `size` in each source's order.

    Nulls and NaN meet as missing inside the sequence: a NaN is a case of its own
    (`impossible`) and, like a null, neither ends nor extends a run.
    """
    ready = df.select(
        F.col(source).alias("source"), F.col(order).alias("ord"), F.col(key).alias("row_key"), F.col(price).cast("double").alias("price"), F.col(size).cast("double").alias("size")
    ).where("row_key is not null")
    parts = (
        segmented(ready, "source", "ord", slot, rows)
        .repartition("source", "seg")
        .sortWithinPartitions("source", "seg", "ord", "row_key")
        .select("source", "seg", "row_key", "price", "size", "own")
    )
    out = materialise(parts.mapInArrow(_sequence_batches, _ROWS), "readings")
    edge = out.where("kind like 'edge_%'").withColumn("kind", F.regexp_replace("kind", "^edge", "stuck"))
    islands = carried_runs(edge.groupBy("kind", "source", "bin").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("length")))
    bins = out.where("kind like '%_bins'").select(F.regexp_replace("kind", "_bins$", "").alias("kind"), "source", "bin", "n")
    limits = cutoffs(bins.unionByName(island_bins(islands))).drop("center")
    long = islands.where(F.col("total") >= STUCK_FROM)
    over_edges = edge.join(long, ["kind", "source", "bin"]).where("not (begins and n = 0)").select("kind", "source", "row_key", F.col("total").cast("double").alias("value"))
    reached = out.where("row_key is not null and kind not like 'edge_%'").select("kind", "source", "row_key", "value").unionByName(over_edges).join(limits, ["kind", "source"])
    over = (F.col("kind") == "scatter") & (F.col("value") > F.col("cutoff")) | (F.col("kind") != "scatter") & (F.col("value") >= F.col("cutoff"))
    return reached.where(over).select("row_key", F.when(F.col("kind") == "stuck_size", "size").otherwise("price").alias("field"))


def carried_runs(pieces: DataFrame) -> DataFrame:
    """pieces (kind, source, bin, value, length) of runs at segment edges, with the run's `total` and whether it `begins` here.

    bin is 3 * segment + 0 for the first run of a segment, + 2 for its last, + 1 for one that fills it.
    A piece goes on where the piece before it reaches the end of its segment with the same value.
    There are two pieces a segment at most.
    """
    by_source = Window.partitionBy("kind", "source").orderBy("bin")
    goes_on = (F.pmod("bin", F.lit(3)) < 2) & (F.pmod(F.lag("bin").over(by_source), F.lit(3)) > 0) & F.lag("value").over(by_source).eqNullSafe(F.col("value"))
    marked = pieces.withColumn("begins", ~F.coalesce(goes_on, F.lit(False)))
    run = F.sum(F.col("begins").cast("long")).over(by_source)
    return marked.withColumn("run", run).withColumn("total", F.sum("length").over(Window.partitionBy("kind", "source", "run"))).drop("value", "length", "run")


def island_bins(islands: DataFrame) -> DataFrame:
    return islands.where("begins").select("kind", "source", F.col("total").alias("bin"), F.lit(1).cast("bigint").alias("n"))


def level_outliers(df: DataFrame, kind: str, source: str, value: str) -> DataFrame:
    """Rows whose value lies beyond their source's cutoff: 'level' on both sides of the median, else above it."""
    per = PRICE_BINS if kind == "level" else BINS
    limits = cutoffs(log_bins(df, kind, source, value, per)).select(F.col("source").alias(source), "center", "cutoff")
    away = F.log(value) - F.col("center")
    away = F.abs(away) if kind == "level" else away
    good = df.where(F.col(value).isNotNull() & ~impossible(F.col(value)))
    return good.join(limits, source).where(away > F.col("cutoff") + F.lit(1.0 / per)).drop("center", "cutoff")


def stuck_readings(df: DataFrame, sources: list[str], order: str, key: str, value: str, slot: int, rows: int = 100_000) -> DataFrame:
    """Rows of `df` within a stuck run of `value`, the first of the run excepted; all in JVM windows.

    How long a run must be follows from the runs of all its sources[-1] (a ticker over all accounts): eight, or longer where it stands still by nature.
    """
    whole = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("source", F.concat_ws("\x1f", *sources))
    seg = segmented(whole, "source", order, slot, rows, halo=0).where("own")
    part = Window.partitionBy("source", "seg")
    w = part.orderBy(order, key)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    run = seg.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).withColumn("_last", F.max("_run").over(part))
    run = run.withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy("source", "seg", "_run")))
    at = F.when((F.col("_run") == 1) & (F.col("_last") == 1), 1).when(F.col("_run") == 1, 0).when(F.col("_run") == F.col("_last"), 2)
    run = materialise(run.withColumn("bin", 3 * F.col("seg") + at), "runs")
    starts = run.where("_new = 1")
    pieces = starts.where("bin is not null").select(F.lit("stuck_fill").alias("kind"), "source", "bin", F.col(value).alias("value"), F.col("_length").alias("length"))
    islands = carried_runs(pieces)
    owner = F.element_at(F.split("source", "\x1f"), -1)
    inner = starts.where("bin is null").groupBy("source", F.col("_length").alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("stuck_fill").alias("kind"), "source", "bin", "n")
    limits = cutoffs(inner.unionByName(island_bins(islands)).withColumn("source", owner)).select(F.col("source").alias("_owner"), "cutoff")
    # only runs of eight or more are looked at further
    over_edges = run.where("bin is not null").join(islands.drop("kind").where(F.col("total") >= STUCK_FROM), ["source", "bin"]).where("not (begins and _new = 1)")
    inside = run.where((F.col("_length") >= STUCK_FROM) & F.col("bin").isNull() & (F.col("_new") == 0)).withColumn("total", F.col("_length"))
    held = inside.select(*df.columns, "source", "total").unionByName(over_edges.select(*df.columns, "source", "total")).withColumn("_owner", owner)
    return held.join(limits, "_owner").where(F.col("total") >= F.col("cutoff")).select(*df.columns)
