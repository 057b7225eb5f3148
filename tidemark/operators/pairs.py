"""Statistics of all pairs of names from sums of products over dates; pairs of rows are never formed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def universe(panel: DataFrame) -> list[str]:
    """The names of a panel (date, ticker, value), in order; one row a name."""
    return sorted(r.ticker for r in panel.where("ticker is not null").select("ticker").distinct().collect())


def centred(panel: DataFrame) -> DataFrame:
    """Values less their name's mean: no statistic of a pair changes, and no sum cancels."""
    mean = F.avg("value").over(Window.partitionBy("ticker"))
    return panel.where("date is not null and ticker is not null and value is not null").select("date", "ticker", (F.col("value") - mean).alias("value"))


_GRAMS = {"n": "MM", "y": "LM", "yy": "QM", "xy": "LL", "pn": "PP", "y1": "AP", "y0": "BP", "y10": "CP", "y1x0": "AB", "y00": "DP", "x0y0": "BB", "y11": "EP", "x1y1": "AA"}


def pair_sums(panel: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """Sums over dates for all pairs of names: {statistic: (names, names)}, y of the row, x of the column.

    panel: (date, ticker, value).  Each task adds up products of its dates' blocks (dates x names), so what
    travels is names x names, whatever the number of rows; values 1 and 0 mark a date and the one before it.
    """
    day = Window.orderBy("date")  # one row a date
    wide = panel.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "value"))).alias("now"))
    wide = wide.withColumn("before", F.lag("now").over(day)).repartition(8, "date")
    at = {n: i for i, n in enumerate(names)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            now, before = (np.full((len(frame), len(names)), np.nan) for _ in range(2))
            for grid, column in ((now, "now"), (before, "before")):
                for r, cells in enumerate(frame[column]):
                    for name, value in (cells or {}).items():
                        grid[r, at[name]] = value
            m = ~np.isnan(now)
            p = m & ~np.isnan(before)
            z = {"M": m.astype(float), "L": np.where(m, now, 0.0), "P": p.astype(float), "A": np.where(p, now, 0.0), "B": np.where(p, before, 0.0)}
            z |= {"Q": z["L"] ** 2, "C": z["A"] * z["B"], "D": z["B"] ** 2, "E": z["A"] ** 2}
            for name, (a, b) in _GRAMS.items():
                total[name] = total.get(name, 0.0) + z[a].T @ z[b]
        for name, sums in total.items():
            yield pd.DataFrame({"name": name, "i": range(len(names)), "sums": list(sums)})

    out = {name: np.zeros((len(names), len(names))) for name in _GRAMS}
    for r in wide.mapInPandas(run, "name string, i int, sums array<double>").toLocalIterator():
        out[r.name][r.i] += r.sums
    return out


def dickey_fuller(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hedge ratio, t statistic, observations) of the residual of each y on each x, from pair_sums."""
    n, y, x = g["n"], g["y"], g["y"].T
    with np.errstate(divide="ignore", invalid="ignore"):
        b = (g["xy"] - y * x / n) / (g["yy"].T - x * x / n)
        a = (y - b * x) / n
        k = g["pn"]
        y1, x1, y0, x0 = g["y1"], g["y1"].T, g["y0"], g["y0"].T
        v, u = y1 - a * k - b * x1, y0 - a * k - b * x0
        uv = g["y10"] - a * (y1 + y0) - b * (g["y1x0"] + g["y1x0"].T) + a * a * k + a * b * (x0 + x1) + b * b * g["y10"].T
        uu = g["y00"] + a * a * k + b * b * g["y00"].T - 2 * a * y0 - 2 * b * g["x0y0"] + 2 * a * b * x0
        vv = g["y11"] + a * a * k + b * b * g["y11"].T - 2 * a * y1 - 2 * b * g["x1y1"] + 2 * a * b * x1
        d, du, dd = v - u, uv - uu, vv - 2 * uv + uu
        sxx, sxy, syy = uu - u * u / k, du - d * u / k, dd - d * d / k
        slope = sxy / sxx
        t = slope / np.sqrt((syy - slope * sxy) / (k - 2) / sxx)
    return b, t, k


def correlations(g: dict[str, np.ndarray]) -> np.ndarray:
    """Correlation of each pair over its common dates, from pair_sums."""
    n, y, x = g["n"], g["y"], g["y"].T
    with np.errstate(divide="ignore", invalid="ignore"):
        return (g["xy"] - y * x / n) / np.sqrt((g["yy"] - y * y / n) * (g["yy"].T - x * x / n))
