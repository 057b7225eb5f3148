"""Rolling totals over trailing periods, by a two-stack monoid queue per entity.

A queue that keeps an aggregate under push and pop holds two stacks: the back
stack has running aggregates of what came in, the front stack those of what
will leave, and the window's aggregate is front + back.  Over a dense calendar a
window of w days moves by one day a step, so the stacks flip every w days: the
front stack is the block's suffix aggregates, the back stack the next block's
prefix aggregates.  Both are computed for a whole entity at a time
(``sliding``); ``TwoStackQueue`` is the same queue step by step for monoids given
as a Python function.  Nothing is ever subtracted, so minima, maxima and other
non-invertible aggregates work, and sums lose no precision.

Defined cases: rows without entity or day are left out; null and NaN values count
as missing; an entity's calendar runs from its first to its last row of any
kind; a window without values has count 0, total, average, minimum and maximum
null; repeated rows of a day are all part of it; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TwoStackQueue:
    """FIFO queue with the aggregate of its content in O(1) amortised, for any monoid."""

    def __init__(self, combine: Callable, identity) -> None:
        self.combine, self.identity = combine, identity
        self.front: list[tuple] = []  # (value, aggregate of it and all that came later)
        self.back: list[tuple] = []  # (value, aggregate of all up to it)

    def push(self, value) -> None:
        before = self.back[-1][1] if self.back else self.identity
        self.back.append((value, self.combine(before, value)))

    def pop(self):
        if not self.front:
            total = self.identity
            while self.back:
                value, _ = self.back.pop()
                total = self.combine(value, total)
                self.front.append((value, total))
        return self.front.pop()[0]

    def total(self):
        front = self.front[-1][1] if self.front else self.identity
        back = self.back[-1][1] if self.back else self.identity
        return self.combine(front, back)


def sliding(values: np.ndarray, window: int, op: np.ufunc, identity: float) -> np.ndarray:
    """Aggregate of the `window` values ending at each position, both stacks at once.

    values: (days,) or (days, columns); days before the first count as `identity`.
    """
    n = len(values)
    if n == 0:
        return values.copy()
    blocks = -(-(n + window - 1) // window)
    padded = np.full((blocks * window, *values.shape[1:]), identity, dtype=values.dtype)
    padded[window - 1 : window - 1 + n] = values
    by_block = padded.reshape(blocks, window, *values.shape[1:])
    back = op.accumulate(by_block, axis=1).reshape(padded.shape)
    front = op.accumulate(by_block[:, ::-1], axis=1)[:, ::-1].reshape(padded.shape)
    start = np.arange(n)
    whole = start % window == 0  # the front stack is empty: the window is one block
    out = op(front[start], back[start + window - 1])
    out[whole] = back[start[whole] + window - 1]
    return out


def parse_day(text: Column) -> Column:
    """Day of a text that spells year, month and day in this order, with or without a time of day."""
    apart = F.regexp_extract(text, r"^\s*(\d{4})\s*[-/. ]\s*(\d{1,2})\s*[-/. ]\s*(\d{1,2})(?!\d)", 0)
    tight = F.regexp_extract(text, r"^\s*(\d{8})(?!\d)", 1)
    spelled = F.when(apart != "", F.regexp_replace(F.regexp_replace(F.trim(apart), r"\s+", ""), r"[/.]", "-")).when(
        tight != "", F.concat_ws("-", F.substring(tight, 1, 4), F.substring(tight, 5, 2), F.substring(tight, 7, 2))
    )
    return spelled.try_cast("date")


_OUT = (
    "entity string, day date, metric string, window_days bigint, n_values bigint, "
    "total double, average double, minimum double, maximum double"
)


def _emit(metrics: list[str], windows: list[int]):
    """Rolls sorted (entity, day number, then count, total, min, max of each metric) partitions."""
    k = len(metrics)
    schema = pa.schema(
        [("entity", pa.string()), ("day", pa.date32()), ("metric", pa.string()), ("window_days", pa.int64()), ("n_values", pa.int64())]
        + [(c, pa.float64()) for c in ("total", "average", "minimum", "maximum")]
    )

    def entity_rows(name: str, days: np.ndarray, parts: np.ndarray) -> Iterator[dict]:
        first, n = int(days[0]), int(days[-1] - days[0]) + 1
        at = days - first
        dense = {
            "count": (np.add, 0.0, parts[:, 0::4]),
            "total": (np.add, 0.0, parts[:, 1::4]),
            "minimum": (np.minimum, np.inf, parts[:, 2::4]),
            "maximum": (np.maximum, -np.inf, parts[:, 3::4]),
        }
        calendar = np.arange(first, first + n, dtype=np.int32)
        for w in windows:
            rolled = {}
            for what, (op, identity, values) in dense.items():
                filled = np.full((n, k), identity)
                filled[at] = np.where(np.isnan(values), identity, values)
                rolled[what] = sliding(filled, w, op, identity)
            for m in range(k):
                count = rolled["count"][:, m]
                yield {"entity": name, "day": calendar, "metric": metrics[m], "window_days": w, "n_values": count.astype(np.int64)} | {
                    c: rolled[c][:, m] for c in ("total", "minimum", "maximum")
                }

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        lengths = [len(r["day"]) for r in rows]

        def labels(key: str) -> pa.Array:
            names = list(dict.fromkeys(r[key] for r in rows))
            index = {x: i for i, x in enumerate(names)}
            codes = np.repeat([index[r[key]] for r in rows], lengths)
            return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(names, pa.string())).dictionary_decode()

        count = np.concatenate([r["n_values"] for r in rows])
        empty = count == 0
        total = np.concatenate([r["total"] for r in rows])
        columns = [
            labels("entity"),
            pa.array(np.concatenate([r["day"] for r in rows]), pa.int32()).cast(pa.date32()),
            labels("metric"),
            pa.array(np.repeat([r["window_days"] for r in rows], lengths), pa.int64()),
            pa.array(count),
            pa.array(total, mask=empty),
            pa.array(total / np.maximum(count, 1), mask=empty),
            pa.array(np.concatenate([r["minimum"] for r in rows]), mask=empty),
            pa.array(np.concatenate([r["maximum"] for r in rows]), mask=empty),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_name, held_days, held_parts = None, [], []
        ready: list[dict] = []

        def close() -> None:
            if held_name is not None:
                ready.extend(entity_rows(held_name, np.concatenate(held_days), np.concatenate(held_parts)))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = batch.column(0).dictionary_encode()
            index = codes.indices.to_numpy()
            days = batch.column(1).to_numpy()
            parts = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(2, 2 + 4 * k)])
            cuts = np.flatnonzero(np.diff(index)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(index)], strict=True):
                name = codes.dictionary[int(index[lo])].as_py()
                if name != held_name:
                    close()
                    held_name, held_days, held_parts = name, [], []
                held_days.append(days[lo:hi])
                held_parts.append(parts[lo:hi])
            if sum(len(r["day"]) for r in ready) > 50_000:
                yield batch_of(ready)
                ready.clear()
        close()
        if ready:
            yield batch_of(ready)

    return run


def rolling_periods(df: DataFrame, entity: str, day: Column, metrics: list[str], windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per entity, calendar day, metric and window, days without rows included.

    The rows are first aggregated per entity and day (map-side too), so a hot entity
    brings at most one row a day to its partition; `day` is a DATE expression.
    """
    clean = df.select(
        F.col(entity).cast("string").alias("entity"),
        day.alias("day"),
        *[F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(f"m{i}") for i, m in enumerate(metrics)],
    ).where("entity is not null and day is not null")
    parts = []
    for i in range(len(metrics)):
        parts += [F.count(f"m{i}"), F.sum(f"m{i}"), F.min(f"m{i}"), F.max(f"m{i}")]
    daily = clean.groupBy("entity", F.unix_date("day").alias("day")).agg(*[p.alias(f"p{j}") for j, p in enumerate(parts)])
    ordered = daily.repartition("entity").sortWithinPartitions("entity", "day")
    return ordered.mapInArrow(_emit(list(metrics), list(windows)), _OUT)


def latest_state(df: DataFrame, keys: dict[str, Column], version: str, values: list[str]) -> DataFrame:
    """Of several rows of a key the one with the greatest `version`; ties go to the greatest values."""
    state = F.max(F.struct(F.col(version), *[F.col(v) for v in values])).alias("state")
    grouped = df.select(*[c.alias(n) for n, c in keys.items()], version, *values).groupBy(*keys).agg(state)
    return grouped.select(*keys, *[F.col(f"state.{v}").alias(v) for v in values])
