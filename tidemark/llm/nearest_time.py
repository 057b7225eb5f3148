"""Matching records by nearest time, by expanding rings.

Both tables are put into coarse time blocks per entity (rows within the tolerance of a
block's edge go to the neighbour as well), with one shuffle and one sort; a hot
entity is spread over as many tasks as it has blocks.  Inside a partition the rings
run over all its blocks at once.  A ring is an equi-join on buckets: the right rows'
occupied buckets with their first and last row are the one side, the left rows not yet
resolved, by their own and the two adjacent buckets, the other.  A left row only sees rows
of these three buckets; it takes the nearest of them if that is no farther than the
bucket is wide, for then nothing outside can be nearer.  The others go on to buckets of
twice the width, until these are as wide as the tolerance.  Of the adjacent buckets only the
row next to the left row is read, in its own bucket a bisection between the bucket's
first and last row finds the neighbours, so a bucket with many rows costs little more
than one with few, and the finest buckets, which resolve most rows, need a step or two.

Defined cases: rows without entity, time or id take no part; of two equally near
rows the earlier one is taken, of several at the same time the one with the
smallest id; repeated left ids give one row, the nearest; left rows without a match
within the tolerance give none; empty tables give no rows.  Further columns of the
right table can be carried along under a prefix, so names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A coarse block is so many tolerances wide: 1.6 % of the right rows are copied over an edge.
BLOCK = 128
#: The first ring's buckets are the tolerance over this.
FINEST = 8
_CHUNK = 200_000


def _bucket_join(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted bucket among the sorted occupied ones, whether it is occupied)."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def ring(at: np.ndarray, r: np.ndarray, width: np.int64) -> tuple[np.ndarray, np.ndarray, int]:
    """One ring: (nearest row of the three buckets around each left time or -1, distance, bisection steps); r is sorted."""
    bucket = r // width
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends, keys = np.append(starts[1:], len(r)), bucket[starts]
    own = at // width
    far = np.int64(1) << 62
    none = np.full(len(at), -1, np.int64)
    before = np.where((hit := _bucket_join(keys, own - 1))[1], ends[hit[0]] - 1, none)
    after = np.where((hit := _bucket_join(keys, own + 1))[1], starts[hit[0]], none)
    place, there = _bucket_join(keys, own)
    rows = np.flatnonzero(there)
    low, high, steps = starts[place[rows]], ends[place[rows]], 0
    first, last = low.copy(), high.copy()
    while (undecided := low < high).any():  # the first row of the own bucket after the left time
        steps += 1
        middle = (low + high) >> 1
        later = r[np.minimum(middle, len(r) - 1)] > at[rows]
        high = np.where(undecided & later, middle, high)
        low = np.where(undecided & ~later, middle + 1, low)
    before[rows] = np.where(low > first, low - 1, before[rows])
    after[rows] = np.where(low < last, low, after[rows])
    d_before = np.where(before >= 0, at - r[np.maximum(before, 0)], far)
    d_after = np.where(after >= 0, r[np.maximum(after, 0)] - at, far)
    return np.where(d_before <= d_after, before, after), np.minimum(d_before, d_after), steps


def ring_match(left: np.ndarray, right: np.ndarray, block: np.ndarray, right_block: np.ndarray, tolerance: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the matched right row or -1, distance) of each left row.

    right must be sorted by (right_block, right); times are relative to their block,
    within [-tolerance, width of the block + tolerance].  `seen`, if given, gets (width, left
    rows, of these resolved, bisection steps) of every ring.
    """
    span = np.int64((BLOCK + 4) * tolerance)
    shift = np.int64(tolerance * 2)
    t, r = block * span + left + shift, right_block * span + right + shift
    found = np.full(len(left), -1, dtype=np.int64)
    distance = np.full(len(left), -1, dtype=np.int64)
    if not len(r):
        return found, distance
    earliest = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), np.arange(len(r)), 0))  # the smallest id at a time
    open_rows = np.arange(len(left))
    width = np.int64(max(1, tolerance // FINEST))
    while len(open_rows):
        width = min(width, np.int64(tolerance))
        best, d, steps = ring(t[open_rows], r, width)
        sure = d <= width  # nearer than anything outside the three buckets
        rows = open_rows[sure]
        found[rows] = earliest[best[sure]]
        distance[rows] = d[sure]
        if seen is not None:
            seen.append((int(width), len(open_rows), len(rows), steps))
        if width >= tolerance:
            break
        open_rows, width = open_rows[~sure], width * 2
    return found, distance


def _ring_batches(tolerance: int, carried: int):
    def match(parts: list[list[pa.Array]]) -> pa.RecordBatch | None:
        columns = [pa.concat_arrays([p[i] for p in parts]) for i in range(len(parts[0]))]
        side, time, row, block = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
        is_left = side == 0
        l_i, r_i = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        order = np.lexsort((row[r_i], time[r_i], block[r_i]))
        r_i = r_i[order]
        found, distance = ring_match(time[l_i], time[r_i], block[l_i], block[r_i], tolerance)
        hit = found >= 0
        if not hit.any():
            return None
        chosen = r_i[found[hit]]
        take = pa.array(chosen)
        arrays = [pa.array(row[l_i[hit]]), pa.array(row[chosen]), pa.array(distance[hit])] + [c.take(take) for c in columns[4 : 4 + carried]]
        return pa.RecordBatch.from_arrays(arrays, names=["left_id", "right_id", "distance"] + [f"c{i}" for i in range(carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (entity, coarse, side, time, id, carried...) sorted by (entity, coarse)."""
        parts: list[list[pa.Array]] = []
        size, number, last = 0, 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = batch.column(0).dictionary_encode()
            index, coarse = codes.indices.to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(index) != 0) | (np.diff(coarse) != 0)) + 1
            starts = np.array([0, *cuts])
            key = (codes.dictionary[int(index[0])].as_py(), int(coarse[0]))
            if last is not None and key == last:
                base = number
            else:
                if size >= _CHUNK:
                    out = match(parts)
                    if out is not None:
                        yield out
                    parts, size = [], 0
                base = number + 1
            numbers = base + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
            number = int(numbers[-1])
            last = (codes.dictionary[int(index[-1])].as_py(), int(coarse[-1]))
            parts.append([batch.column(2), batch.column(3), batch.column(4), pa.array(numbers), *[batch.column(5 + i) for i in range(carried)]])
            size += batch.num_rows
        if parts:
            out = match(parts)
            if out is not None:
                yield out

    return run


def nearest_time(
    left: DataFrame,
    right: DataFrame,
    by: str,
    time: str,
    left_id: str,
    right_id: str,
    tolerance: int,
    carry: tuple[str, ...] = (),
    prefix: str = "right_",
) -> DataFrame:
    """(left_id, right_id, distance, prefix + carry...) of the nearest right row of each left row.

    `by` and `time` (whole units, such as ns) are columns of both tables, the ids whole numbers.
    """
    width = BLOCK * tolerance
    names = [f"c{i}" for i in range(len(carry))]

    def ready(df: DataFrame, side: int, row: str, extra: list) -> DataFrame:
        known = df.where(F.col(by).isNotNull() & F.col(time).isNotNull() & F.col(row).isNotNull())
        return known.select(
            F.col(by).cast("string").alias("entity"), F.floor(F.col(time) / F.lit(width)).cast("long").alias("coarse"), F.lit(side).alias("side"),
            F.col(time).cast("long").alias("time"), F.col(row).cast("long").alias("id"), *extra,
        )

    types = dict(right.dtypes)
    a = ready(left, 0, left_id, [F.lit(None).cast(types[c]).alias(n) for c, n in zip(carry, names, strict=True)])
    b = ready(right, 1, right_id, [F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    inside = F.col("time") - F.col("coarse") * F.lit(width)
    near = F.array_compact(F.array(F.lit(0), F.when(inside < tolerance, -1), F.when(inside >= width - tolerance, 1)))
    b = b.withColumn("coarse", F.explode(F.transform(near, lambda k: F.col("coarse") + k)))
    rows = a.unionByName(b).withColumn("time", F.col("time") - F.col("coarse") * F.lit(width))
    placed = rows.repartition("entity", "coarse").sortWithinPartitions("entity", "coarse")
    fields = ["left_id bigint", "right_id bigint", "distance bigint"] + [f"{n} {types[c]}" for n, c in zip(names, carry, strict=True)]
    matched = placed.mapInArrow(_ring_batches(tolerance, len(carry)), ", ".join(fields))
    best = matched.groupBy("left_id").agg(F.min(F.struct("distance", "right_id", *names)).alias("m"))  # repeated left rows
    return best.select(
        F.col("left_id").alias(left_id), F.col("m.right_id").alias(right_id), F.col("m.distance").alias("distance"),
        *[F.col(f"m.{n}").alias(prefix + c) for n, c in zip(names, carry, strict=True)],
    )
