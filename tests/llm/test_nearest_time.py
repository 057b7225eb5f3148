from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.nearest_time import nearest_time, ring, ring_match

TIMES = st.lists(st.integers(0, 128 * 40 - 1), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TIMES, TIMES, st.sampled_from([1, 5, 40]))
def test_rings_are_brute_force(left, right, tolerance):
    span = 128 * tolerance
    left, right = np.array([x % span for x in left], dtype=np.int64), np.sort(np.array([x % span for x in right], dtype=np.int64))
    zero = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    found, distance = ring_match(left, right, *zero, tolerance)
    for i, t in enumerate(left):
        gaps = [(abs(int(t - r)), int(r), j) for j, r in enumerate(right) if abs(t - r) <= tolerance]
        if gaps:
            best = min(gaps)
            assert found[i] == best[2] and distance[i] == best[0]
        else:
            assert found[i] == -1


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("tolerance", [3, 50])
def test_join_against_brute_force(spark, tolerance):
    rng = np.random.default_rng(tolerance)
    left = [(i, "abh"[min(2, i % 7)], int(t)) for i, t in enumerate(rng.integers(0, 40_000, 400))]
    right = [(i, "abh"[min(2, i % 5)], int(t), float(i)) for i, t in enumerate(rng.integers(0, 40_000, 900))]
    extra_left = [(400, None, 5), (401, "a", None), (None, "a", 5), (0, left[0][1], left[0][2])]
    extra_right = [(900, None, 5, 0.0), (901, "a", None, 0.0), *right[:50]]
    a = frame(spark, [(*r, "x") for r in left + extra_left], "lid bigint, k string, t bigint, distance string")
    b = frame(spark, right + extra_right, "rid bigint, k string, t bigint, distance double")
    got = {r.lid: (r.rid, r["distance"], r.right_distance) for r in nearest_time(a, b, "k", "t", "lid", "rid", tolerance, ("distance",)).collect()}
    want = {}
    for i, k, t in left:
        near = [(abs(t - q), q, j) for j, kk, q, _ in right if kk == k and abs(t - q) <= tolerance]
        if near:
            d, _, j = min(near)
            want[i] = (j, d, float(j))
    assert got == want


def test_empty_tables(spark):
    a = frame(spark, [(1, "a", 5)], "lid bigint, k string, t bigint")
    none = frame(spark, [], "rid bigint, k string, t bigint")
    assert nearest_time(a, none, "k", "t", "lid", "rid", 10).count() == 0
    assert nearest_time(none.withColumnRenamed("rid", "lid"), a.withColumnRenamed("lid", "rid"), "k", "t", "lid", "rid", 10).count() == 0


def test_ties_go_to_the_earlier_and_the_smaller_id(spark):
    a = frame(spark, [(1, "a", 10)], "lid bigint, k string, t bigint")
    b = frame(spark, [(7, "a", 12), (9, "a", 8), (8, "a", 8)], "rid bigint, k string, t bigint")
    assert nearest_time(a, b, "k", "t", "lid", "rid", 10).first().rid == 8


def test_each_ring_resolves_what_its_buckets_prove_and_passes_on_the_rest():
    rng = np.random.default_rng(3)
    tolerance = 800
    left, right = rng.integers(0, 128 * tolerance, 3000), np.sort(rng.integers(0, 128 * tolerance, 120))
    zero = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    seen: list = []
    found, distance = ring_match(left, right, *zero, tolerance, seen)
    nearest = np.abs(left[:, None] - right[None]).min(axis=1)
    assert [w for w, *_ in seen] == [100, 200, 400, 800]
    open_rows = len(left)
    for (width, n, resolved, steps), narrower in zip(seen, [-1, 100, 200, 400], strict=True):
        assert n == open_rows and resolved == ((nearest > narrower) & (nearest <= width)).sum() > 0
        open_rows -= resolved
    assert (found >= 0).sum() == (nearest <= tolerance).sum()
    # the last ring alone would have to bisect wider buckets for every row
    _, _, steps = ring(left + 2 * tolerance, right + 2 * tolerance, np.int64(tolerance))
    assert steps > seen[0][3]


def test_a_ring_sees_its_three_buckets_only():
    best, d, _ = ring(np.array([250]), np.array([90, 410]), np.int64(100))
    assert best[0] == -1 and d[0] > 1000  # buckets 1 to 3 hold nothing
    best, d, _ = ring(np.array([250]), np.array([90, 410]), np.int64(200))
    assert best[0] == 0 or best[0] == 1
