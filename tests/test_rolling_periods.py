from __future__ import annotations

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.rolling_periods import TwoStackQueue, latest_state, parse_day, rolling_periods, sliding

NUMBERS = st.lists(st.floats(-1e6, 1e6), min_size=0, max_size=60)


@settings(max_examples=60, deadline=None)
@given(NUMBERS, st.integers(1, 20))
def test_sliding_is_brute_force(values, window):
    v = np.array(values, dtype=float)
    for op, identity, plain in ((np.add, 0.0, np.sum), (np.minimum, np.inf, np.min), (np.maximum, -np.inf, np.max)):
        got = sliding(v, window, op, identity)
        want = [plain(v[max(0, i - window + 1) : i + 1]) for i in range(len(v))]
        assert np.allclose(got, want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=2), max_size=40), st.integers(1, 9))
def test_queue_keeps_order_for_any_monoid(values, window):
    q = TwoStackQueue(lambda a, b: a + b, "")
    for i, v in enumerate(values):
        q.push(v)
        if i >= window:
            assert q.pop() == values[i - window]
        assert q.total() == "".join(values[max(0, i - window + 1) : i + 1])


def test_calendar_nulls_and_repeats(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), 1.0), ("a", d(2024, 1, 1), 2.0), ("a", d(2024, 1, 10), None), ("a", d(2024, 1, 3), float("nan")), ("b", d(2024, 2, 29), None), (None, d(2024, 1, 1), 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "who string, d date, v double, entity string")
    out = {(r.entity, str(r.day)): r for r in rolling_periods(df, "who", F.col("d"), ["v"], (7,)).collect()}
    assert len(out) == 11
    assert out["a", "2024-01-07"].total == 3.0 and out["a", "2024-01-07"].average == 1.5 and out["a", "2024-01-07"].minimum == 1.0
    assert out["a", "2024-01-08"].n_values == 0 and out["a", "2024-01-08"].total is None and out["a", "2024-01-08"].maximum is None
    assert out["b", "2024-02-29"].n_values == 0


def test_empty(spark):
    df = spark.createDataFrame([], "who string, d date, v double")
    assert rolling_periods(df, "who", F.col("d"), ["v"]).count() == 0


def test_days_as_spelled(spark):
    texts = {"2024-01-05": 5, "2024/01/05": 5, "20240105": 5, "2024-01-05T10:00:00": 5, " 2024-1-5": 5, "2024.01.05 09:00": 5, "2024-02-30": None, "x": None, "202401051": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    got = {r.t: r.d for r in df.select("t", parse_day(F.col("t")).alias("d")).collect()}
    assert {k: v and v.day for k, v in got.items()} == texts


def test_latest_state_wins(spark):
    t = dt.datetime
    df = spark.createDataFrame([("a", t(2024, 1, 1), 1.0), ("a", t(2024, 1, 2), None), ("a", None, 5.0)], "k string, at timestamp, v double")
    assert latest_state(df, {"k": F.col("k")}, "at", ["v"]).first().v is None
