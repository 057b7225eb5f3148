from __future__ import annotations

import datetime as dt
import os

import pandas as pd
import pytest

from tidemark.plans import streams
from tidemark.streaming.order_book import Book, replay


def event(kind, first, last, prev, bids, asks=((101.0, 1.0),)):
    return {"kind": kind, "first_id": first, "last_id": last, "prev_id": prev, "ts": last, "bids": list(bids), "asks": list(asks)}


def feed(book, *events):
    return [s for e in events for _, s in book.feed(e)]


def test_levels_are_set_and_deleted():
    b = Book()
    assert feed(b, event("snapshot", 10, 10, None, [(99.0, 1.0), (98.0, 2.0), (97.0, 0.0)])) == ["snapshot"]
    assert feed(b, event("diff", 9, 11, 8, [(99.0, 0.0), (98.5, 3.0)], [])) == ["ok"]
    assert b.top() == (98.5, 3.0, 101.0, 1.0, 3)


def test_first_difference_must_span_the_snapshot():
    b = Book()
    feed(b, event("snapshot", 10, 10, None, [(99.0, 1.0)]))
    assert feed(b, event("diff", 5, 10, 4, [])) == []  # old
    assert feed(b, event("diff", 13, 14, 12, [])) == ["gap"]
    assert not b.seeded and b.top()[4] == 0


def test_gap_waits_for_the_next_snapshot():
    b = Book()
    feed(b, event("snapshot", 1, 1, None, [(99.0, 1.0)]), event("diff", 2, 2, 1, []))
    assert feed(b, event("diff", 5, 5, 4, [])) == ["gap"]
    assert feed(b, event("diff", 6, 6, 5, [(98.0, 1.0)])) == []
    assert feed(b, event("snapshot", 5, 5, None, [(97.0, 1.0)])) == ["snapshot", "ok"]
    assert b.top()[0] == 98.0


def test_differences_before_any_snapshot_wait():
    b = Book()
    assert feed(b, event("diff", 11, 11, 10, [(99.5, 1.0)])) == []
    assert feed(b, event("snapshot", 10, 10, None, [(99.0, 1.0)])) == ["snapshot", "ok"]
    again = Book.load(b.dump())
    assert again.top() == b.top() and again.last_id == 11


def test_replay_orders_a_batch():
    frame = pd.DataFrame([event("diff", 11, 11, 10, [(99.5, 1.0)]), event("snapshot", 10, 10, None, [(99.0, 1.0)])])
    for c in ("bids", "asks"):
        frame[c] = frame[c].map(lambda x: [{"px": p, "sz": s} for p, s in x])
    out = replay("S", iter([frame]), Book())
    assert list(out.status) == ["snapshot", "ok"] and list(out.bid_px) == [99.0, 99.5]
    assert len(replay("S", iter([]), Book())) == 0


@pytest.mark.parametrize("query", ["stream_sessions", "stream_deduplicate"])
def test_replay_of_files_in_no_time_order(spark, tmp_path, query):
    """Twelve files, the newest day first: what comes in later batches is behind the clock, but no row is lost."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for name in ("events", "trade_events"):
        (tmp_path / f"{name}.parquet").mkdir()
    for f, day in enumerate([*range(11, -1, -1)]):
        at = [start + dt.timedelta(days=3 * day, hours=8 * k) for k in range(3)]
        frames = {
            "events": pd.DataFrame({"event_id": range(3 * f, 3 * f + 3), "user_id": 1, "event_type": "x", "ts": at, "value": 1.0}),
            "trade_events": pd.DataFrame({"agg_trade_id": [3 * f, 3 * f, 3 * f + 1], "symbol": "S", "exchange_ts_ns": [int(a.timestamp()) * 10**9 for a in (at[0], at[0], at[1])]}),
        }
        for name, frame in frames.items():
            path = tmp_path / f"{name}.parquet" / f"part-{f:02d}.parquet"
            frame.astype({"ts": "datetime64[us, UTC]"} if "ts" in frame else {}).to_parquet(path, index=False)
            os.utime(path, (1_700_000_000 + f, 1_700_000_000 + f))
    got = streams.QUERIES[query](spark, str(tmp_path)).toPandas()
    assert got["n"].sum() == (36 if query == "stream_sessions" else 24) and len(got) == (36 if query == "stream_sessions" else 1)
