"""Order books from a stream of snapshots and differences, with gaps as data.

Events of a symbol: a snapshot seeds the book; a difference replaces sizes at
prices (0 removes the level).  The first difference after a snapshot must span
the snapshot's id + 1, each later one must name its predecessor's last id;
differences that end at or before the snapshot are dropped, those that come before any
snapshot wait for one.  A break of the chain is no exception: it emits a gap row,
clears the book and waits for the next snapshot.

State is one book per symbol; arrivals of a batch are ordered by their last id, a snapshot before differences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = (
    "symbol string, kind string, first_id bigint, last_id bigint, prev_id bigint, ts bigint, "
    "bids array<struct<px:double,sz:double>>, asks array<struct<px:double,sz:double>>"
)
OUT_SCHEMA = "symbol string, last_id bigint, ts bigint, status string, bid_px double, bid_sz double, ask_px double, ask_sz double, n_levels int"
OUT_COLUMNS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


@dataclass
class Book:
    """One symbol's book and where it stands in the chain of updates."""

    bids: dict[float, float] = field(default_factory=dict)
    asks: dict[float, float] = field(default_factory=dict)
    last_id: int = -1
    seeded: bool = False
    fresh: bool = False
    waiting: list[dict] = field(default_factory=list)

    def seed(self, event: dict) -> None:
        self.bids = {px: sz for px, sz in event["bids"] if sz > 0}
        self.asks = {px: sz for px, sz in event["asks"] if sz > 0}
        self.last_id, self.seeded, self.fresh = event["last_id"], True, True

    def apply(self, event: dict) -> str:
        """ok, old (dropped) or gap (the book is cleared)."""
        if event["last_id"] <= self.last_id:
            return "old"
        linked = event["first_id"] <= self.last_id + 1 <= event["last_id"] if self.fresh else event["prev_id"] == self.last_id
        if not linked:
            self.bids, self.asks, self.seeded, self.last_id = {}, {}, False, -1
            return "gap"
        for side, levels in ((self.bids, event["bids"]), (self.asks, event["asks"])):
            for px, sz in levels:
                if sz == 0:
                    side.pop(px, None)
                else:
                    side[px] = sz
        self.last_id, self.fresh = event["last_id"], False
        return "ok"

    def feed(self, event: dict) -> Iterator[tuple[dict, str]]:
        """(event, status) of every event that this one settles."""
        if event["kind"] == "snapshot":
            if self.seeded and event["last_id"] <= self.last_id:
                return
            self.seed(event)
            yield event, "snapshot"
            waiting, self.waiting = self.waiting, []
            for w in waiting:
                yield from self.feed(w)
        elif not self.seeded:
            self.waiting.append(event)
        else:
            status = self.apply(event)
            if status != "old":
                yield event, status

    def top(self) -> tuple:
        bid, ask = max(self.bids, default=None), min(self.asks, default=None)
        return bid, self.bids.get(bid), ask, self.asks.get(ask), len(self.bids) + len(self.asks)

    def dump(self) -> str:
        return json.dumps([list(self.bids.items()), list(self.asks.items()), self.last_id, self.seeded, self.fresh, self.waiting])

    @staticmethod
    def load(text: str) -> "Book":
        bids, asks, last_id, seeded, fresh, waiting = json.loads(text)
        return Book(dict(map(tuple, bids)), dict(map(tuple, asks)), last_id, seeded, fresh, waiting)


def _levels(cell) -> list[tuple[float, float]]:
    return [(float(x["px"]), float(x["sz"])) for x in cell] if cell is not None else []


def replay(symbol: str, frames: Iterator[pd.DataFrame], book: Book) -> pd.DataFrame:
    """Feeds a batch of events to a book; one row per applied event or gap."""
    out = []
    held = [f for f in frames if len(f)]
    if not held:
        return pd.DataFrame(columns=OUT_COLUMNS)
    events = pd.concat(held)
    events["_diff"] = events["kind"] != "snapshot"
    for r in events.sort_values(["last_id", "_diff"], kind="stable").itertuples():
        prev = None if pd.isna(r.prev_id) else int(r.prev_id)
        event = {"kind": r.kind, "first_id": int(r.first_id), "last_id": int(r.last_id), "prev_id": prev, "ts": int(r.ts), "bids": _levels(r.bids), "asks": _levels(r.asks)}
        for e, status in book.feed(event):
            bid, bid_sz, ask, ask_sz, n = book.top()
            out.append((symbol, e["last_id"], e["ts"], status, bid, bid_sz, ask, ask_sz, n))
    return pd.DataFrame(out, columns=OUT_COLUMNS)


def books(events: DataFrame, segment: str | None = None) -> DataFrame:
    """Top of the book after every event of a stream (EVENT_SCHEMA), and its gaps.

    With `segment`, a column that tells which snapshot an event follows, every segment is a book of its
    own: snapshots are restart points, so a symbol is spread over as many state groups as it has snapshots.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book.load(state.get[0]) if state.exists else Book()
        out = replay(key[0], frames, book)
        state.update((book.dump(),))
        yield out

    keys = ["symbol"] + ([segment] if segment else [])
    return events.groupBy(*keys).applyInPandasWithState(step, OUT_SCHEMA, "book string", "append", GroupStateTimeout.NoTimeout)
