"""Revisions of member lists: sorted once, each compared with its predecessor where it lies.

Revisions are range-partitioned and sorted by page and number, in one shuffle of the raw
texts.  A partition then streams: each revision is parsed once and compared with the
one before it, and a page that holds much of the table lies in as many partitions
as it needs.  Only the pairs that straddle two partitions remain: every partition
gives out its first and last revision, and those few are paired and compared apart.

``schema_changes`` gives what drifted (see schema_drift), ``member_changes`` what was
added, removed or changed (see snapshot_diff).

Defined cases: repeated rows count once; of rows with the same page and revid but
different texts the greatest non-null text holds; null, empty or table-less
texts are passed over, and so are rows without page or revid; an empty input
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import schema_drift as drift
from tidemark.operators.snapshot_diff import classify, unmatched_rows
from tidemark.session import materialise, predecessor
from tidemark.sources import wikitext as wt

#: Lists are short, so a change should not drag many neighbours along.
CHUNK_MEMBERS = 4


class Parsed:
    """A revision's member table; what is derived from it is computed once for both of its pairs."""

    def __init__(self, headers: list[str], cells: list[list[str]]) -> None:
        self.headers, self.cells = headers, cells

    @cached_property
    def keyed(self) -> dict[str, list[list[str]]]:
        return _keyed(self.headers, self.cells)

    @cached_property
    def schema(self) -> drift.Node:
        return drift.table_schema(self.headers, self.cells)

    @cached_property
    def at(self) -> dict[str, int]:
        return {c.name: c.position for c in self.schema.children}


def _parse(text: str | None) -> Parsed | None:
    table = wt.parse_member_table(text)
    return Parsed(*table) if table else None


def _keyed(headers: list[str], cells: list[list[str]]) -> dict[str, list[list[str]]]:
    """Distinct rows by key; the key cell in its normal form."""
    key = next(i for i, h in enumerate(headers) if h in wt.KEY_HEADERS)
    rows: dict[str, list[list[str]]] = {}
    for r in cells:
        k = wt.key_of(r[key])
        if k is not None:
            r = [*r]
            r[key] = k
            held = rows.setdefault(k, [])
            if r not in held:
                held.append(r)
    return rows


def compare_schemas(old: Parsed, new: Parsed) -> list[drift.Step]:
    """The edit script between two parsed revisions; content is compared over shared members."""
    before, after, at_a, at_b = old.keyed, new.keyed, old.at, new.at
    shared = [k for k in before if k in after]

    def same(path_a: tuple, path_b: tuple) -> float:
        i, j = at_a[path_a[-1]], at_b[path_b[-1]]
        x = [(before[k][0][i], after[k][0][j]) for k in shared]
        x = [(p, q) for p, q in x if p or q]
        if x:
            return sum(p == q for p, q in x) / len(x)
        p, q = {r[i] for r in old.cells if r[i]}, {r[j] for r in new.cells if r[j]}
        return len(p & q) / max(1, len(p | q)) if not shared else 0.0

    return drift.edit_script(old.schema, new.schema, same)


def _schema_rows(old: Parsed, new: Parsed) -> Iterator[tuple]:
    """(change_kind, old_header, new_header) of a pair."""
    for s in compare_schemas(old, new):
        if s.kind in ("added", "removed", "renamed", "retyped"):
            yield s.kind, "".join(s.old), "".join(s.new)


def _member_rows(old: Parsed, new: Parsed) -> Iterator[tuple]:
    """(side, key, content) of the rows in chunks whose digests the other side lacks, on the fields both share."""
    steps = sorted((s for s in compare_schemas(old, new) if s.kind in ("kept", "renamed")), key=lambda s: s.old)
    sides = []
    for table, path in ((old, "old"), (new, "new")):
        take = [table.at[getattr(s, path)[-1]] for s in steps]
        sides.append(sorted((k, "\x1e".join(sorted({"\x1f".join([r[i] for i in take]) for r in rs}))) for k, rs in table.keyed.items()))
    yield from unmatched_rows(*sides, every=CHUNK_MEMBERS)


#: A result row of a pair in three text columns, or an edge: a partition's first or last revision with its text.
_OUT = "page_id bigint, revid bigint, part int, a string, b string, c string, text string"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("revid", pa.int64()), ("part", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("text", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _stream(compare: Callable[[Parsed, Parsed], Iterator[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (page_id, revid, wikitext) sorted by all three."""
        part = TaskContext.get().partitionId()
        held, last, first_out = None, None, False  # held: the newest row of its page and revid, not yet settled
        out: list[tuple] = []

        def settle() -> None:
            """Parses the held revision and compares it with the last one that had a table."""
            nonlocal last, first_out
            if held is None:
                return
            page, revid, text = held
            parsed = _parse(text)
            if parsed is None:
                return
            if last is not None and last[0] == page:
                out.extend((page, revid, None, *(str(x) for x in row), None) for row in compare(last[3], parsed))
            if not first_out:
                out.append((page, revid, part, None, None, None, text))
                first_out = True
            last = (page, revid, text, parsed)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held is not None and held[:2] != row[:2]:
                    settle()
                held = row
            if len(out) > 5000:
                yield _batch(out)
                out.clear()
        settle()
        if last is not None:
            out.append((last[0], last[1], part, None, None, None, last[2]))
        yield _batch(out)

    return run


def _edge_pairs(edges: DataFrame) -> DataFrame:
    """(page_id, revid, old text, text) of neighbouring edges that lie in different partitions."""
    one = edges.groupBy("page_id", "revid").agg(F.max("part").alias("part"), F.max("text").alias("text"))
    follow = predecessor(one.select("page_id", "revid", "part"), "page_id", "revid", "prev", width=1 << 20).where("prev is not null")
    old = one.select("page_id", F.col("revid").alias("prev"), F.col("part").alias("old_part"), F.col("text").alias("old_text"))
    across = follow.join(old, ["page_id", "prev"]).where("part <> old_part").drop("part")
    return across.join(one.select("page_id", "revid", "text"), ["page_id", "revid"]).select("page_id", "revid", "old_text", "text")


def _compare_edges(compare: Callable[[Parsed, Parsed], Iterator[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, revid, old, new in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows = compare(_parse(old), _parse(new))
                out.extend((page, revid, None, *(str(x) for x in row), None) for row in rows)
            yield _batch(out)

    return run


def pairwise(revisions: DataFrame, compare: Callable[[Parsed, Parsed], Iterator[tuple]]) -> DataFrame:
    """(page_id, revid, a, b, c): what `compare` says of each revision and the one before it on its page."""
    ready = revisions.select("page_id", "revid", "wikitext").where("page_id is not null and revid is not null and wikitext is not null")
    ordered = ready.repartitionByRange("page_id", "revid").sortWithinPartitions("page_id", "revid", "wikitext")
    done = materialise(ordered.mapInArrow(_stream(compare), _OUT), "revisions")
    columns = ["page_id", "revid", "a", "b", "c"]
    inside = done.where("part is null").select(*columns)
    across = _edge_pairs(done.where("part is not null")).mapInArrow(_compare_edges(compare), _OUT).select(*columns)
    return inside.unionByName(across)


def schema_changes(revisions: DataFrame) -> DataFrame:
    """(revid, change_kind, old_header, new_header) of each change of columns between revisions."""
    return pairwise(revisions, _schema_rows).select("revid", F.col("a").alias("change_kind"), F.col("b").alias("old_header"), F.col("c").alias("new_header"))


def member_changes(revisions: DataFrame) -> DataFrame:
    """(revid, cik, change_kind) of members added, removed or changed between revisions."""
    rows = pairwise(revisions, _member_rows)
    sides = rows.select(F.struct("page_id", "revid").alias("pair"), F.col("a").cast("int").alias("side"), F.col("b").alias("key"), F.col("c").alias("content"))
    return classify(sides).select(F.col("pair.revid").alias("revid"), F.col("key").alias("cik"), "change_kind")


#: A revision's table, or an edge.  `fields` are the names of its columns but key and ticker, a member is [key, ticker, *cells];
#: `epoch` is the revision of the partition since which the headers are the same, and there `old` and `new` are the columns kept or renamed.
_TABLES = "page_id bigint, revid bigint, part int, epoch bigint, fields array<string>, old array<string>, new array<string>, members array<array<string>>, text string"
_TEXTS = pa.list_(pa.string())
_TABLE_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("revid", pa.int64()), ("part", pa.int32()), ("epoch", pa.int64()), ("fields", _TEXTS), ("old", _TEXTS), ("new", _TEXTS), ("members", pa.list_(_TEXTS)), ("text", pa.string())]
)
#: Members in an Arrow batch of tables.
BATCH_MEMBERS = 5000


def _field_columns(table: Parsed) -> dict[str, int]:
    """Name and position of each column but key and ticker."""
    ticker = next(i for i, h in enumerate(table.headers) if h in wt.TICKER_HEADERS)
    return {c.name: c.position for c in table.schema.children if c.position != ticker and table.headers[c.position] not in wt.KEY_HEADERS}


def _carried(old: Parsed, new: Parsed) -> Iterator[tuple[str, str, str]]:
    """(kind, old name, new name) of the fields that both revisions have, also under another header or type."""
    before, after = _field_columns(old), _field_columns(new)
    for s in compare_schemas(old, new):
        if s.kind in ("kept", "retyped", "renamed") and s.old[-1] in before and s.new[-1] in after:
            yield s.kind, s.old[-1], s.new[-1]


def _stream_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, revid, wikitext) sorted by all three; each revision is compared where its headers differ from those before."""
    part = TaskContext.get().partitionId()
    held, last, first_out, epoch = None, None, False, None
    out: list[tuple] = []
    waiting = 0

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_TABLE_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TABLE_SCHEMA, strict=True)], schema=_TABLE_SCHEMA)

    def settle() -> None:
        nonlocal last, first_out, epoch, waiting
        if held is None:
            return
        page, revid, text = held
        parsed = _parse(text)
        if parsed is None:
            return
        old = new = None
        if last is None or last[0] != page:
            epoch = revid
        elif last[3].headers != parsed.headers:
            epoch = revid
            carried = list(_carried(last[3], parsed))
            old, new = [o for _, o, _ in carried], [n for _, _, n in carried]
        columns = _field_columns(parsed)
        ticker = next(i for i, h in enumerate(parsed.headers) if h in wt.TICKER_HEADERS)
        members = [[k, r[ticker], *(r[i] for i in columns.values())] for k, rs in parsed.keyed.items() for r in rs]
        out.append((page, revid, None, epoch, list(columns), old, new, members, None))
        waiting += 1 + len(members)
        if not first_out:
            out.append((page, revid, part, None, None, None, None, None, text))
            first_out = True
        last = (page, revid, text, parsed)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held is not None and held[:2] != row[:2]:
                settle()
                if waiting > BATCH_MEMBERS:
                    yield batch_of()
                    out.clear()
                    waiting = 0
            held = row
    settle()
    if last is not None:
        out.append((last[0], last[1], part, None, None, None, None, None, last[2]))
    yield batch_of()


def _same_columns(steps: DataFrame) -> dict[str, str]:
    """Header to the one name it goes by on all pages: headers that a rename joins anywhere, the most frequent renames first.

    Headers that stand side by side in a table are different columns and are never joined.
    The driver holds the distinct headers that were ever renamed, and their pairs.
    """
    pairs = steps.where("old is not null").select(F.explode(F.arrays_zip("old", "new")).alias("p")).select("p.old", "p.new").where("old <> new")
    renames = pairs.groupBy(F.least("old", "new").alias("a"), F.greatest("old", "new").alias("b")).count().collect()
    if not renames:
        return {}
    known = steps.sparkSession.createDataFrame([(h,) for h in sorted({h for r in renames for h in (r.a, r.b)})], "h string")
    tables = steps.select(F.array_sort("fields").alias("fields")).distinct().withColumn("t", F.monotonically_increasing_id())
    tables = materialise(tables.select("t", F.explode("fields").alias("h")).join(F.broadcast(known), "h"), "headers")
    beside = {(r.h, r.g) for r in tables.join(tables.withColumnRenamed("h", "g"), "t").where("h < g").select("h", "g").distinct().collect()}
    group: dict[str, set[str]] = {}
    for r in sorted(renames, key=lambda r: (-r["count"], r.a, r.b)):
        x, y = group.setdefault(r.a, {r.a}), group.setdefault(r.b, {r.b})
        if x is not y and not any((min(p, q), max(p, q)) in beside for p in x for q in y):
            x |= y
            group.update(dict.fromkeys(y, x))
    return {h: min(g) for h, g in group.items()}


def _projections(same: dict[str, str]):
    def run(page: pa.Table) -> pa.Table:
        """The unified names of each epoch's fields: the page's scripts chained, then the name all pages share."""
        epochs = sorted(page.to_pylist(), key=lambda r: r["epoch"])
        schemas = [drift.table_schema(r["fields"], []) for r in epochs]
        scripts = []
        for r in epochs[1:]:
            carried = list(zip(r["old"] or [], r["new"] or [], strict=True))
            fresh = [n for n in r["fields"] if n not in (r["new"] or [])]
            scripts.append([drift.Step("kept" if o == n else "renamed", (o,), (n,)) for o, n in carried] + [drift.Step("added", (), (n,)) for n in fresh])
        _, chained = drift.unify(schemas, scripts)
        clash = set()  # columns of one table that would go by the same name keep the page's
        for names in chained:
            at: dict[str, list[str]] = {}
            for n in names.values():
                at.setdefault(same.get(n, n), []).append(n)
            clash |= {n for ns in at.values() if len(ns) > 1 for n in ns}
        unified = [[n if n in clash else same.get(n, n) for n in (names[f] for f in r["fields"])] for r, names in zip(epochs, chained, strict=True)]
        return pa.table({"page_id": [r["page_id"] for r in epochs], "epoch": [r["epoch"] for r in epochs], "unified": pa.array(unified, _TEXTS)}, schema=pa.schema([("page_id", pa.int64()), ("epoch", pa.int64()), ("unified", _TEXTS)]))

    return run


def unified_members(revisions: DataFrame) -> DataFrame:
    """Every revision's members as one consistent table.

    The edit scripts of a page's revisions are chained into a projection for every
    stretch of equal headers, so a renamed column stays one field; pages that spell a column
    differently are brought together by the renames seen on any page.  Key and ticker are
    found by their headers.  Since the number of fields is open, they come as a map.
    """
    ready = revisions.select("page_id", "revid", "wikitext").where("page_id is not null and revid is not null and wikitext is not null")
    ordered = ready.repartitionByRange("page_id", "revid").sortWithinPartitions("page_id", "revid", "wikitext")
    done = materialise(ordered.mapInArrow(_stream_tables, _TABLES), "tables")
    across = _edge_pairs(done.where("part is not null")).mapInArrow(_compare_edges(_carried), _OUT)
    across = across.groupBy("page_id", F.col("revid").alias("epoch")).agg(F.collect_list(F.struct("b", "c")).alias("s"))
    steps = done.where("part is null and epoch = revid").select("page_id", "epoch", "fields", "old", "new").join(across, ["page_id", "epoch"], "left")
    steps = materialise(steps.select("page_id", "epoch", "fields", F.coalesce("old", "s.b").alias("old"), F.coalesce("new", "s.c").alias("new")), "steps")
    projections = steps.groupBy("page_id").applyInArrow(_projections(_same_columns(steps)), "page_id bigint, epoch bigint, unified array<string>")
    tables = done.where("part is null").select("page_id", "revid", "epoch", "members").join(projections, ["page_id", "epoch"])
    rows = tables.select("page_id", "revid", "unified", F.explode("members").alias("m"))
    return rows.select("page_id", "revid", F.col("m")[0].alias("cik"), F.col("m")[1].alias("ticker"), F.map_from_arrays("unified", F.slice("m", 3, F.size("unified"))).alias("fields"))
