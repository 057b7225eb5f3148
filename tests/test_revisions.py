from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import revisions, schema_drift, snapshot_diff
from tidemark.session import predecessor
from tidemark.sources import wikitext as wt

PAGE = """Intro <ref>a\n| b</ref>
{| class="wikitable"
! Date !! Added
|-
| 5 May || X
|}
{| class="wikitable sortable" id="constituents"
|+ caption<ref name=a />
! [[Ticker symbol]] !! '''Security''' !! scope="col" | CIK:
! [[Founded (finance)|Founded]]
|-
| {{NyxSymbol|AB}} || [[Big Co. (company)|Big Co.]]<!-- x --> || 0000000012 || 1990<ref>Filing
| page 2</ref>
|- style="background:#eee"
| align="left" | [[CD]]
| Small & Sons
| 34
|}
"""


def test_visible_text():
    headers, rows = wt.parse_member_table(PAGE)
    assert headers == ["ticker symbol", "security", "cik", "founded"]
    assert rows == [["AB", "Big Co.", "0000000012", "1990"], ["CD", "Small & Sons", "34", ""]]
    assert wt.key_of("34") == "0000000034" and wt.key_of("x") is None


@pytest.mark.parametrize("text", [None, "", "  ", "{|\n|-\n| a\n|}", "no table", "{| \n! Date !! Added\n|-\n| 1 || 2\n|}", "{|", "|}", "<ref>"])
def test_texts_without_a_member_table(text):
    assert wt.parse_member_table(text) is None


def table(headers, rows):
    return "{|\n! " + " !! ".join(headers) + "\n" + "".join("|-\n| " + " || ".join(r) + "\n" for r in rows) + "|}"


def run(spark, texts):
    df = spark.createDataFrame([(1, i, t, "clash") for i, t in texts], "page_id bigint, revid bigint, wikitext string, headers string")
    changes = {(r.revid, r.cik, r.change_kind) for r in revisions.member_changes(df).collect()}
    drift = {(r.revid, r.change_kind, r.old_header, r.new_header) for r in revisions.schema_changes(df).collect()}
    return changes, drift


def test_changes_between_revisions(spark):
    h = ["Ticker", "Name", "CIK", "Year"]
    a = [["A", "Alpha", "1", "1990"], ["B", "Beta", "2", "1991"], ["C", "Gamma", "3", "1992"]]
    b = [["C", "Gamma", "0000000003", "c. 1992"], ["B", "Beta!", "2", "c. 1991"], ["D", "Delta", "4", "c. 1993"], ["D", "Delta", "4", "c. 1993"]]
    c = [[r[1], r[0], r[2], "x"] for r in b]
    texts = [(5, table(h, a)), (7, None), (9, table(h, b)), (9, table(h, b)), (11, ""), (12, table(["Company", "Symbol", "CIK", "Auditor"], c))]
    changes, drift = run(spark, texts)
    key = "{:010d}".format
    assert changes == {(9, key(1), "removed"), (9, key(4), "added"), (9, key(2), "changed")}
    assert drift == {(9, "retyped", "year", "year"), (12, "renamed", "name", "company"), (12, "renamed", "ticker", "symbol"), (12, "removed", "year", ""), (12, "added", "", "auditor")}


def test_empty_input(spark):
    df = spark.createDataFrame([], "page_id bigint, revid bigint, wikitext string")
    assert revisions.member_changes(df).count() == 0 and revisions.schema_changes(df).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, more, rng):
    m = n + more
    cost = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
    got = schema_drift.assign(cost)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    assert len(set(got)) == n and abs(sum(cost[i, j] for i, j in enumerate(got)) - best) < 1e-9


def test_nested_schemas(spark):
    from pyspark.sql import types as T

    old = T._parse_datatype_string("id bigint, a struct<x:int,y:string>, gone int, kind int")
    new = T._parse_datatype_string("kind string, id bigint, b struct<x:int,y:string,z:int>, fresh int")
    same = lambda p, q: 0.0
    steps = schema_drift.edit_script(schema_drift.struct_schema(old), schema_drift.struct_schema(new), same)
    found = {(s.kind, ".".join(s.old), ".".join(s.new)) for s in steps}
    assert ("retyped", "kind", "kind") in found and ("removed", "gone", "") in found and ("added", "", "fresh") in found
    assert ("renamed", "a", "b") in found and ("added", "", "b.z") in found and ("moved", "id", "id") in found
    df = spark.createDataFrame([("7", 1, (1, "s", 2), 3)], new)
    row = df.select(*schema_drift.compile_projection(steps, old)).first()
    assert row.id == 1 and row.kind == 7 and row.gone is None


def test_unified_columns():
    a, b, c = (schema_drift.table_schema(h, []) for h in (["x", "y"], ["x2", "y"], ["x2", "z"]))
    same = lambda p, q: 1.0 if {p[-1], q[-1]} == {"x", "x2"} else 0.0
    scripts = [schema_drift.edit_script(a, b, same), schema_drift.edit_script(b, c, same)]
    columns, projections = schema_drift.unify([a, b, c], scripts)
    assert columns == ["x", "y", "z"] and projections[2] == {"x2": "x", "z": "z"}


@settings(max_examples=10, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.integers(0, 3), max_size=120), st.dictionaries(st.integers(0, 300), st.integers(0, 3), max_size=120))
def test_snapshot_diff_is_brute_force(spark, a, b):
    def frame(d):
        return spark.createDataFrame([(k, v, "e") for k, v in d.items()], "k int, v int, content string")

    got = {(int(r.key), r.change_kind) for r in snapshot_diff.snapshot_diff(frame(a), frame(b), ["k"], ["v"], 3).collect()}
    want = {(k, "added") for k in b if k not in a} | {(k, "removed") for k in a if k not in b} | {(k, "changed") for k in a if k in b and a[k] != b[k]}
    assert got == want


def test_chunks_survive_insertions():
    rows = [(f"{i:05d}", "v") for i in range(2000)]
    digests = {d for d, _ in snapshot_diff.chunk_rows(rows)}
    moved = {d for d, _ in snapshot_diff.chunk_rows(sorted([*rows, ("00500x", "v")]))}
    assert len(digests - moved) == 1


def test_predecessor_is_lag(spark):
    rows = [(k, v) for k in (1, 2) for v in range(0, 1000, 7 * k)]
    df = spark.createDataFrame(rows, "k int, v bigint")
    got = {(r.k, r.v): r.p for r in predecessor(df, "k", "v", "p", width=50).collect()}
    for k in (1, 2):
        vs = sorted(v for q, v in rows if q == k)
        assert [got[k, v] for v in vs] == [None, *vs[:-1]]


def test_pairs_across_partitions(spark):
    """With a partition for every few revisions, what straddles them is found too."""
    h = ["Ticker", "Name", "CIK"]
    rows, want = [], set()
    for page in range(3):
        for k in range(40):
            members = [["A", "Alpha", "1"]] + [["B", f"Beta{k // 2}", "2"]]
            rows.append((page, page * 1000 + k, None if k % 7 == 3 else table(h, members)))
        there = [k for k in range(40) if k % 7 != 3]
        want |= {(page * 1000 + b, "0000000002", "changed") for a, b in zip(there, there[1:]) if a // 2 != b // 2}
    df = spark.createDataFrame(rows, "page_id bigint, revid bigint, wikitext string")
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "25"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {(r.revid, r.cik, r.change_kind) for r in revisions.member_changes(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_unified_members_follow_renames(spark):
    """A renamed column stays one field: in a page, over partitions, after a gap, and between pages that start with different spellings."""
    spellings = {1: ["Founded", "Year founded", "Founded", "Year founded"], 2: ["Year founded", "Year founded", "Founded", "Founded"], 3: ["Year founded"] * 4}
    rows = []
    for page, names in spellings.items():
        for k, name in enumerate(x for n in names for x in [n] * 5):
            h, m = ["Ticker", "Name", "CIK", name], [["A", "Alpha", "1", "1990"], ["B", "Beta", "2", "1991"]]
            if page == 1 and k == 12:
                h, m = h[:3], [r[:3] for r in m]
            rows.append((page, page * 1000 + k, table(h, m)))
    df = spark.createDataFrame(rows, "page_id bigint, revid bigint, wikitext string")
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "25"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {(r.revid, r.cik): (r.ticker, r.fields) for r in revisions.unified_members(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for _, revid, _ in rows:
        for cik, ticker, name, year in (("0000000001", "A", "Alpha", "1990"), ("0000000002", "B", "Beta", "1991")):
            want[revid, cik] = (ticker, {"name": name} | ({} if revid == 1012 else {"founded": year}))
    assert got == want


def test_columns_side_by_side_stay_apart(spark):
    """A rename between two headers that another page shows side by side joins them on its own page only."""
    a = [["A", "1", "x", "p"], ["B", "2", "y", "q"]]
    rows = [(1, 1, table(["Ticker", "CIK", "Staff"], [r[:3] for r in a])), (1, 2, table(["Ticker", "CIK", "Employees"], [r[:3] for r in a])), (2, 3, table(["Ticker", "CIK", "Staff", "Employees"], a))]
    df = spark.createDataFrame(rows, "page_id bigint, revid bigint, wikitext string")
    got = {(r.revid, r.ticker): r.fields for r in revisions.unified_members(df).collect()}
    assert got[1, "A"] == got[2, "A"] == {"staff": "x"} and got[3, "A"] == {"staff": "x", "employees": "p"}
    assert revisions.unified_members(df.limit(0)).count() == 0
