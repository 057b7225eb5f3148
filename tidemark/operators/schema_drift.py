"""Schemas that drift between files: edit scripts, change report, one consistent table.

A schema is a tree: the table, its columns, and for nested types their fields.
Two schemas are compared by the constrained unordered tree edit distance: a
node of one tree is matched with at most one of the other, children are matched
within matched parents, and each level is a minimum-cost assignment (solved
exactly).  A pair of nodes costs nothing if the headers agree (a change of type
is then reported as ``retyped``), and by its difference in content otherwise; an
unmatched node costs one for its deletion or insertion and one for each node
below it.  A matched pair whose position differs is a ``moved`` step, which
leaves the data alone.  The script compiles into a projection of the new file
onto the old one's columns.

Defined cases: a schema without columns gives only additions; duplicate headers
are told apart by position; columns without a non-empty cell have type
``unknown``, which is never a change of type; content decides only between
different headers, and a rename needs more than ``min_same`` of the rows that
both files share to agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

_WHOLE = re.compile(r"[0-9]+\Z")
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+\Z")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\Z")


def column_type(cells: list[str]) -> str:
    """whole, decimal, date or text: the type of more than half of the non-empty cells."""
    filled = [c for c in cells if c]
    if not filled:
        return "unknown"
    for name, pattern in (("whole", _WHOLE), ("decimal", _DECIMAL), ("date", _DATE)):
        if 2 * sum(1 for c in filled if pattern.match(c)) > len(filled):
            return name
    return "text"


@dataclass
class Node:
    """One column or field: its header, type, children, and position among its siblings."""

    name: str
    kind: str = "unknown"
    children: list["Node"] = field(default_factory=list)
    position: int = 0

    @property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)


@dataclass(frozen=True)
class Step:
    """One step of an edit script; paths are tuples of headers from the root."""

    kind: str  # kept, added, removed, renamed, retyped, moved
    old: tuple[str, ...]
    new: tuple[str, ...]


def assign(cost: np.ndarray) -> list[int]:
    """Exact minimum-cost assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least = np.full(m + 1, np.inf)
        way, done = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[j0] = True
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            open_ = ~done[1:]
            better = open_ & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            candidates = np.where(open_, least[1:], np.inf)
            j1 = int(candidates.argmin()) + 1
            delta = candidates[j1 - 1]
            np.add.at(u, owner[done], delta)
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    result = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            result[owner[j] - 1] = j - 1
    return result


def edit_script(old: Node, new: Node, same_content, min_same: float = 0.5) -> list[Step]:
    """Minimum-cost script from old to new.

    same_content(old_path, new_path) is the share of common rows on which two
    leaf columns agree (0 if unknown).
    """
    memo: dict[tuple[int, int], tuple[float, list]] = {}

    def pair_cost(a: Node, b: Node, pa: tuple, pb: tuple) -> float:
        inner = match(a, b, pa, pb)[0]
        if a.name == b.name:
            return inner + (0.01 if a.position != b.position else 0.0)
        if a.children or b.children:  # nested: same content if the children match
            return inner + 1.0 if inner < 0.5 * (a.size + b.size - 2) else np.inf
        share = same_content(pa, pb)
        return 1.0 - share + 0.02 if share > min_same else np.inf

    def match(a: Node, b: Node, pa: tuple, pb: tuple) -> tuple[float, list]:
        key = (id(a), id(b))
        if key in memo:
            return memo[key]
        n, m = len(a.children), len(b.children)
        direct = _by_name(a, b)
        if direct is not None:
            inner = sum(pair_cost(a.children[i], b.children[j], (*pa, a.children[i].name), (*pb, b.children[j].name)) for i, j in enumerate(direct[:n]) if j < m)
            rest = sum(a.children[i].size for i in range(n) if direct[i] >= m) + sum(b.children[j].size for j in direct[n:] if j < m)
            memo[key] = (inner + rest, direct)
            return memo[key]
        big = 1e6
        cost = np.full((n + m, m + n), 0.0)
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                cost[i, j] = min(big, pair_cost(x, y, (*pa, x.name), (*pb, y.name)))
            cost[i, m:] = big
            cost[i, m + i] = x.size
        for j, y in enumerate(b.children):
            cost[n:, j] = big
            cost[n + j, j] = y.size
        chosen = assign(cost) if n + m else []
        total = sum(cost[i, j] for i, j in enumerate(chosen))
        memo[key] = (total, chosen)
        return memo[key]

    steps: list[Step] = []

    def all_below(node: Node, path: tuple, kind: str) -> None:
        steps.append(Step(kind, path, ()) if kind == "removed" else Step(kind, (), path))
        for c in node.children:
            all_below(c, (*path, c.name), kind)

    def walk(a: Node, b: Node, pa: tuple, pb: tuple) -> None:
        _, chosen = match(a, b, pa, pb)
        n, m = len(a.children), len(b.children)
        for i, j in enumerate(chosen):
            if i < n and j < m:
                x, y = a.children[i], b.children[j]
                px, py = (*pa, x.name), (*pb, y.name)
                if x.name != y.name:
                    steps.append(Step("renamed", px, py))
                elif "unknown" not in (x.kind, y.kind) and x.kind != y.kind:
                    steps.append(Step("retyped", px, py))
                else:
                    steps.append(Step("kept", px, py))
                if x.position != y.position:
                    steps.append(Step("moved", px, py))
                walk(x, y, px, py)
            elif i < n:
                all_below(a.children[i], (*pa, a.children[i].name), "removed")
            elif j < m:
                all_below(b.children[j], (*pb, b.children[j].name), "added")

    walk(old, new, (), ())
    return steps


def _by_name(a: Node, b: Node) -> list[int] | None:
    """The assignment of equal headers, where no other can cost less: all of one side's headers are on the other, too.

    Then the sides' difference in number has to be added or removed whatever is matched.
    Only for leaves; in the form of match(): rows of a, then one row for each unmatched column of b.
    """
    if any(c.children for c in a.children) or any(c.children for c in b.children):
        return None
    n, m = len(a.children), len(b.children)
    at = {c.name: j for j, c in enumerate(b.children)}
    names = {c.name for c in a.children}
    if not (names <= at.keys() or at.keys() <= names):
        return None
    chosen = [at.get(c.name, m + i) for i, c in enumerate(a.children)]
    return chosen + [j if c.name not in names else m + n for j, c in enumerate(b.children)]


def table_schema(headers: list[str], rows: list[list[str]]) -> Node:
    """Schema tree of a flat text table; headers that occur twice get their position as a suffix."""
    seen: dict[str, int] = {}
    children = []
    for i, h in enumerate(headers):
        seen[h] = seen.get(h, 0) + 1
        name = h if seen[h] == 1 else f"{h}#{seen[h]}"
        children.append(Node(name, column_type([r[i] for r in rows]), [], i))
    return Node("", "table", children)


def unify(schemas: list[Node], scripts: list[list[Step]]) -> tuple[list[str], list[dict[str, str]]]:
    """One consistent column list for a chain of schemas, and per file its projection.

    scripts[i] leads from schemas[i] to schemas[i + 1].  A column keeps the name it
    first had; a renamed one maps back to it.  The projections are
    {file's header: unified column}.
    """
    unified: list[str] = []
    current = {}
    for c in schemas[0].children if schemas else []:
        unified.append(c.name)
        current[c.name] = c.name
    projections = [dict(current)] if schemas else []
    for script in scripts:
        following = {}
        for s in script:
            if s.kind in ("kept", "retyped", "renamed"):
                following[s.new[-1]] = current[s.old[-1]]
        for s in script:
            if s.kind == "added":
                name, k = s.new[-1], 2
                while name in unified and name in following.values():
                    name, k = f"{s.new[-1]}#{k}", k + 1
                if name not in unified:
                    unified.append(name)
                following[s.new[-1]] = name
        current = following
        projections.append(dict(current))
    return unified, projections


def struct_schema(dtype, name: str = "", position: int = 0) -> Node:
    """Schema tree of a Spark type; arrays and maps are looked through."""
    from pyspark.sql import types as T

    while isinstance(dtype, (T.ArrayType, T.MapType)):
        dtype = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype.valueType
    if isinstance(dtype, T.StructType):
        return Node(name, "struct", [struct_schema(f.dataType, f.name, i) for i, f in enumerate(dtype.fields)], position)
    return Node(name, dtype.simpleString(), [], position)


def compile_projection(steps: list[Step], old_type):
    """Columns that bring a file of the new schema onto the old one (top level of a Spark schema).

    Kept and renamed columns are read under the old name, retyped ones are
    converted with try_cast (values that do not convert become null), removed
    ones are null; added ones are left out.
    """
    from pyspark.sql import functions as F

    source = {s.old[0]: s for s in steps if len(s.old) == 1 and s.kind in ("kept", "renamed", "retyped")}
    out = []
    for f in old_type.fields:
        s = source.get(f.name)
        if s is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif s.kind == "retyped":
            out.append(F.col(f"`{s.new[0]}`").try_cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"`{s.new[0]}`").alias(f.name))
    return out


def drift_report(spark, files: dict[str, object], sample_share=None) -> tuple[list[tuple[str, str, str, str]], dict[str, list]]:
    """Change report over a sequence of DataFrames ({name: DataFrame} in order of time).

    Returns rows (file, change_kind, old_header, new_header) and, per file, the
    projection onto the first file's schema, composed step by step.
    """
    report: list[tuple[str, str, str, str]] = []
    projections: dict[str, list] = {}
    before = first_type = None
    for name, df in files.items():
        if before is None:
            first_type = df.schema
            projections[name] = [c for c in df.columns]
            before = df
            continue
        steps = edit_script(struct_schema(before.schema), struct_schema(df.schema), sample_share or (lambda a, b: 0.0))
        report += [(name, s.kind, ".".join(s.old), ".".join(s.new)) for s in steps if s.kind not in ("kept", "moved")]
        projections[name] = compile_projection(edit_script(struct_schema(first_type), struct_schema(df.schema), sample_share or (lambda a, b: 0.0)), first_type)
        before = df
    return report, projections
