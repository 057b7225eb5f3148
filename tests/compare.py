"""Order-insensitive comparison of a Spark result with SQL's."""

from __future__ import annotations

import pandas as pd


def cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float) or type(v).__module__ == "numpy" and hasattr(v, "dtype") and v.dtype.kind == "f":
        return f"{float(v):.5g}"
    if hasattr(v, "year"):
        return str(v).replace("+00:00", "").removesuffix(" 00:00:00")
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(zip(*[df[c].map(cell) for c in columns], strict=True)) if len(df) else []


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)
