"""Every query of the core against its SQL on the smallest tables; those without SQL must run."""

from __future__ import annotations

import pytest

from tests.compare import same
from tests.conftest import SMALL
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name in catalogue.ORACLE:
        same(got, duck.execute(catalogue.ORACLE[name]).df())
    else:
        assert got.columns.is_unique and len(got)
        for c in got.select_dtypes("float").columns:
            assert got[c].notna().any(), c


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_core_does_not_import_the_optional_subpackage():
    import pathlib

    import tidemark

    root = pathlib.Path(tidemark.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tidemark.llm" not in f.read_text(), f


def test_scan_is_pushed_down(spark):
    plan = catalogue.QUERIES["scan_date_range"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan or "PushedFilters: [IsNotNull(l_returnflag)" in plan
    assert "l_tax" not in plan.split("Physical Plan")[-1]
