from __future__ import annotations

import pytest

from tests.compare import same
from tests.conftest import SMALL
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name in queries.ORACLE:
        same(got, duck.execute(queries.ORACLE[name]).df())
