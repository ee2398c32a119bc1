from __future__ import annotations

import pytest

from covenantry.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])
