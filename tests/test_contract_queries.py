from __future__ import annotations

import pytest

from covenantry.plans import queries as Q
from tests.oracle import compare

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", Q.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"document_id", "n_signals", "risk_score"}
    assert set(Q.queries()) <= set(__spark_entry__.queries())
