from __future__ import annotations

import pytest

from covenantry.plans import asking, graphs, integrity, links, overview
from covenantry.plans import reading as readings
from covenantry.sources import shared
from tests.oracle import compare

ALL = {m: m.oracle_sql() for m in (links, graphs, asking, readings)}


@pytest.mark.parametrize(("module", "name"), [(m, n) for m, sql in ALL.items() for n in sorted(sql)], ids=lambda x: x if isinstance(x, str) else x.__name__.rsplit(".", 1)[1])
def test_matches_sql(spark, module, name):
    assert set(module.queries()) == set(ALL[module])
    compare(spark, "/root/testdata/sf0.001", module.queries()[name], ALL[module][name])


@pytest.mark.parametrize(("query", "kept"), [
    (graphs.parties_of_contracts, []), (graphs.contracts_for_party, []), (graphs.amendments_of_contracts, []), (graphs.obligations_of_parties, ["held"]),
    (integrity.contracts_by_id, ["facts"]), (overview.party_network, []),
], ids=lambda x: getattr(x, "__name__", ""))
def test_a_part_of_the_graph_reads_only_its_tables(spark, monkeypatch, query, kept):
    """Neither nodes and edges nor what they are made of is stored for a query that filters them out, and no amendment is linked."""
    made = []
    monkeypatch.setattr(graphs, "stored", lambda df, purpose: made.append(purpose) or shared.stored(df, purpose))
    df = query(spark, "/root/testdata/sf0.001")
    assert made == kept
    # a scored link is in the plan of what reads links alone
    assert ("a_agreed" in df._jdf.queryExecution().optimizedPlan().toString()) == (query is graphs.amendments_of_contracts)
