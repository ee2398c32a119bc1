"""Questions over three known contracts, with the routes and documents that are stated for them."""

from __future__ import annotations

import pytest

from covenantry.operators import amendments, understanding

CONTRACTS = [
    (1, "BEST CIRCUIT BOARDS-AMX Agreement.pdf"),
    (2, "Access Worldwide Communications-E*TRADE Financial Corporation Amendment.pdf"),
    (3, "Access Worldwide Communications-E*TRADE Financial Corporation Agreement.pdf"),
]
ROLES = [
    (1, "BEST CIRCUIT BOARDS, INC.", "SUPPLIER"), (1, "AMX, LLC", "CUSTOMER"), (2, "Access Worldwide Communications, Inc.", "SERVICE_PROVIDER"), (2, "E*TRADE Financial Corporation", "CUSTOMER"),
    (3, "Access Worldwide Communications, Inc.", "SERVICE_PROVIDER"), (3, "E*TRADE Financial Corporation", "CUSTOMER"),
]
ASKED = [
    ("Which contracts involve E*TRADE?", "DIRECT_GRAPH", None),
    ("Which contracts have Net 30 payment terms?", "DIRECT_GRAPH", None),
    ("Which agreements have renewal provisions?", "DIRECT_GRAPH", None),
    ("Which contracts specify termination notice of 30 days?", "DIRECT_GRAPH", None),
    ("What does the indemnification section say about third-party claims?", "DIRECT_RETRIEVAL", None),
    ("What are the payment terms in the Access agreement?", "CONTRACT_DETAILS", 3),
    ("What obligations does the vendor have under the AMX agreement?", "OBLIGATION_QUERY", 1),
    ("When does the Access agreement expire?", "TIMELINE_QUERY", 3),
    ("What changed in the Access-E*TRADE amendment?", "AMENDMENT_QUERY", 2),
    ("Which contracts involving E*TRADE have Net 30 payment terms?", "HYBRID_REASONING", None),
    ("Tell me something not contained in the contracts, like the CEO personal salary.", "UNANSWERABLE", None),
    ("What are AMX customer obligations as the supplier under doc_1?", "UNANSWERABLE", 1),
    ("What obligations has E*TRADE under doc_1?", "UNANSWERABLE", 1),
    (None, "DIRECT_RETRIEVAL", None),
]


@pytest.fixture(scope="module")
def analysed(spark):
    contracts = spark.createDataFrame(CONTRACTS, "document_id long, filename string")
    parties = spark.createDataFrame([(d, k % 2, n) for k, (d, n, _) in enumerate(ROLES)], "document_id long, ord int, name string")
    roles = spark.createDataFrame(ROLES, "document_id long, name string, role string")
    questions = spark.createDataFrame([(k, q) for k, (q, *_) in enumerate(ASKED)], "query_id long, text string")
    return {r.query_id: r for r in understanding.analyse(questions, contracts, parties, roles).collect()}


def test_routes_and_documents(analysed):
    assert len(analysed) == len(ASKED)
    for k, (text, route, document) in enumerate(ASKED):
        assert analysed[k].route == route, text
        if document is not None:
            assert analysed[k].document_id == document, text


def test_roles_entities_and_expansion(analysed):
    vendor, hybrid = analysed[6], analysed[9]
    assert vendor.resolved_party == "BEST CIRCUIT BOARDS, INC." and vendor.role_status == "resolved"
    assert vendor.expanded.startswith(ASKED[6][0] + " BEST CIRCUIT BOARDS, INC.") and "shall" in vendor.expanded
    assert hybrid.entities == "E*TRADE Financial Corporation"
    assert [analysed[k].note for k in (10, 11, 12)] == ["out_of_domain", "inverted_role", "other_party"]


def test_parents_that_are_not_clear(spark):
    """Two agreements alike, and a single one of too low a score, leave an amendment without a parent; a clear one is found."""
    schema = "document_id long, filename string, contract_type string, effective_date string, opening string, n_changes int"
    amend = (1, "First Amendment Alpha supply.pdf", "Amendment", "2005-01-01", "This amends the Alpha supply agreement.", 1)
    good = (2, "Alpha supply Agreement.pdf", "Supply Agreement", "2004-01-01", "Made.", 0)
    twin, poor = (3, *good[1:]), (4, "Lease.pdf", "Lease", "2009-01-01", "Made.", 0)
    parties = spark.createDataFrame([(d, 0, "Alpha, Inc.") for d in range(1, 5)], "document_id long, ord int, name string")
    status = lambda *rows: amendments.link_amendments(spark.createDataFrame([amend, *rows], schema), parties).first()
    assert (status(good).status, status(good).parent_id) == ("RESOLVED", 2) and status(good).top_score >= 0.75
    assert (status(good, twin).status, status(good, twin).parent_id) == ("UNKNOWN_PARENT", None)
    assert status(poor).status == "UNKNOWN_PARENT" and status().status == "NO_PARENT_CANDIDATES"
