"""Comparison of amendments with their parents on planted contracts, and its rows against SQL."""

from __future__ import annotations

from covenantry.operators import amendments
from covenantry.plans import links as plans
from tests.oracle import compare

ASK = "ask_id long, wanted string, parent_id long"
CONTRACT, LINK = "document_id long, filename string", "amendment_id long, parent_id long, top_score double"
CHANGE, BLOCK = "amendment_id long, page_number int, reading_order int, action string, target_section string, raw_text string", "document_id long, page_number int, reading_order int, text string"

CONTRACTS = [(1, "Alpha MSA.pdf"), (2, "First Amendment Alpha.pdf"), (3, "Beta Supply.pdf"), (4, "Second Amendment.pdf"), (5, None)]
LINKS = [(2, 1, 0.9), (4, None, 0.4)]
CHANGES = [
    (2, 2, 5, "DELETE_AND_REPLACE", "Section 3", "three is new"), (2, 2, 6, "DELETE_AND_REPLACE", "Section 3", "three again"), (2, 3, 9, "CONFIRM_FULL_FORCE", "General", "all else stays"),
    (2, 2, 7, "ADD_COVERAGE", "Section 15.4", "cover"),
]
BLOCKS = [
    (1, 1, 0, "MASTER"), (1, 1, 1, "3. TERM of it"), (1, 2, 4, "See Section 15.4 of the law"), (2, 1, 0, "AMENDMENT"), (2, 1, 1, "to the Master Services Agreement"), (2, 2, 5, "three is new"),
    (2, 2, 6, "three again"), (2, 2, 7, "cover"), (2, 3, 9, "all else stays"), (3, 1, 0, "SUPPLY"), (4, 1, 3, "SECOND"),
]


def found(spark, asked, contracts=CONTRACTS, links=LINKS, changes=CHANGES, blocks=BLOCKS):
    tables = [spark.createDataFrame(rows, s) for rows, s in ((asked, ASK), (contracts, CONTRACT), (links, LINK), (changes, CHANGE), (blocks, BLOCK))]
    return {r.ask_id: r for r in amendments.compared_amendments(*tables).collect()}


def test_rows_match_sql(spark):
    compare(spark, "/root/testdata/sf0.001", plans.queries()["compared_amendments"], plans.oracle_sql()["compared_amendments"])


def test_evidence_counts_once_in_order_of_its_first_mention(spark):
    got = found(spark, [(10, "2", None)])[10]
    assert (got.status, got.parent_id, got.confidence, got.basis, got.total_modifications, got.full_force_confirmed) == ("SUCCESS", 1, 0.9, "composite_candidate_scoring", 4, True)
    # the recital, both changes of section 3 with that section between them once, the added cover with what names its section, the last clause
    assert [tuple(x) for x in got.evidence] == [(2, 1, 1), (2, 2, 5), (1, 1, 1), (2, 2, 6), (2, 2, 7), (1, 2, 4), (2, 3, 9)]
    assert got.impacts.split("; ")[0] == "Section 3 (TERM of it): Contract duration and term provisions replaced." and got.impacts.endswith("remain in full force and effect.")


def test_named_parents_parts_of_names_and_nothing_found(spark):
    asked = [(1, "2", 3), (2, "first AMENDMENT", None), (3, "first amendment", 3), (4, "2", 99), (5, "4", None), (6, "4", 3), (7, None, 1), (8, "no such", 1), (9, "2", 3), (10, "5", 1), (11, "2", None)]
    got = found(spark, asked)
    assert len(got) == len(asked)
    # a parent that is named counts only with an exact id and if it is there
    assert [(got[i].parent_id, got[i].basis) for i in (1, 2, 3, 4)] == [(3, "explicit_argument"), (1, "composite_candidate_scoring"), (1, "composite_candidate_scoring"), (1, "composite_candidate_scoring")]
    assert got[1].confidence == 1.0 and [tuple(x) for x in got[1].evidence] == [(2, 1, 0), (2, 2, 5), (2, 2, 6), (2, 2, 7), (2, 3, 9)] and got[9].evidence == got[1].evidence
    assert [got[i].status for i in (5, 7, 8)] == ["NO_RESULTS"] * 3 and got[5][2:] == (None,) * 10
    # no changes: only what ties the two together; a document without a block has no evidence
    assert (got[6].total_modifications, got[6].full_force_confirmed, got[6].impacts, [tuple(x) for x in got[6].evidence]) == (0, False, "", [(4, 1, 3)])
    assert got[10].status == "SUCCESS" and got[10].evidence is None


def test_empty_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, "2", 1)], [], [], [], [])[1].status == "NO_RESULTS"
