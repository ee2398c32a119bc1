from __future__ import annotations

import pytest

from covenantry.operators import duties, obligations
from covenantry.plans import duties as D
from tests.oracle import compare

SQL = D.oracle_sql()


@pytest.mark.parametrize("name", sorted(D.queries()))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", D.queries()[name], SQL[name])


KNOWN = [
    ("This agreement shall expire on June 30, 2027.", "fixed_date", None, None),
    ("Payment is due and shall be made within thirty (30) days after receipt of invoice.", "relative_offset", 30, "invoice_received"),
    ("You must notify the other party within 10 days after discovering a breach.", "event_relative", 10, "breach_discovered"),
    ("Vendor shall provide a monthly report detailing system uptime.", "recurring", None, None),
    ("If a force majeure event occurs, party shall notify the other within 15 days of such occurrence.", "conditional", 15, "such_occurrence"),
    ("Supplier shall maintain comprehensive general liability insurance throughout the term.", "ongoing", None, "contract_term"),
    ("Customer agrees to provide reasonable cooperation.", "unspecified", None, None),
    ("It is agreed that strict confidentiality shall be maintained.", "unspecified", None, None),
    ("If A happens, if B happens, it shall end, and must be over.", "conditional", None, "condition_B happens"),
]


def test_known_sentences(spark):
    """The reference's own examples of timing, with their results as stated."""
    typed = spark.createDataFrame([(k, 1, 0, t, None) for k, (t, *_) in enumerate(KNOWN)], "document_id long, page_number int, reading_order int, text string, section_title string")
    none = spark.createDataFrame([], "document_id long, ord int, name string")
    got = {r.document_id: r for r in duties.obligations_in_full(typed, none).collect()}
    assert {k: (r.temporal_type, r.offset_days, r.anchor_event) for k, r in got.items()} == {k: x[1:] for k, x in enumerate(KNOWN)}
    assert got[0].calculated_date == "2027-06-30" and got[3].frequency == "monthly" and got[3].repeat_interval == 1 and "force majeure" in got[4].condition
    assert got[7].actor == "unresolved" and got[7].actor_role is None and got[7].confidence == 0.75 and got[7].source_clause == "Page 1 Block 0"
    assert duties.obligations_in_full(typed.limit(0), none).count() == 0


def test_silent_types(spark):
    kinds = [None, "header", "footer", "sec_noise", "table", "paragraph"]
    typed = spark.createDataFrame([(k, 1, 0, "Vendor shall pay the whole fee.", None, t) for k, t in enumerate(kinds)], "document_id long, page_number int, reading_order int, text string, section_title string, block_type string")
    none = spark.createDataFrame([], "document_id long, ord int, name string")
    assert sorted(r.document_id for r in duties.obligations_in_full(typed, none).collect()) == [0, 4, 5]


def test_deadlines(spark):
    rows = [("2026-10-01", 30, None), (None, 30, None), ("no day", 30, None), ("2026-01-31", None, 1), ("2026-10-01", None, None)]
    df = spark.createDataFrame(rows, "anchor string, days int, months int")
    got = [str(r[0]) for r in df.select(obligations.deadline(df.anchor, df.days, df.months)).collect()]
    assert got == ["2026-10-31", "None", "None", "2026-02-28", "None"]
