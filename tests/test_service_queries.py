from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from covenantry.operators import answers, clauses, intake, roles
from covenantry.plans import service
from tests.oracle import compare

SQL = service.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", service.queries()[name], SQL[name])


def test_clauses(spark):
    rows = [
        (1, "Supplier shall cure the default within 10 days after receipt of notice."), (2, "Supplier shall cure the default within 30 days after receipt of notice."),
        (3, "Customer may terminate with immediate effect."), (3, "Customer may terminate without cause."), (4, None), (5, ""),
    ]
    got = clauses.clause_risks(spark.createDataFrame(rows, "document_id long, text string")).collect()
    assert sorted((r.document_id, r.risk_type) for r in got) == [(1, "SHORT_CURE_PERIOD"), (3, "ASYMMETRIC_TERMINATION")]
    many = [(1, f"see schedule {i} and SCHEDULE {i}") for i in range(30)] + [(2, None), (3, "no reference")]
    got = clauses.referenced_schedules(spark.createDataFrame(many, "document_id long, text string")).orderBy("n").collect()
    assert [r.reference for r in got] == sorted(f"Schedule {i}" for i in range(30))[:10]


def test_evidence_and_reports(spark):
    asked = spark.createDataFrame([(1, "What is the payment term?"), (2, None)], "query_id long, text string")
    spans = spark.createDataFrame([(1, i, i, "payment term" if i == 9 else "the payment" if i == 5 else None if i == 3 else "x") for i in range(12)] + [(2, 1, 1, "y")], "query_id long, span_id long, position int, text string")
    got = answers.rank_evidence(asked, spans).filter("query_id = 1").orderBy(F.length("evidence_id"), "evidence_id").collect()
    assert [r.span_id for r in got] == [9, 5, 0, 1, 2, 3, 4, 6] and [r.hits for r in got][:3] == [2, 1, 0]
    claims = spark.createDataFrame([(1, "SUPPORTED"), (1, "SUPPORTED"), (2, "SUPPORTED"), (2, "CONTRADICTED"), (3, "UNSUPPORTED"), (3, "INSUFFICIENT_EVIDENCE")], "answer_id long, status string")
    got = {r.answer_id: r for r in answers.answer_reports(claims).collect()}
    assert {k: r.overall_status for k, r in got.items()} == {1: "SUPPORTED", 2: "CONTRADICTED", 3: "INSUFFICIENT_EVIDENCE"}
    assert got[1].fully_grounded and not got[2].fully_grounded and got[2].support_rate == 0.5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "document_id long, page_number int, text string")
    assert clauses.clause_risks(empty).isEmpty() and clauses.referenced_schedules(empty).isEmpty() and intake.scans(empty).isEmpty()
    one = spark.createDataFrame([(1, None, None)], "document_id long, page_number int, text string")
    assert [tuple(r) for r in intake.scans(one).collect()] == [(1, 0.0, True)]


def test_party_roles(spark):
    rows = [
        (1, None, "This Agreement is between Apex Global Inc. ('Customer') and Vanguard Defense LLC ('Service Provider').", None, ["Apex Global Inc.", "Vanguard Defense LLC"]),
        (2, "Supply Agreement", "Between A Corp and B Corp.", None, ["A Corp", "B Corp"]),
        (3, "Supply Agreement", "Between A Corp and B Corp, the buyer.", None, ["A Corp", "B Corp"]),
        (4, "Other", "A Corp acts as the licensor.", [None, "B Corp", "Licensee means the firm B Corp."], ["A Corp", "B Corp", ""]),
        (5, "License", None, None, ["A Corp", None]), (6, None, None, None, None), (7, None, "x (the Buyer)", None, []),
        (8, None, "Between S Corp ('Supplier') and C Corp ('Customer').", None, ["S Corp", "C Corp"]),
        (9, None, "S Corp. " + "x" * 10 + " (the Supplier) and C Corp" + " y" * 52 + " (Buyer)", ["Lender means L LLC; and M LLC", "Borrower shall mean " + "z" * 61 + "N LLC"], ["S Corp", "C Corp", "L LLC", "M LLC", "N LLC"]),
        (10, None, "SubCorp (Lender). Corp and corp acts as buyer", None, ["Corp"]),
    ]
    table = spark.createDataFrame(rows, "document_id long, contract_type string, preamble string, definitions array<string>, parties array<string>")
    got = {(r.document_id, r.ord): r.role for r in roles.party_roles(table).collect()}
    assert got == {
        (1, 0): "CUSTOMER", (1, 1): "SERVICE_PROVIDER", (2, 0): None, (2, 1): None, (3, 0): "BUYER", (3, 1): "SUPPLIER", (4, 0): "LICENSOR", (4, 1): "LICENSEE", (4, 2): None,
        (5, 0): "LICENSOR", (5, 1): "LICENSEE", (8, 0): "CUSTOMER", (8, 1): "CUSTOMER",  # both words are within reach of the first name
        (9, 0): None, (9, 1): None, (9, 2): "LENDER", (9, 3): None, (9, 4): None, (10, 0): "BUYER",
    }


def test_opening_texts(spark):
    rows = [(1, 1, i, i == 2, f"b{i}") for i in range(12)] + [(1, 3, 0, None, None), (1, 4, 0, False, "late"), (2, 2, 0, False, "x"), (3, 5, 0, False, "y")]
    got = {r[0]: (r[1], r[2]) for r in roles.opening_texts(spark.createDataFrame(rows, "document_id long, page_number int, reading_order int, is_noise boolean, text string")).collect()}
    assert got == {1: ("b0 b1 b3 b4 b5 b6 b7 b8", [f"b{i}" for i in range(12) if i != 2] + [""]), 2: ("", ["x"])}


def test_quoted_lines_and_inline_claims(spark):
    asked = spark.createDataFrame([(1, "When is payment due?"), (2, "Who is the licensor?"), (3, None)], "query_id long, text string")
    text = "Payment terms\nEvery payment is due within thirty days.\nLate sums bear interest at one per cent.\nAll payments are made by transfer to the bank."
    spans = spark.createDataFrame([(1, 7, 1, text), (1, 8, 2, None), (2, 7, 1, text), (3, 7, 1, text)], "query_id long, span_id long, position int, text string")
    got = [(r.query_id, r.n, r.line_number, r.hits) for r in answers.extract_lines(asked, spans).orderBy("query_id", "n").collect()]
    assert got == [(1, 1, 1, 2), (1, 2, 3, 1)]
    said = spark.createDataFrame([("One [E1][E2][E1]. Two.\nThree [E9]",), ("none",), (None,), ("",)], "text string")
    got = [r[0] for r in said.select(answers.inline_claims(F.col("text"))).collect()]
    assert [(c.claim, c.evidence_ids) for c in got[0]] == [("One.", ["E1", "E2"]), ("Three", ["E9"])] and got[1:] == [[], None, []]
