from __future__ import annotations

import pytest

from covenantry.operators import composing, details
from covenantry.plans import details as plans
from tests.oracle import compare
from tests.plans import most_rows

SQL = plans.oracle_sql()
ASK, SPAN, TERM = "query_id long, text string", "query_id long, span_id long, position int, text string", "ord long, term string, definition string"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", plans.queries()[name], SQL[name])


def test_kinds_of_answers(spark):
    asked = [
        (1, "What is an NDA?\nand more"), (2, "When is payment due?"), (3, "Summarize it"), (4, "Who pays dragons?"), (5, None), (6, "define zebra"), (7, "When is payment due?"),
        (8, "What does the non-disclosure agreement cover?"), (9, "About the andarine"),
    ]
    text = "Short payment line\n  * Every payment is due i.e. at once. The payment is due by transfer. Ok.\nAll of the payment and payment rules are here"
    spans = [(q, 7, 1, text) for q in (2, 3, 4, 5, 8)] + [(2, 8, 2, text), (2, 9, 3, None), (3, 8, 2, None), (3, 9, 3, "short")]
    terms = [(2, "NDA", "second"), (1, "nda", "first"), (3, "Non-Disclosure Agreement", "kept secret"), (4, "...", "never"), (5, None, "never"), (6, "and", "never")]
    found = composing.composed_answers(spark.createDataFrame(asked, ASK), spark.createDataFrame(spans, SPAN), spark.createDataFrame(terms, TERM))
    got = {r.query_id: (r.kind, [(c.sentence, c.span_id) for c in r.claims], r.answer) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "DEFINITION", 2: "QUOTES", 3: "OVERVIEW", 4: "REFUSAL", 5: "OVERVIEW", 6: "REFUSAL", 7: "REFUSAL", 8: "DEFINITION", 9: "REFUSAL"}
    assert got[1][2] == "first" and got[8][2] == "kept secret" and got[4][1:] == ([], composing.REFUSAL)
    # both spans have the same two lines: of four lines two different sentences stay
    assert got[2][1] == [("Every payment is due i.e.", 7), ("All of the payment and payment rules are here.", 7)]
    assert got[3][1][0][1] == 7 and len(got[3][1]) == 1 and got[3][2].startswith(composing.INTRO)


def test_answers_of_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (ASK, SPAN, TERM)]
    assert composing.composed_answers(*none).isEmpty()
    one = composing.composed_answers(spark.createDataFrame([(1, "What is this about?")], ASK), none[1], none[2]).collect()
    assert [(r.kind, r.claims) for r in one] == [("REFUSAL", [])]


def test_located_against_all_names(spark):
    names = [(i, None if i == 5 else f"{'Alpha' if i % 3 else 'Beta'} Supply {i % 7}.pdf") for i in range(1, 60)] + [(900, "x"), (900, "x"), (901, "")]
    wanted = ["3", " 17 ", "alpha supply 2", "BETA", "y 6.P", "pdf", "99", "9", "x", "", "  ", None, "no such name", "90", "901", ".pdf2", "%", "e" * 400]
    asked = spark.createDataFrame(list(enumerate(wanted)), "ask_id long, wanted string")
    got = {r.ask_id: (r.how, r.document_id) for r in details.located(asked, spark.createDataFrame(names, "document_id long, filename string")).collect()}

    def brute(w):
        w = (w or "").strip()
        same = [d for d, _ in names if str(d) == w]
        part = [d for d, f in names if w and (w.lower() in (f or "").lower() or w.lower() in str(d))]
        return ("exact", min(same)) if same else ("part", min(part)) if part else ("none", None)

    assert got == {i: brute(w) for i, w in enumerate(wanted)}


def test_intelligence_of_bare_documents(spark):
    of = spark.createDataFrame
    held = details.intelligence(
        of([(1, "a.pdf", None), (2, None, 2)], "document_id long, filename string, n_changes int"),
        of([(1, "governing_law", "Texas", None, 0.88, True, 2, 3), (1, "payment_terms", "Net 30", 30, 0.9, True, 1, 1), (1, "effective_date", None, None, 0.0, False, None, None)],
           "document_id long, field_name string, normalized_value string, int_value int, confidence double, is_found boolean, page_number int, reading_order int"),
        of([(1, 1, "B"), (1, 0, "A")], "document_id long, ord int, name string"), of([], "document_id long, n int, reference string"), of([(1,), (1,)], "document_id long"),
    )
    got = {r.document_id: r for r in held.collect()}
    assert got[1].governing_law.value == "Texas" and got[1].payment_terms.value == "30" and got[1].effective_date is None
    assert got[1].parties == ["A", "B"] and got[1].schedules == [] and got[1].n_blocks == 2 and got[1].n_amendments == 0
    assert got[2].parties == [] and got[2].governing_law is None and got[2].n_blocks == 0 and got[2].n_amendments == 2


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_payloads_come_back(spark, tmp_path, form):
    from covenantry.operators import reading

    schema = "id long, name string, spans array<struct<page:int,text:string>>"
    rows = [(1, 'a "quoted"\nline', [(1, "é"), (2, None)]), (2, None, []), (3, "", None)]
    folder = str(tmp_path / form)
    reading.write_payload(spark.createDataFrame([(9, "old", None)], schema), folder, form)
    reading.write_payload(spark.createDataFrame(rows, schema).repartition(2), folder, form)
    got = spark.read.schema(schema).format(form).load(folder).orderBy("id").collect()
    assert [(r.id, r.name, r.spans and [tuple(x) for x in r.spans]) for r in got] == rows
    reading.write_payload(spark.createDataFrame([], schema), folder, form)
    assert spark.read.schema(schema).format(form).load(folder).isEmpty()


def test_many_asks_of_frequent_pieces_make_no_pairs(spark):
    n = 3000
    names = spark.range(n).selectExpr("id + 1000 AS document_id", "concat('First Amendment ', id % 5, '.pdf') AS filename")
    asked = spark.range(n).selectExpr("id AS ask_id", "CASE id % 3 WHEN 0 THEN '1' WHEN 1 THEN '39' ELSE 'AMENDMENT 3' END AS wanted")
    df = details.located(asked, names)
    got = {r.ask_id: (r.how, r.document_id) for r in df.collect()}
    assert got == {i: ("part", (1000, 1039, 1003)[i % 3]) for i in range(n)}
    assert most_rows(df) < 60 * n  # an ask meets up to 3,000 names
