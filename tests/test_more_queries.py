from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from covenantry.operators import chunking, evidence, ingest, questions
from covenantry.plans import more as M
from covenantry.streaming import events as streams
from tests.oracle import compare

SQL = M.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", M.queries()[name], SQL[name])


def _windows(blocks):
    """Chunks as texts: each block is added, and on reaching the target the last blocks are kept."""
    out, held = [], []
    for b in blocks:
        held.append(b)
        if len("\n\n".join(held)) >= chunking.TARGET:
            out.append("\n\n".join(held))
            kept = []
            while held and len("\n\n".join(kept)) < chunking.OVERLAP:
                kept.insert(0, held.pop())
            held = kept
    return out + (["\n\n".join(held)] if len("\n\n".join(held)) > chunking.LEAST_TAIL else [])


def _sections(rows):
    """Chunks as texts, from rows (text, is a mark, section carried forward)."""
    out, held, current = [], [], None
    for text, mark, section in rows:
        n = sum(map(len, held))
        new = mark or (section != current and section is not None)
        if held and ((new and n >= chunking.SHORTEST) or n + len(text) > chunking.LONGEST):
            out, held, current = [*out, "\n\n".join(held)], [text], section
        else:
            held.append(text)
            current = section or current
    return out + (["\n\n".join(held)] if held else [])


def test_chunks_match_brute_force(spark):
    made = [(900_001, "\n".join(f"SECTION {i}. Terms\n" + "word " * (7 * i) for i in range(1, 60))), (900_002, None), (900_003, ""), (900_004, "short"), (900_005, "x" * 400_000), (900_006, "1.1 One\na\n\n \nEXHIBIT A\nb")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    held = docs.select("doc_id", chunking.blocks_of(F.col("text")).alias("blocks"))
    kinds = lambda f: F.transform("blocks", f)
    rows = held.select("doc_id", "blocks", kinds(ingest.block_type).alias("types"), kinds(ingest.section_number).alias("own")).collect()
    want = {}
    for r in rows:
        section, carried = None, []
        for t, k, own in zip(r.blocks, r.types, r.own, strict=True):
            section = own if own is not None else section
            carried.append((t, k in ("heading", "exhibit_marker"), section))
        want[r.doc_id] = _windows(r.blocks), _sections(carried)
    for k, chunks in enumerate((chunking.window_chunks(docs), chunking.section_chunks(docs))):
        got = {}
        for r in chunks.orderBy("document_id", "chunk").collect():
            got.setdefault(r.document_id, []).append(r.text)
            assert r.n_chars == len(r.text)
        assert got == {d: w[k] for d, w in want.items() if w[k]}


def test_described_chunks(spark):
    long = "word " * 40
    rows = [(1, f"intro {long}\nSECTION 1. Terms\n{long}\nplain\nSECTION 2. More\n{long}\nEXHIBIT A\n{long}"), (2, "short\nlines"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunking.described_chunks(docs).orderBy("document_id", "chunk").collect()
    assert [(r.chunk_id, r.chunk_type, r.section_number, r.first_block, r.last_block) for r in got] == [
        ("chk_sec_1_000", "PARAGRAPH_GROUP", None, 1, 1), ("chk_sec_1_001", "SECTION", "1", 2, 4), ("chk_sec_1_002", "SECTION", "2", 5, 6), ("chk_sec_1_003", "EXHIBIT", "2", 7, 8),
        ("chk_sec_2_000", "PARAGRAPH_GROUP", None, 1, 2),
    ]
    plain = {(r.document_id, r.chunk): (r.first_block, r.first_block + r.n_blocks - 1, r.n_chars) for r in chunking.section_chunks(docs).collect()}
    assert {(r.document_id, r.chunk): (r.first_block, r.last_block, r.n_chars) for r in got} == plain


def test_claims(spark):
    claims = [(1, "It shall renew."), (2, "Pay within 60 days."), (3, "Supplier may deliver goods."), (4, "Supplier delivers goods."), (5, "None cited."), (6, "Missing."), (7, "to it"), (8, None)]
    spans = [("a", "There is no automatic renewal."), ("b", "Pay within 30 days."), ("c", "Supplier shall deliver goods."), ("d", None)]
    cited = [(1, 0, "a"), (2, 0, "b"), (3, 0, "c"), (4, 0, "c"), (4, 1, "b"), (6, 0, "z"), (7, 0, "c"), (8, 0, "c")]
    found = evidence.verify_claims(
        spark.createDataFrame(claims, "claim_id long, text string"), spark.createDataFrame(cited, "claim_id long, position int, evidence_id string"), spark.createDataFrame(spans, "evidence_id string, text string")
    )
    got = {r.claim_id: r.status for r in found.collect()}
    assert got == {1: "CONTRADICTED", 2: "UNSUPPORTED", 3: "PARTIALLY_SUPPORTED", 4: "SUPPORTED", 5: "INSUFFICIENT_EVIDENCE", 6: "UNSUPPORTED", 7: "INSUFFICIENT_EVIDENCE", 8: "INSUFFICIENT_EVIDENCE"}


def test_intents(spark):
    asked = ["What changed in the amendment?", "Which contracts with Acme are net 30?", "When does it expire?", "Hello", None]
    got = spark.createDataFrame([(x,) for x in asked], "t string").select(questions.intent(F.col("t"))).collect()
    assert [r[0] for r in got] == ["amendment", "cross_contract", "timeline", "information", None]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    from datetime import datetime as D

    first, second = [(1, D(2024, 1, 1, 0, 5), "a", 1.0), (2, D(2024, 1, 1, 0, 50), "a", 3.0)], [(3, D(2024, 1, 1, 0, 30), "a", 2.0), (4, D(2024, 1, 1, 2, 0), "b", None)]
    folder, out, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "log"))
    for rows in (first, second):
        df = made(rows)
        df.coalesce(1).write.mode("append").parquet(folder)
        found = streams.stream_windows(spark, folder, df.schema, out, log, "1 hour", "1 day")
    assert sorted((r.event_type, r.n_events, r.max_value) for r in found.collect()) == [("a", 3, 3.0), ("b", 1, None)]
    for rows in ([(5, D(2024, 1, 9, 0, 0), "b", 1.0)], [(6, D(2024, 1, 1, 0, 40), "a", 9.0), (7, D(2024, 1, 8, 23, 10), "a", 4.0)]):  # the sixth is over a week late
        df = made(rows)
        df.coalesce(1).write.mode("append").parquet(folder)
        found = streams.stream_windows(spark, folder, df.schema, out, log, "1 hour", "1 day")
    assert sorted((str((r.event_type, r.n_events, r.max_value)) for r in found.collect())) == ["('a', 1, 4.0)", "('a', 3, 3.0)", "('b', 1, 1.0)", "('b', 1, None)"]
