from __future__ import annotations

import pytest

from covenantry.operators import ingest, provenance, registry, reranking
from covenantry.plans import integrity, ranking
from tests.oracle import compare

SQL = ranking.oracle_sql() | integrity.oracle_sql()
QUERIES = ranking.queries() | integrity.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", QUERIES[name], SQL[name])


def _ranking(spark, rows):
    """Rows (query, chunk, score) in order of rank."""
    seen, out = {}, []
    for q, c, s in rows:
        seen[q] = seen.get(q, 0) + 1
        out.append((q, c, s, seen[q]))
    return spark.createDataFrame(out, "query_id long, chunk_id string, score double, rank int")


def test_signals_and_reranking(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"d{k % 6}", t) for k, t in enumerate(["net thirty days", "the net price", "thirty days net price", None, "price", "x", "y", "z"])], "chunk_id string, document_id string, text string")
    same = [("c0", 0.9), ("c1", 0.5), ("c2", 0.4)]
    fused = _ranking(spark, [
        (1, "c0", 0.9), (1, "c6", 0.8),  # clear, two documents of which one twice
        (2, "c0", 0.0329), (2, "c1", 0.0328), (2, "c4", 0.02), (2, "c3", 0.01),  # close, four documents
        (3, "c0", 0.9), (3, "c1", 0.5), (3, "c2", 0.4),  # three documents, but bound to two
        (4, "c0", 0.9),  # one candidate has no margin to be narrow
        (5, "c0", 0.9),
    ])
    agreeing = _ranking(spark, [(q, c, s) for q in (1, 2, 3, 5) for c, s in same])
    other = _ranking(spark, [(q, c, s) for q in (1, 2, 3) for c, s in same] + [(4, "c0", 1.0), (5, "c5", 0.9), (5, "c6", 0.5)])
    asked = spark.createDataFrame([(1, False, 0, "a"), (2, None, None, "thirty days net price"), (3, False, 2, "b"), (4, True, 1, "net price"), (5, False, 1, None), (6, True, 0, "c")], "query_id long, comparing boolean, n_targets int, text string")
    got = {r.query_id: r for r in reranking.signals(asked, chunks, agreeing, other, fused).collect()}
    assert {q: r.level for q, r in got.items()} == {1: "LOW", 2: "HIGH", 3: "LOW", 4: "HIGH", 5: "HIGH", 6: "LOW"}
    assert got[2].triggers == "many_documents; narrow_margin" and got[2].margin == 0.0001 and got[2].n_documents == 4 and got[2].agreement == 1.0
    assert got[4].triggers == "amendment_or_comparison; low_agreement" and got[5].triggers == "low_agreement"
    assert got[1].triggers == "clear_margin_and_agreement" and (got[6].triggers, got[6].agreement, got[6].margin) == ("empty_candidates", 1.0, 0.0)
    table = reranking.signals(asked, chunks, agreeing, other, fused)
    top = reranking.reranked(asked, chunks, fused, table.filter("level = 'HIGH'"), 2).collect()
    said = {(r.query_id, r.rank): (r.chunk_id, r.score, r.is_reranked) for r in top}
    # of 7 (four words, three pairs) c0 has three words and a pair, c1 two words and a pair, c4 one word
    assert said[2, 1] == ("c0", round(4 / 7, 6), True) and said[2, 2] == ("c1", round(3 / 7, 6), True)
    assert said[1, 1] == ("c0", 0.9, False) and said[1, 2] == ("c6", 0.8, False) and said[5, 1] == ("c0", 0.0, True)
    report = reranking.rerank_report(table).first()
    assert (report.n_questions, report.n_reranked, report.rerank_rate, report.n_low_agreement, report.n_empty_candidates) == (6, 3, 0.5, 2, 1)
    assert reranking.rerank_report(table.limit(0)).first().rerank_rate == 0.0


def test_a_graph_that_holds_and_one_without_anything(spark):
    box = f"node_id string, box {provenance.BOX}"
    nodes = spark.createDataFrame([("a", (0.0, 0.0, 1.0, 1.0)), ("b", None)], box)
    edges = spark.createDataFrame([("e", "a", "b")], "edge_id string, source string, target string")
    facts = spark.createDataFrame([("f", 1, "b1", (0.0, 0.0, 0.0, 0.0))], f"fact_id string, document_id long, block_id string, box {provenance.BOX}")
    blocks = spark.createDataFrame([(1, "b1"), (1, "b1")], "document_id long, block_id string")
    found = provenance.findings(nodes, edges, facts, blocks)
    assert found.count() == 0
    row = provenance.report(nodes, edges, facts, found).first()
    assert row.is_valid and row.provenance_coverage == 1.0 and row.total_facts == 1
    none = provenance.report(nodes.limit(0), edges.limit(0), facts.limit(0), found).first()
    assert none.is_valid and (none.provenance_coverage, none.orphan_edge_rate) == (1.0, 0.0)
    lost = provenance.findings(nodes.limit(1), spark.createDataFrame([("e", "a", "a"), ("g", None, "z")], "edge_id string, source string, target string"), facts, blocks.limit(0))
    assert sorted((r.id, r.finding, r.is_error) for r in lost.collect()) == [("e", "self_loop", False), ("f", "unknown_block", False), ("g", "orphan_source", True), ("g", "orphan_target", True)]


def test_section_extents(spark):
    rows = [
        (1, 1, 0, "a", "before"), (1, 1, 1, "b", "SECTION 1. Terms"), (1, 3, 0, "c", "words"), (1, 4, 0, "d", "LIMITATION OF LIABILITY"), (1, 4, 1, "e", "2.1 More Words"), (1, 6, 0, "f", None),
        (2, 1, 0, "a", "no heading"), (3, 2, 0, "h", "TERM"),
    ]
    blocks = spark.createDataFrame(rows, "document_id long, page_number int, reading_order int, block_id string, text string")
    typed = blocks.withColumn("block_type", ingest.block_type(blocks["text"]))
    got = ingest.section_extents(typed).orderBy("document_id", "n").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "SECTION 1", "Terms", 1, 4, "a,b,c"), (1, 2, "LIMITATION OF LIABILITY", "Limitation Of Liability", 4, 4, "d"), (1, 3, "2.1", "More Words", 4, 6, "e,f"), (3, 1, "TERM", "Term", 2, 2, "h"),
    ]


def test_top_actors_of_equal_counts_are_those_seen_first(spark):
    rows = [(d, 0, u, a, "ongoing") for d, u, a in [(3, 0, "late"), (1, 1, "first"), (1, 0, "zero"), (2, 0, "often"), (4, 0, "often")]] + [(9, 0, k, f"a{k}", "recurring") for k in range(20)]
    got = registry.top_actors(spark.createDataFrame(rows, "document_id long, reading_order int, unit int, actor string, temporal_type string"), 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString(), "each task keeps its own best before the shuffle"
    held = {}
    for r in got.orderBy("temporal_type", "rank").collect():
        held.setdefault(r.temporal_type, []).append((r.actor, r.n_obligations))
    assert held == {"ongoing": [("often", 2), ("zero", 1), ("first", 1)], "recurring": [("a0", 1), ("a1", 1), ("a2", 1)], "all": [("often", 2), ("zero", 1), ("first", 1)]}


def test_frequent_terms_split_over_tasks_give_the_same_rankings(spark, monkeypatch):
    from pyspark.sql import functions as F

    from covenantry.operators import retrieval

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", F.substring("text", 1, 30).alias("title"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    made = lambda: [sorted(map(tuple, df.collect())) for df in (retrieval.bm25(docs, asked, 7), retrieval.overlap(docs, asked, 7), retrieval.ranked(retrieval.scores(docs, asked), 7))]
    few = made()
    monkeypatch.setattr(retrieval, "SMALL", 0)
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    monkeypatch.setattr(retrieval, "HOT", 9)
    assert made() == few and all(few)
