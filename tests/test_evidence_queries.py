from __future__ import annotations

import pytest

from covenantry.operators import citing, measuring, retrieval
from covenantry.plans import evidence as E
from tests.oracle import compare

SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", E.queries()[name], SQL[name])


CHUNKS = [
    ("chk_001", "doc_alpha", "Section 3. Payment Terms. Invoices shall be paid net 30 days following receipt.", "Payment Terms"),
    ("chk_002", "doc_alpha", "Section 4. Termination. Either party may terminate upon thirty (30) days prior written notice.", "Termination"),
    ("chk_003", "doc_beta", "Governing Law. This Agreement shall be governed by the laws of the State of Delaware.", "Governing Law"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, text string, title string")


def asked(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, text string")


def test_small_index(spark, chunks):
    top = retrieval.ranked(retrieval.scores(chunks, asked(spark, "payment net 30 days")).filter("score > 0"), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in top][0] == "chk_001" and len(top) == 2 and top[0].score > top[1].score
    law = retrieval.lsa(chunks, asked(spark, "Delaware laws governing"), 1).collect()
    assert law[0].chunk_id == "chk_003" and 0 <= law[0].score <= 1.0001
    notice = retrieval.adaptive(spark.createDataFrame([(1, "information", "termination written notice")], "query_id long, intent string, expanded string"), chunks, spark.createDataFrame([], "query_id long, document_id string"), 2)
    assert notice.orderBy("rank").first().chunk_id == "chk_002"
    bound = spark.createDataFrame([(1, "doc_alpha")], "query_id long, document_id string")
    assert {r.chunk_id for r in retrieval.within(retrieval.scores(chunks, asked(spark, "laws section")), chunks, bound).collect()} <= {"chk_001", "chk_002"}
    assert retrieval.scores(chunks, asked(spark, "   ")).count() == 0 == retrieval.scores(chunks.limit(0), asked(spark, "laws")).count()


def test_exact_tokens_and_title_only_hits(spark, chunks):
    row = spark.createDataFrame([("Pay $1,000.50 net-30, or v2.1.",)], "t string").select(retrieval.exact_tokens("t").alias("t")).first()
    assert row.t == ["pay", "1", "000.50", "net-30", "or", "v2.1"]
    titled = spark.createDataFrame([("a", "d", "nothing here", "Warranty"), ("b", "d", "else", None)], "chunk_id string, document_id string, text string, title string")
    assert [(r.chunk_id, r.score) for r in retrieval.scores(titled, asked(spark, "warranty warranty")).collect()] == [("a", 1.0)]


def test_cosine_in_blocks_of_queries(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(50)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    v = spark.createDataFrame(rows, "chunk_id long, v array<double>")
    q = v.filter("chunk_id % 9 = 0 OR chunk_id >= 60").withColumnRenamed("chunk_id", "query_id")
    whole = sorted(map(tuple, retrieval.cosine(v, q, 4).collect()))
    assert whole == sorted(map(tuple, retrieval.cosine(v, q, 4, block=2).collect())) and len(whole) == 6 * 4
    assert retrieval.cosine(v, q.limit(0), 4).count() == 0


def test_boxes_and_metrics_of_nothing(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [((5.0, 0.0, 1.0, 1.0),), ((0.0, 5.0, 1.0, 1.0),), ((-1.0, 0.0, 1.0, 1.0),), ((0.0, 0.0, 700.0, 1.0),), ((0.0, 0.0, 1.0, 900.0),), ((0.0, 0.0, 615.0, 800.0),)]
    got = spark.createDataFrame(rows, f"b {box}").selectExpr("b", "612.0D AS w", "792.0D AS h")
    reasons = [r.r for r in got.select(citing.box_reason(got.b, got.w, got.h).alias("r")).collect()]
    assert reasons == ["x0 beyond x1", "y0 beyond y1", "negative", "beyond page width", "beyond page height", None]
    none = spark.createDataFrame([], "query_id long, category string, answerable boolean, first_rank int, contained boolean, provenance boolean, failure string")
    assert measuring.retrieval_metrics(none).count() == 0
    assert measuring.nearest_rank(spark.createDataFrame([], "x double"), "x", 0.95).first().p is None
    assert measuring.nearest_rank(spark.createDataFrame([(float(k),) for k in range(100)], "x double"), "x", 0.95).first().p == 95.0
