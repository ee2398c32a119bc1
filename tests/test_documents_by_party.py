from __future__ import annotations

from covenantry.operators import amendments
from covenantry.plans import links
from tests.oracle import compare
from tests.plans import most_rows


def test_against_all_names(spark):
    names = [(1, "Alpha, Inc."), (2, "alpha, inc. "), (3, "Beta"), (4, "Gamma LLC"), (4, "GAMMA llc"), (5, "Delta of Beta"), (6, ""), (7, None), (8, "É"), (9, "x" * 300), (10, "aaa")]
    asked = ["alpha", "ALPHA, INC.", "the Gamma LLC company", "gamma", "beta", "delta", "é", "", " ", None, "nobody", "x" * 299, "x" * 400, "aaaa", "a", "Delta of Beta", "gamma"]
    parties, queries = spark.createDataFrame(names, "document_id long, name string"), spark.createDataFrame([(x,) for x in asked], "query string")

    def brute(q):
        if q is None:
            return None
        low = q.strip(" ").lower()
        hits = {d for d, n in names if n and n.strip() and (low in n.strip(" ").lower() or n.strip(" ").lower() in low)}
        return hits.pop() if len(hits) == 1 else None

    got = sorted((r.query or "", r.document_id) for r in amendments.documents_by_party(queries, parties).collect())
    assert got == sorted((q or "", brute(q)) for q in asked)
    none = amendments.documents_by_party(queries, parties.limit(0)).collect()
    assert len(none) == len(asked) and all(r.document_id is None for r in none)


def test_names_and_queries_make_no_pairs(spark):
    n = 2000
    parties = spark.range(n).selectExpr("id AS document_id", "concat('Customer#', lpad(id, 6, '0'), ', Inc.') AS name")
    queries = spark.range(n).selectExpr("concat('customer#', lpad(id, 6, '0')) AS query")
    df = amendments.documents_by_party(queries, parties)
    assert all(r.document_id == int(r.query[-6:]) for r in df.collect())
    assert most_rows(df) < 20 * n  # 2,000 names a query


def test_rows_match_sql(spark):
    compare(spark, "/root/testdata/sf0.01", links.queries()["documents_by_party"], links.oracle_sql()["documents_by_party"])
