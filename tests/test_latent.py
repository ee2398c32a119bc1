from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from covenantry.operators import latent, retrieval
from covenantry.plans import ranking


def _made(df, name):
    return df.select(F.col(name).alias("id"), latent.terms(retrieval.tokens(F.coalesce("text", F.lit("")))).alias("terms"))


def test_terms(spark):
    row = spark.createDataFrame([("The net price of the goods is 5 x net",)], "text string").select(latent.terms(retrieval.tokens(F.col("text"))).alias("t")).first()
    assert row.t == ["net", "price", "goods", "net", "net price", "price goods", "goods net"]
    rows = spark.createDataFrame([("a",), ("",), ("law",), (None,)], "text string").select(latent.terms(retrieval.tokens(F.coalesce("text", F.lit("")))).alias("t")).collect()
    assert [r.t for r in rows] == [[], [], ["law"], []]


def test_space_and_recall_against_an_exact_decomposition(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    features, dimensions, k = 1500, 20, 10
    known, n = latent.vocabulary(_made(docs, "chunk_id"), features)
    held = latent.sparse_rows(_made(docs, "chunk_id").repartition(5), known).cache()
    rows = held.orderBy("id").collect()

    def dense(found):
        out = np.zeros((len(found), len(known)))
        for r, own in zip(found, out, strict=True):
            own[r.ids] = r.weights
        return out

    # weights from their definition
    terms = {r.id: r.terms for r in _made(docs, "chunk_id").collect()}
    df = {}
    for t in terms.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    for r in rows[:20]:
        want = {known[x][0]: (1 + np.log(terms[r.id].count(x))) * (1 + np.log((1 + n) / (1 + df[x]))) for x in set(terms[r.id]) if x in known}
        length = np.sqrt(sum(w * w for w in want.values())) or 1
        assert r.ids == sorted(want) and np.allclose(r.weights, [want[i] / length for i in r.ids])
    a = dense(rows)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    basis = latent.space(held, len(known), n, dimensions)
    assert basis.shape == (len(known), dimensions) and np.allclose(basis.T @ basis, np.eye(dimensions), atol=1e-9)
    assert (np.linalg.norm(a @ basis, axis=0) >= 0.98 * values[:dimensions]).all()
    angles = np.linalg.svd(right[: dimensions // 2] @ basis)[1]  # cosines: the first half of the exact directions lie in the space found
    assert angles.min() > 0.99
    # rankings by the exact space
    exact = right[:dimensions].T
    there, queries = a @ exact, dense(latent.sparse_rows(_made(asked, "query_id"), known).orderBy("id").collect()) @ exact
    there, queries = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (there, queries))
    ids, names = [r.id for r in rows], [r.query_id for r in asked.orderBy("query_id").collect()]
    score = queries @ there.T
    got = {}
    for r in retrieval.lsa(docs, asked, k, dimensions, features).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    hits = total = 0
    for name, own in zip(names, score, strict=True):
        best = {ids[i] for i in np.argsort(-own, kind="stable")[:k] if own[i] > 0}
        hits, total = hits + len(best & got.get(name, set())), total + len(best)
    assert hits / total >= 0.95, hits / total
    assert ranking.latent_top(spark, sf).count() > 0


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "words"), (2, None)], "query_id long, text string")
    assert retrieval.lsa(none, asked, 3).count() == 0
    assert retrieval.lsa(spark.createDataFrame([(5, "the of"), (6, None)], "chunk_id long, text string"), asked, 3).count() == 0
    got = retrieval.lsa(spark.createDataFrame([(5, "words here"), (6, None), (7, "other things")], "chunk_id long, text string"), asked, 3).collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in got] == [(1, 5, 1)]
