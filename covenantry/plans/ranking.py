"""Rankings in a latent space, and a second ranking of hard questions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reranking, retrieval
from ..sources.shared import stored
from . import evidence
from . import queries as base

POOL = 50
COMPARING = ("amendment", "comparison")


def latent_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Has no SQL: the space is an iteration. It is held against an exact decomposition."""
    return retrieval.lsa(*base._ranking_inputs(spark, sf_dir), base.TOP)


def _looked_at(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, chunks, the head of the fused ranking, and the signals of each question."""
    chunks, bound = evidence._chunks(spark, sf_dir), evidence._bound(spark, sf_dir)
    targets = bound.groupBy("query_id").agg(F.count_distinct("document_id").alias("n_targets"))
    asked = evidence._asked(spark, sf_dir).withColumn("text", F.col("expanded")).withColumn("comparing", F.col("intent").isin(*COMPARING)).join(targets, "query_id", "left")
    first, second, fused = retrieval.adaptive_pools(asked, chunks, bound, POOL)
    # each ranking is read for the signals and for the fused pool
    first, second = stored(first, "ranked"), stored(second, "ranked")
    fused = stored(retrieval.ranked(fused, max(reranking.DEPTH, reranking.POOLS * base.TOP)), "fused")
    return asked, chunks, fused, stored(reranking.signals(asked, chunks, first, second, fused), "signals")


def question_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_at(spark, sf_dir)[3]


def reranked_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks, fused, found = _looked_at(spark, sf_dir)
    return reranking.reranked(asked, chunks, fused, found.filter("level = 'HIGH'"), base.TOP)


def rerank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranking.rerank_report(question_signals(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (latent_top, question_signals, reranked_top, rerank_report)}


def oracle_sql() -> dict[str, str]:
    known = evidence.oracle_sql()["adaptive_top"]
    pools = known[: known.rindex("SELECT query_id, chunk_id, score, row_number() OVER")]
    bound = evidence.BOUND_SQL.format(benchmark="benchmark", documents="documents")
    depth, k = reranking.DEPTH, base.TOP
    said = lambda x: f"list_distinct(list_concat({x}, list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])))"
    words = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]+')"
    signals = f"""{pools},
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= {max(depth, reranking.POOLS * k)}),
b AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS one, max(score) FILTER (WHERE rank = 2) AS two, count(DISTINCT chunk_id) FILTER (WHERE rank <= {depth}) AS n_documents FROM fused GROUP BY 1),
g AS (SELECT query_id, count(*) FILTER (WHERE n = 2) / count(*) AS agreement FROM (SELECT query_id, chunk_id, count(*) AS n FROM (SELECT query_id, chunk_id FROM x WHERE rank <= {depth} UNION ALL SELECT query_id, chunk_id FROM y WHERE rank <= {depth}) GROUP BY ALL) GROUP BY 1),
q AS (SELECT query_id, intent IN ('amendment', 'comparison') AS comparing, expanded AS text, coalesce(n_targets, 0) AS n_targets FROM ({evidence.ASKED_SQL.format(benchmark="benchmark")}) LEFT JOIN (SELECT query_id, count(DISTINCT document_id) AS n_targets FROM ({bound}) GROUP BY 1) USING (query_id)),
r AS (SELECT *, round(one - coalesce(two, 0), 9) AS m, round(coalesce(agreement, 1), 6) AS a FROM q LEFT JOIN b USING (query_id) LEFT JOIN g USING (query_id)),
t AS (SELECT *, list_filter([CASE WHEN comparing THEN 'amendment_or_comparison' END, CASE WHEN n_targets <= 1 AND n_documents >= {reranking.MANY_DOCUMENTS} THEN 'many_documents' END,
  CASE WHEN two IS NOT NULL AND m < {reranking.NARROW_MARGIN} THEN 'narrow_margin' END, CASE WHEN a < {reranking.LOW_AGREEMENT} THEN 'low_agreement' END], lambda z: z IS NOT NULL) AS why FROM r),
found AS MATERIALIZED (SELECT query_id, coalesce(one, 0) AS top_score, coalesce(m, 0) AS margin, coalesce(n_documents, 0) AS n_documents, CASE WHEN one IS NULL THEN 1 ELSE a END AS agreement,
  CASE WHEN one IS NOT NULL AND len(why) > 0 THEN 'HIGH' ELSE 'LOW' END AS level, CASE WHEN one IS NULL THEN '{reranking.EMPTY}' WHEN len(why) = 0 THEN '{reranking.CLEAR}' ELSE array_to_string(why, '; ') END AS triggers FROM t)"""
    counts = ", ".join(f"count(*) FILTER (WHERE list_contains(string_split(triggers, '; '), '{t}')) AS n_{t}" for t in ("amendment_or_comparison", "many_documents", "narrow_margin", "low_agreement", reranking.EMPTY))
    return {
        "question_signals": f"{signals} SELECT * FROM found",
        "reranked_top": f"""{signals},
p AS (SELECT f.*, {said("w")} AS asked, {said("v")} AS has FROM (SELECT fused.*, {words("q.text")} AS w, {words("d.text")} AS v FROM fused JOIN found USING (query_id) JOIN q USING (query_id) JOIN documents d ON d.doc_id = chunk_id WHERE level = 'HIGH' AND rank <= {reranking.POOLS * k}) f),
h AS (SELECT query_id, chunk_id, round(coalesce(len(list_intersect(asked, has)) / nullif(len(asked), 0), 0), 6) AS score, rank AS was FROM p)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was)::INT AS rank, true AS is_reranked FROM h QUALIFY rank <= {k}
UNION ALL SELECT query_id, chunk_id, score, rank, false FROM fused JOIN found USING (query_id) WHERE level = 'LOW' AND rank <= {k}""",
        "rerank_report": f"{signals} SELECT count(*) AS n_questions, count(*) FILTER (WHERE level = 'HIGH') AS n_reranked, round(count(*) FILTER (WHERE level = 'HIGH') / count(*), 4) AS rerank_rate, {counts} FROM found",
    }
