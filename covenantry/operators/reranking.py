"""A second look at hard questions alone: signals of difficulty decide which pools are compared with whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import SMALL, ranked, tokens

# Limits of the signals, how deep rankings are compared, and how many times the answer's size a reranked pool has.
NARROW_MARGIN, LOW_AGREEMENT, MANY_DOCUMENTS, DEPTH, POOLS = 0.003, 0.20, 3, 5, 2
CLEAR, EMPTY = "clear_margin_and_agreement", "empty_candidates"


def signals(questions: DataFrame, chunks: DataFrame, first: DataFrame, second: DataFrame, fused: DataFrame) -> DataFrame:
    """query_id, top_score, margin, n_documents, agreement, level (HIGH or LOW), triggers of questions (query_id, comparing, n_targets).

    first, second, fused: rankings (query_id, chunk_id, score, rank) with ``DEPTH`` chunks at least. HIGH if the question is about amendments or a comparison
    (``comparing``), if it is bound to no more than one document and the fused head has ``MANY_DOCUMENTS`` or more, if the two best fused scores are close, or if the heads of the two
    rankings share little. A question without candidates is LOW."""
    head = fused.filter(F.col("rank") <= DEPTH).select("query_id", "chunk_id", "score", "rank").join(chunks.select("chunk_id", "document_id"), "chunk_id", "left")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    best = head.groupBy("query_id").agg(at(1).alias("top_score"), at(2).alias("second_score"), F.count_distinct("document_id").alias("n_documents"))
    sides = lambda df, side: df.filter(F.col("rank") <= DEPTH).select("query_id", "chunk_id", F.lit(side).alias("side"))
    both = sides(first, 1).unionByName(sides(second, 2)).groupBy("query_id", "chunk_id").agg(F.count_distinct("side").alias("n"))
    agreed = both.groupBy("query_id").agg((F.count_if(F.col("n") == 2) / F.count(F.lit(1))).alias("agreement"))
    rows = questions.select("query_id", F.coalesce("comparing", F.lit(False)).alias("comparing"), F.coalesce("n_targets", F.lit(0)).alias("n_targets")).join(best, "query_id", "left").join(agreed, "query_id", "left")
    margin, agreement = F.round(F.col("top_score") - F.coalesce("second_score", F.lit(0.0)), 9), F.round(F.coalesce("agreement", F.lit(1.0)), 6)
    found = F.array_compact(F.array(
        F.when(F.col("comparing"), "amendment_or_comparison"), F.when((F.col("n_targets") <= 1) & (F.col("n_documents") >= MANY_DOCUMENTS), "many_documents"),
        F.when(F.col("second_score").isNotNull() & (margin < NARROW_MARGIN), "narrow_margin"), F.when(agreement < LOW_AGREEMENT, "low_agreement"),
    ))
    none = F.col("top_score").isNull()
    return rows.select(
        "query_id", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce(margin, F.lit(0.0)).alias("margin"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.when(none, 1.0).otherwise(agreement).alias("agreement"),
        F.when(~none & (F.size(found) > 0), "HIGH").otherwise("LOW").alias("level"), F.when(none, EMPTY).when(F.size(found) == 0, CLEAR).otherwise(F.array_join(found, "; ")).alias("triggers"),
    )


def _said(text: Column) -> Column:
    """Different tokens, and pairs of tokens that follow each other."""
    pairs = lambda t: F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(tokens(F.coalesce(text, F.lit("")))), lambda t: F.array_distinct(F.concat(t, pairs(t)))), 1)


def reranked(questions: DataFrame, chunks: DataFrame, fused: DataFrame, hard: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank, is_reranked: the best ``k`` chunks (chunk_id, text) of questions (query_id, text).

    The first 2k fused chunks of a question in ``hard`` (query_id) are compared with its original words over their whole texts: the share of its tokens and of its pairs of
    neighbouring tokens that a chunk has, which stands where a trained cross-encoder could. All other questions keep their fused ranking, and no text is read for them."""
    pool = fused.filter(F.col("rank") <= POOLS * k).join(hard.select("query_id"), "query_id", "left_semi").select("query_id", "chunk_id", F.col("rank").alias("before"))
    pool = pool.join(questions.select("query_id", _said(F.col("text")).alias("asked")), "query_id")
    # texts stay where they are: up to SMALL places of pools come to them
    few = pool.limit(SMALL + 1).count() <= SMALL
    words = chunks.select("chunk_id", "text").join(F.broadcast(pool) if few else pool, "chunk_id")
    share = F.round(F.size(F.array_intersect("asked", _said(F.col("text")))) / F.nullif(F.size("asked"), F.lit(0)), 6)
    again = ranked(words.select("query_id", "chunk_id", F.coalesce(share, F.lit(0.0)).alias("score"), "before"), k, "before").withColumn("is_reranked", F.lit(True))
    easy = fused.filter(F.col("rank") <= k).join(hard.select("query_id"), "query_id", "left_anti").withColumn("is_reranked", F.lit(False))
    columns = ["query_id", "chunk_id", "score", "rank", "is_reranked"]
    return again.select(*columns).unionByName(easy.select(*columns))


def rerank_report(found: DataFrame) -> DataFrame:
    """n_questions, n_reranked, rerank_rate (0 of none), and how many questions each trigger of ``signals`` has."""
    has = lambda t: F.count_if(F.array_contains(F.split("triggers", "; "), t)).alias(f"n_{t}")
    hard = F.count_if(F.col("level") == "HIGH")
    rate = F.round(F.coalesce(hard / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 4)
    return found.agg(F.count(F.lit(1)).alias("n_questions"), hard.alias("n_reranked"), rate.alias("rerank_rate"), *(has(t) for t in ("amendment_or_comparison", "many_documents", "narrow_margin", "low_agreement", EMPTY)))
