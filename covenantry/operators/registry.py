"""The registry of contracts: a row for each, totals, and lookups by party and term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Facts kept as rows, the score from which a contract is a high risk, and how many actors a distribution names.
PREDICATES = ("contract_type", "effective_date", "renewal", "payment_days", "notice_days", "governing_law")
HIGH_SCORE, TOP_ACTORS = 40, 5


def summaries(blocks: DataFrame, facts: DataFrame, obligations: DataFrame) -> DataFrame:
    """document_id, contract_type, governing_law, payment_term, n_pages, n_obligations of every document."""
    pages = blocks.groupBy("document_id").agg(F.max("page_number").cast("long").alias("n_pages"))
    held = obligations.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_obligations"))
    rows = pages.join(facts, "document_id", "left").join(held, "document_id", "left")
    term = F.concat(F.lit("Net "), F.col("payment_days").cast("string"))
    return rows.select(
        "document_id", F.coalesce("contract_type", F.lit("Agreement")).alias("contract_type"), F.coalesce("governing_law", F.lit("Unspecified")).alias("governing_law"),
        F.coalesce(term, F.lit("Standard / Unspecified")).alias("payment_term"), "n_pages", F.coalesce("n_obligations", F.lit(0)).cast("long").alias("n_obligations"),
    )


def totals(found: DataFrame, events: DataFrame, scores: DataFrame) -> DataFrame:
    """metric, value: contracts, pages, obligations, events, risk signals and contracts of high risk."""
    sums = found.agg(F.count(F.lit(1)).alias("contracts"), F.coalesce(F.sum("n_pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("n_obligations"), F.lit(0)).alias("obligations"))
    risk = scores.agg(F.coalesce(F.sum("n_signals"), F.lit(0)).alias("signals"), F.count_if(F.col("risk_score") >= HIGH_SCORE).alias("high_risk"))
    as_rows = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns))))
    return as_rows(sums).unionByName(as_rows(risk)).unionByName(as_rows(events.agg(F.count(F.lit(1)).alias("events"))))


def fact_rows(facts: DataFrame) -> DataFrame:
    """subject_id, predicate, value: one row for each fact that was found."""
    pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), F.col(p).cast("string").alias("value")) for p in PREDICATES))
    return facts.select(F.concat(F.lit("contract_"), F.col("document_id").cast("string")).alias("subject_id"), F.inline(pairs)).filter("value IS NOT NULL")


def contracts_with(rows: DataFrame, predicate: str, value: str) -> DataFrame:
    """subject_id of the facts (``fact_rows``) that equal a value."""
    return rows.filter((F.col("predicate") == predicate) & (F.col("value") == value)).select("subject_id").distinct()


def contracts_of(edges: DataFrame, key: str) -> DataFrame:
    """subject_id of the contracts with a party whose key has ``key`` in it."""
    return edges.filter((F.col("relationship") == "HAS_PARTY") & F.col("target").contains(key)).select(F.col("source").alias("subject_id")).distinct()


def obligation_distribution(obligations: DataFrame) -> DataFrame:
    """actor, temporal_type, n_obligations, n_documents."""
    # a count for each document first, so that a frequent actor is summed before the shuffle on it
    each = obligations.groupBy("actor", "temporal_type", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("actor", "temporal_type").agg(F.sum("n").alias("n_obligations"), F.count(F.lit(1)).alias("n_documents"))


def top_actors(obligations: DataFrame, k: int = TOP_ACTORS) -> DataFrame:
    """temporal_type ("all" for all together), rank, actor, n_obligations of the ``k`` actors with the most obligations; of equally many the one seen first.

    Counts are summed before the shuffle, and every task keeps its own best ``k`` of a type before the last one ranks those."""
    seen = F.min(F.struct("document_id", "reading_order", "unit"))
    each = obligations.groupBy("temporal_type", "actor").agg(F.count(F.lit(1)).alias("n"), seen.alias("seen"))
    whole = each.groupBy("actor").agg(F.sum("n").alias("n"), F.min("seen").alias("seen")).select(F.lit("all").alias("temporal_type"), "actor", "n", "seen")
    order = Window.partitionBy("temporal_type").orderBy(F.desc("n"), "seen", "actor")
    ranked = each.unionByName(whole).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("temporal_type", "rank", "actor", F.col("n").alias("n_obligations"))
