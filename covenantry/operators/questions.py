"""Questions are a table: the intent of each, and the evaluation of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def intent(question: Column) -> Column:
    """The first rule that holds decides; information if none does, null for null."""
    text = F.lower(question)
    has = lambda words: reduce(lambda a, b: a | b, (text.contains(w) for w in words))
    rules = reversed([(name, [has(group) for group in groups]) for name, groups in P.INTENTS])
    found = reduce(lambda out, r: F.when(reduce(lambda a, b: a & b, r[1]), r[0]).otherwise(out), rules, F.lit("information"))
    return F.when(question.isNotNull(), found)


def evaluate(ranked: DataFrame) -> DataFrame:
    """n_queries, hit_1, hit_3, hit_5, mrr of rows (query_id, rank, relevant); a query without a relevant row counts as a miss."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("at"))
    hit = lambda k: F.round(F.avg(F.when(F.col("at") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_{k}")
    return first.agg(F.count(F.lit(1)).alias("n_queries"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))), 4).alias("mrr"))
