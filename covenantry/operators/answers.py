"""Evidence ranked for questions, reports on the claims of answers, and how hard a question's ranking is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import tokens

# Words of a question that say nothing of its subject; how much evidence an answer gets; thresholds of difficulty.
QUESTION_WORDS = ("what", "which", "when", "where", "how", "the", "and", "for", "with", "this", "that", "contract", "agreement", "clause")
MOST_EVIDENCE = 8
MOST_LINES, SHORTEST_LINE = 4, 25
NARROW_MARGIN, LOW_AGREEMENT, DEPTH = 0.003, 0.20, 5
#: The first status that a claim of the answer has is the answer's.
PRECEDENCE = ("INSUFFICIENT_EVIDENCE", "CONTRADICTED", "UNSUPPORTED", "PARTIALLY_SUPPORTED", "SUPPORTED")


def question_words(text: Column) -> Column:
    """The different words of three letters or more that say what a question is about."""
    return F.array_distinct(F.filter(tokens(text), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*QUESTION_WORDS)))


def rank_evidence(questions: DataFrame, spans: DataFrame, k: int = MOST_EVIDENCE) -> DataFrame:
    """query_id, span_id, hits, evidence_id (E1 ... Ek) of spans (query_id, span_id, position, text) for questions (query_id, text).

    hits: different words of the question found in the span; spans of equal hits keep their order. A null
    text has no hits."""
    joined = spans.join(questions.select("query_id", question_words(F.col("text")).alias("_words")), "query_id")
    text = F.lower("text")
    hits = F.coalesce(F.size(F.filter("_words", lambda w: text.contains(w))), F.lit(0))
    hits = F.when(F.col("text").isNull() | F.col("_words").isNull(), 0).otherwise(hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "position", "span_id")
    found = joined.select("query_id", "span_id", "position", hits.alias("hits")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return found.select("query_id", "span_id", F.col("hits").cast("long").alias("hits"), F.concat(F.lit("E"), F.col("_n").cast("string")).alias("evidence_id"))


def answer_reports(claims: DataFrame) -> DataFrame:
    """answer_id, n_claims, a count for each status, support_rate, overall status and fully_grounded from claims (answer_id, status)."""
    count = {s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in PRECEDENCE}
    rows = claims.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_claims"), *count.values())
    overall = reduce(lambda out, s: F.when(F.col(f"n_{s.lower()}") > 0, s).otherwise(out), reversed(PRECEDENCE), F.lit("INSUFFICIENT_EVIDENCE"))
    return rows.withColumns({
        "support_rate": F.round(F.col("n_supported") / F.col("n_claims"), 4), "overall_status": overall, "fully_grounded": F.col("n_supported") == F.col("n_claims"),
    })


def difficulty(lexical: DataFrame, other: DataFrame, fused: DataFrame) -> DataFrame:
    """query_id, margin, agreement, level (HIGH or LOW) of questions, from rankings (query_id, chunk_id, score, rank).

    HIGH if the two best fused scores are close, or the heads of the two other rankings share little."""
    head = lambda df, side: df.filter(F.col("rank") <= DEPTH).select("query_id", "chunk_id", F.lit(side).alias("side"))
    texts = head(lexical, 1).unionByName(head(other, 2)).groupBy("query_id", "chunk_id").agg(F.count_distinct("side").alias("n"))
    agreed = texts.groupBy("query_id").agg((F.count_if(F.col("n") == 2) / F.count(F.lit(1))).alias("agreement"))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    margins = fused.groupBy("query_id").agg((at(1) - F.coalesce(at(2), F.lit(0.0))).alias("margin"))
    hard = (F.col("margin") < NARROW_MARGIN) | (F.col("agreement") < LOW_AGREEMENT)
    return margins.join(agreed, "query_id").select(
        "query_id", F.round("margin", 9).alias("margin"), F.round("agreement", 6).alias("agreement"), F.when(hard, "HIGH").otherwise("LOW").alias("level"),
    )


def inline_claims(answer: Column) -> Column:
    """array<struct<claim, evidence_ids>> of the sentences of an answer that cite evidence as [E1]; empty without a citation, null for null."""
    ends = F.regexp_replace(answer, r"([.!?](\[E[0-9]+\])*)\s+", "$1\u001e")
    sentences = F.filter(F.split(ends, "\u001e"), lambda s: s.rlike(r"\[E[0-9]+\]"))
    bare = lambda s: F.trim(F.regexp_replace(s, r"\s*\[E[0-9]+\]", ""))
    ids = lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(r"\[(E[0-9]+)\]"), F.lit(1)))
    return F.transform(sentences, lambda s: F.struct(bare(s).alias("claim"), ids(s).alias("evidence_ids")))


def extract_lines(questions: DataFrame, spans: DataFrame, k: int = MOST_LINES) -> DataFrame:
    """query_id, n, span_id, line_number, hits, line: the lines of a question's evidence that hold most of its words; an answer that quotes only.

    Lines of up to 25 characters and lines without a word of the question are left out; a question without
    such a line has no row, which is a refusal."""
    said = questions.select("query_id", question_words(F.col("text")).alias("_words"))
    lines = spans.select("query_id", "span_id", "position", F.posexplode(F.split("text", "\n")).alias("line_number", "line")).withColumn("line", F.trim("line")).filter(F.length("line") > SHORTEST_LINE)
    low = F.lower("line")
    rows = lines.join(said, "query_id").withColumn("hits", F.size(F.filter("_words", lambda w: low.contains(w))).cast("long")).filter("hits > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "position", "line_number", "span_id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query_id", "n", "span_id", F.col("line_number").cast("int").alias("line_number"), "hits", "line")


def bundle(citations: DataFrame) -> DataFrame:
    """query_id, document_id, page_number, reading_order, first_rank, n_sources, sources of citations (the first four, source, rank).

    A block that several chunks of a question bring counts once, at its first rank; ``sources`` are their
    ids in order. They are as many as the chunks that a question retrieves."""
    keys = ["query_id", "document_id", "page_number", "reading_order"]
    rows = citations.groupBy(*keys).agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_set("source")).alias("_s"))
    return rows.select(*keys, "first_rank", F.size("_s").cast("long").alias("n_sources"), F.array_join(F.transform("_s", lambda x: x.cast("string")), ",").alias("sources"))
