"""Metrics of retrieval, evidence and answers over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import running_sum


def folded(text: Column) -> Column:
    """Lower case, white space (also no-break space) as one space."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("\xa0"), F.lit(" "))), r"\s+", " "))


def requirement_ranks(ranked: DataFrame, chunks: DataFrame, required: DataFrame) -> DataFrame:
    """query_id, requirement_id, rank (the first chunk of the right document that has all phrases; null if none), on_page.

    ranked: query_id, chunk_id, rank; chunks: chunk_id, document_id, page_start, page_end, text; required: query_id,
    requirement_id, document_id, phrases, pages."""
    rows = ranked.join(chunks.select("chunk_id", "document_id", "page_start", "page_end", "text"), "chunk_id")
    met = required.join(rows, ["query_id", "document_id"])
    has = F.forall("phrases", lambda p: folded(F.col("text")).contains(folded(p)))
    first = met.filter(has).groupBy("query_id", "requirement_id").agg(F.min(F.struct("rank", F.arrays_overlap(F.sequence("page_start", "page_end"), F.col("pages")).alias("on_page"))).alias("at"))
    return required.select("query_id", "requirement_id").join(first, ["query_id", "requirement_id"], "left").select("query_id", "requirement_id", F.col("at.rank").alias("rank"), F.col("at.on_page").alias("on_page"))


def question_results(questions: DataFrame, ranks: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, category, answerable, first_rank, contained, provenance, failure of every question (query_id, category, answerable)."""
    held = ranks.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.min(F.col("rank").isNotNull()).alias("all_met"), F.min(F.coalesce("on_page", F.lit(True))).alias("pages_right"))
    rows = questions.join(held, "query_id", "left").join(ranked.select("query_id").distinct().withColumn("any", F.lit(True)), "query_id", "left")
    contained = F.col("answerable") & F.coalesce("all_met", F.lit(True))
    failure = F.when(~F.col("answerable"), "unanswerable_query").when(F.coalesce(F.col("first_rank") <= 10, F.lit(False)), None).when(F.col("any").isNull(), "empty_retrieval").otherwise("semantic_lexical_mismatch")
    return rows.select("query_id", "category", "answerable", F.when(F.col("answerable"), F.col("first_rank")).alias("first_rank"), contained.alias("contained"), (contained & F.coalesce("pages_right", F.lit(True))).alias("provenance"), failure.alias("failure"))


def retrieval_metrics(results: DataFrame) -> DataFrame:
    """category (ALL: of all), n_questions, n_answerable, hit_1, hit_3, hit_5, hit_10, mrr, containment, provenance; a rate of none is 0."""
    asked = F.count_if("answerable")
    rate = lambda c: F.round(F.coalesce(F.sum(F.when(F.col("answerable"), c)) / F.nullif(asked, F.lit(0)), F.lit(0.0)), 4)
    hit = lambda k: rate(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}")
    both = results.select("*", F.explode(F.array("category", F.lit("ALL"))).alias("of"))
    return both.groupBy(F.col("of").alias("category")).agg(
        F.count(F.lit(1)).alias("n_questions"), asked.alias("n_answerable"), hit(1), hit(3), hit(5), hit(10), rate(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
        rate(F.col("contained").cast("double")).alias("containment"), rate(F.col("provenance").cast("double")).alias("provenance"),
    )


def evidence_metrics(spans: DataFrame, required: DataFrame, resolved: DataFrame) -> DataFrame:
    """n_requirements, document_accuracy, page_accuracy, phrase_containment (any phrase in any span), box_validity.

    spans: query_id, document_id, page_number, text; resolved: status. A rate of none is 1 for boxes, else 0."""
    rows = required.join(spans.select("query_id", F.col("document_id").alias("d"), "page_number", F.col("text").alias("t")), "query_id", "left")
    right = F.col("d") == F.col("document_id")
    says = right & F.exists("phrases", lambda p: folded(F.col("t")).contains(folded(p)))
    each = rows.groupBy("query_id", "requirement_id").agg(*(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in (("doc", right), ("page", right & F.array_contains("pages", F.col("page_number"))), ("says", says))))
    rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 4)
    boxes = resolved.filter("status != 'MISSING_PROVENANCE'").agg(F.round(F.coalesce(F.avg((F.col("status") != "INVALID_BBOX").cast("double")), F.lit(1.0)), 4).alias("box_validity"))
    return each.agg(F.count(F.lit(1)).alias("n_requirements"), rate("doc").alias("document_accuracy"), rate("page").alias("page_accuracy"), rate("says").alias("phrase_containment")).join(F.broadcast(boxes))  # a row each


def answer_metrics(answers: DataFrame, by: str | None = None) -> DataFrame:
    """n_answers, status counts, refusal_rate, support_rate, grounded_rate of answers (answerable, overall_status, fully_grounded), of all or by a column.

    An unanswerable question is handled if its answer is a refusal (INSUFFICIENT_EVIDENCE); handled_rate is over those."""
    refused, n = F.col("overall_status") == "INSUFFICIENT_EVIDENCE", F.count(F.lit(1))
    share = lambda c, of: F.round(F.coalesce(F.count_if(c) / F.nullif(of, F.lit(0)), F.lit(0.0)), 4)
    made = [
        n.alias("n_answers"), F.count_if(F.col("overall_status") == "SUPPORTED").alias("n_supported"), F.count_if(F.col("overall_status") == "CONTRADICTED").alias("n_contradicted"),
        share(refused, n).alias("refusal_rate"), share(F.col("overall_status") == "SUPPORTED", n).alias("support_rate"), share(F.col("fully_grounded"), n).alias("grounded_rate"),
        share(refused & ~F.col("answerable"), F.count_if(~F.col("answerable"))).alias("handled_rate"),
    ]
    return answers.groupBy(by).agg(*made) if by else answers.agg(*made)


def containment(chunks: DataFrame, required: DataFrame) -> DataFrame:
    """query_id, requirement_id, outcome: single_chunk (one has all phrases), split (together they have), or not_found.

    chunks: document_id, text; required: query_id, requirement_id, document_id, phrases."""
    text = folded(F.col("text"))
    rows = required.join(chunks.select("document_id", "text"), "document_id", "left")
    seen = rows.select("query_id", "requirement_id", F.size("phrases").alias("n"), F.filter("phrases", lambda p: F.coalesce(text.contains(folded(p)), F.lit(False))).alias("has"))
    one = seen.groupBy("query_id", "requirement_id").agg(F.first("n").alias("n"), F.max(F.size("has") == F.col("n")).alias("single"), F.size(F.array_distinct(F.flatten(F.collect_set("has")))).alias("together"))
    return one.select("query_id", "requirement_id", F.when(F.col("single"), "single_chunk").when(F.col("together") == F.col("n"), "split").otherwise("not_found").alias("outcome"))


def nearest_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """p: the value at place int(n * share) of the sorted ones, from 0; null of none. Values are counted first, then the counts are added up by ranges."""
    counted = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v IS NOT NULL")
    total = counted.agg(F.sum("n").alias("all"))
    rows = running_sum(counted, "v", of="n", name="upto").join(F.broadcast(total))  # one row
    at = F.least(F.floor(F.col("all") * share), F.col("all") - 1)
    return rows.filter(F.col("upto") > at).agg(F.min("v").alias("p"))
