"""References to blocks are validated; claims are held against the text they cite. Both are equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def validate_references(references: DataFrame, blocks: DataFrame) -> DataFrame:
    """``references`` (document_id, reading_order, page_number, ...) with ``status``.

    A block that is not there or lies on another page outranks a page that the document lacks; then a block without text."""
    pages = blocks.groupBy("document_id").agg(F.max("page_number").alias("_pages"))
    found = blocks.select("document_id", "reading_order", F.col("page_number").alias("_page"), F.col("text").alias("_text"))
    joined = references.join(pages, "document_id", "left").join(found, ["document_id", "reading_order"], "left")
    bad_page = F.col("_pages").isNull() | F.col("page_number").isNull() | (F.col("page_number") < 1) | (F.col("page_number") > F.col("_pages"))
    status = (
        F.when(F.col("_page").isNull(), "INVALID_BLOCK").when(bad_page, "INVALID_PAGE").when(F.col("_page") != F.col("page_number"), "INCONSISTENT_PROVENANCE")
        .when(F.coalesce(F.trim("_text"), F.lit("")) == "", "MISSING_TEXT").otherwise("VALID")
    )
    return joined.select(*(references[c] if c not in ("document_id", "reading_order") else F.col(c) for c in references.columns), status.alias("status"))


def _content(claim: Column) -> Column:
    words = F.regexp_extract_all(claim, F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    without = lambda stop: F.filter(words, lambda w: ~w.isin(*stop))
    return F.when(F.size(without(P.CLAIM_STOPWORDS)) > 0, without(P.CLAIM_STOPWORDS)).otherwise(without(P.CLAIM_STOPWORDS[:3]))


def verdict(claim: Column, source: Column) -> Column:
    """SUPPORTED, PARTIALLY_SUPPORTED, UNSUPPORTED, CONTRADICTED or INSUFFICIENT_EVIDENCE of a claim by a source text."""
    low, text = F.lower(claim), F.lower(source)
    numbers = lambda x: F.regexp_extract_all(x, F.lit(P.CLAIM_NUMBER), F.lit(0))
    denies = low.rlike(P.NEGATION)
    says_none = reduce(lambda a, b: a | b, (low.contains(x) for x in P.DENIALS))
    renewal = low.contains("renew") & text.contains("renew")
    contradicted = renewal & ((~denies & text.rlike(P.NO_RENEWAL)) | (denies & text.rlike(P.RENEWAL) & ~text.rlike(P.NOT_RENEW) & says_none))
    shall, may = text.rlike(P.MANDATORY), r"\bmay\b"
    words = _content(low)
    share = F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words)
    return (
        F.when(contradicted, "CONTRADICTED")
        .when(F.size(F.array_except(numbers(claim), numbers(source))) > 0, "UNSUPPORTED")
        .when(low.rlike(may) & ~text.rlike(may) & shall, "PARTIALLY_SUPPORTED")
        .when(F.size(words) == 0, "INSUFFICIENT_EVIDENCE")
        .when(share >= 0.5, "SUPPORTED")
        .when(share >= 0.3, "PARTIALLY_SUPPORTED")
        .otherwise("UNSUPPORTED")
    )


def verify_claims(claims: DataFrame, citations: DataFrame, spans: DataFrame) -> DataFrame:
    """claim_id, n_cited, status of claims (claim_id, text) by citations (claim_id, position, evidence_id) of spans (evidence_id, text).

    Without a citation or without words: INSUFFICIENT_EVIDENCE; with a citation of no span or of one without text: UNSUPPORTED."""
    cited = citations.join(spans.select("evidence_id", F.col("text").alias("span")), "evidence_id", "left")
    held = cited.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_cited"), F.count_if(F.col("span").isNull()).alias("missing"), F.sort_array(F.collect_list(F.struct("position", "span"))).alias("spans"))
    source = F.array_join(F.transform("spans", lambda x: x["span"]), " ")
    rows = claims.join(held.select("claim_id", "n_cited", "missing", source.alias("source")), "claim_id", "left")
    status = F.when(F.col("n_cited").isNull(), "INSUFFICIENT_EVIDENCE").when(F.col("missing") > 0, "UNSUPPORTED").otherwise(verdict(F.coalesce(F.trim("text"), F.lit("")), F.col("source")))
    return rows.select("claim_id", F.coalesce("n_cited", F.lit(0)).cast("long").alias("n_cited"), status.alias("status"))


def sanitise(text: Column) -> Column:
    """Text with directives to a model marked and code fences turned into quotes."""
    marked = F.regexp_replace(F.replace(F.trim(text), F.lit("\r\n"), F.lit("\n")), "(?i)" + P.DIRECTIVES, "[NEUTRALIZED_DIRECTIVE: $1]")
    return F.regexp_replace(marked, P.FENCE, "'''")
