"""Facts: the first (or last) block in reading order that matches, one row per document.

``min_by`` over partial aggregates keeps the job at one small shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(w) for w in words))


def days_of(word: Column, digits: Column) -> Column:
    """A number of days: digits in brackets, else digits, else one of the number words; else null."""
    numbers = F.create_map(*(F.lit(x) for k, v in P.NUMBER_WORDS.items() for x in (k, v)))
    plain = F.when(word.rlike(r"^\d+$"), word.cast("int")).otherwise(F.element_at(numbers, F.lower(word)))
    return F.when(digits != "", digits.cast("int")).otherwise(plain)


def _days(text: Column, pattern: str) -> Column:
    return days_of(F.regexp_extract(text, "(?i)" + pattern, 2), F.regexp_extract(text, "(?i)" + pattern, 4))


def _date(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, "(?i)" + d, 0), F.lit("")) for d in P.DATES))


def extract_facts(blocks: DataFrame) -> DataFrame:
    """document_id and its contract type, effective date, renewal, payment and notice days and governing law; null if not found."""
    text, at = F.col("text"), F.struct("page_number", "reading_order")
    ranked = reversed(list(enumerate(P.CONTRACT_TYPES, 1)))
    kind = reduce(lambda out, x: F.when(text.rlike("(?i)" + x[1][1]), x[0]).otherwise(out), ranked, F.lit(None).cast("int"))
    law = F.when(F.lower(text).contains("governed"), F.nullif(F.trim(F.regexp_extract(text, "(?i)" + P.GOVERNING_LAW, 2)), F.lit("")))
    found = {
        "kind": F.when((F.col("page_number") == 1) & (F.col("reading_order") < 6), kind),
        "effective_date": F.when((F.col("page_number") <= 2) & text.rlike("(?i)" + P.EFFECTIVE_CUE), _date(text)),
        "renewal": F.when(_any(text, P.RENEWAL_CUES), F.substring(text, 1, 120)),
        "payment_days": F.when(_any(text, P.PAYMENT_CUES), _days(text, P.PAYMENT_DAYS)),
        "notice_days": F.when(F.lower(text).contains("terminat"), _days(text, P.NOTICE_DAYS)),
        "governing_law": law,
    }
    rows = blocks.withColumns(found)
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), at)).alias(name)
    last = F.max_by("governing_law", F.when(F.col("governing_law").isNotNull(), at)).alias("governing_law")
    # the earlier pattern decides, wherever among the first blocks it matches
    contract_type = F.element_at(F.array(*(F.lit(name) for name, _ in P.CONTRACT_TYPES)), F.min("kind")).alias("contract_type")
    return rows.groupBy("document_id").agg(contract_type, *(first(x) for x in list(found)[1:-1]), last)


def expiration_dates(typed: DataFrame) -> DataFrame:
    """document_id, expiration_date: the first date beside a cue in a section on term or expiration."""
    text, title = F.col("text"), F.lower("section_title")
    there = (title.contains("term") | title.contains("expiration")) & text.rlike("(?i)" + P.EXPIRATION_CUE)
    rows = typed.filter(there).withColumn("expiration_date", _date(text)).filter("expiration_date IS NOT NULL")
    return rows.groupBy("document_id").agg(F.min_by("expiration_date", F.struct("page_number", "reading_order")).alias("expiration_date"))


def amendment_facts(blocks: DataFrame) -> DataFrame:
    """document_id, reading_order, action, target_section of declared changes; a block may have several."""
    text = F.col("text")
    target = lambda p: F.coalesce(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")), F.lit("General"))
    made = F.array(*(F.when(text.rlike("(?i)" + p), F.struct(F.lit(a).alias("action"), target(p).alias("target_section"))) for a, p in P.AMENDMENT_ACTIONS))
    return blocks.select("document_id", F.col("reading_order").cast("int").alias("reading_order"), F.inline(F.array_compact(made)))
