"""Obligations of sentences, and the temporal cascade that classifies their timing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .facts import days_of


def units(text: Column) -> Column:
    """Sentences, or parts between semicolons if there are several, of over 15 characters."""
    long = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 15)
    parts, sentences = long(F.split(text, ";")), long(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9(])"))
    return F.when(text.contains(";") & (F.size(parts) > 1), parts).otherwise(sentences)


def actor(sentence: Column, modal: Column) -> Column:
    """The first role named before the modal verb; never guessed."""
    before = F.lower(F.substring(sentence, F.lit(1), F.position(modal, sentence) - 1))
    named = reduce(lambda out, r: F.when(before.contains(r), F.initcap(F.lit(r))).otherwise(out), reversed(P.ROLES), F.lit(None).cast("string"))
    mutual = F.when(F.lower(sentence).contains("each party") | F.lower(sentence).contains("the parties shall"), "The Parties")
    return F.coalesce(named, mutual, F.lit("unresolved"))


def action(sentence: Column, modal: Column) -> Column:
    """The modal verb and up to six words after it."""
    after = F.trim(F.substring(sentence, F.position(modal, sentence) + F.length(modal), F.length(sentence)))
    words = F.array_join(F.slice(F.split(after, r"\s+"), 1, 6), " ")
    return F.concat(modal, F.lit(" "), F.regexp_replace(words, r"^[,;.]+|[,;.]+$", ""))


def anchor_event(raw: Column) -> Column:
    text = F.lower(raw)
    has = lambda *words: reduce(lambda a, b: a | b, (text.contains(w) for w in words))
    slug = F.substring(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    return (
        F.when(has("invoice", "receipt", "billing"), "invoice_received").when(has("breach", "default"), "breach_discovered")
        .when(has("effective date", "commencement"), "effective_date").when(has("expiration", "end of the term"), "expiration_date")
        .when(has("notice"), "notice_received").when(has("termination"), "termination_notice").when(has("delivery", "shipment"), "delivery_date")
        .when(has("audit"), "audit_requested").when(slug != "", slug).otherwise("unspecified_event")
    )


def temporal(sentence: Column) -> Column:
    """struct<type, offset_days, anchor_event, date>: conditional before recurring, ongoing, fixed date, offset, net; no date is made up.

    Each pattern is sought once, where a word of it stands; the timing is that of what a condition bears on, if there is one."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    has = lambda text, *words: reduce(lambda a, b: a | b, (text.contains(w) for w in words))

    def of_offset(m: Column) -> Column:
        group = lambda k: F.regexp_extract(m, "(?i)" + P.OFFSET, k)
        return F.struct(days_of(group(2), group(4)).alias("number"), F.lower(group(6)).alias("unit"), anchor_event(group(8)).alias("anchor"))

    def timed(text: Column) -> Column:
        low = F.lower(text)
        said = F.when(has(low, "within", "later than", "at least", "prior to"), F.nullif(F.regexp_extract(text, "(?i)" + P.OFFSET, 0), F.lit("")))
        net = F.when(low.contains("net"), F.regexp_extract(low, P.NET, 1).try_cast("int"))
        month = F.array_position(F.array(*(F.lit(m) for m in P.MONTHS)), F.regexp_extract(low, P.FIXED_DATE, 1))
        date = F.format_string("%04d-%02d-%02d", F.regexp_extract(low, P.FIXED_DATE, 3).cast("int"), month.cast("int"), F.regexp_extract(low, P.FIXED_DATE, 2).cast("int"))
        recurring, ongoing, fixed = low.rlike(P.RECURRING) & low.rlike(P.RECURRING_NOUNS), low.rlike(P.ONGOING), low.rlike(P.FIXED_DATE)
        none, blank = F.lit(None).cast("int"), F.lit(None).cast("string")
        row = lambda kind, days, anchor, day: F.struct(kind.alias("type"), days.alias("offset_days"), anchor.alias("anchor_event"), day.alias("date"))

        def with_offset(o: Column) -> Column:
            relative = o["anchor"].rlike("breach|default|termination|change|notice|audit|request|discover|occurrence")
            days = F.when(o["unit"] == "days", o["number"]).when(o["unit"] == "months", o["number"] * 30)
            return row(F.when(relative, "event_relative").otherwise("relative_offset"), days, o["anchor"], blank)

        found = F.when(recurring, row(F.lit("recurring"), none, blank, blank)).when(ongoing, row(F.lit("ongoing"), none, F.lit("contract_term"), blank)).when(fixed, row(F.lit("fixed_date"), none, blank, date))
        found = found.when(said.isNotNull(), once(once(said, of_offset), with_offset)).when(net.isNotNull(), row(F.lit("relative_offset"), net, F.lit("invoice_date"), blank))
        return found.otherwise(row(F.lit("unspecified"), none, blank, blank))

    low = F.lower(sentence)
    remainder = F.when(has(low, "if", "in the event", "upon the occurrence of") & low.rlike("shall|must|agrees to|within"), F.nullif(F.regexp_extract(sentence, "(?i)" + P.CONDITION, 3), F.lit("")))

    def whole(rest: Column) -> Column:
        conditional = rest.isNotNull()
        condition = F.concat(F.lit("condition_"), F.substring(F.regexp_extract(sentence, "(?i)" + P.CONDITION, 2), 1, 30))
        return once(timed(F.coalesce(rest, sentence)), lambda t: F.struct(
            F.when(conditional, "conditional").otherwise(t["type"]).alias("type"), t["offset_days"].alias("offset_days"),
            F.when(conditional, condition).otherwise(t["anchor_event"]).alias("anchor_event"), F.when(~conditional, t["date"]).alias("date"),
        ))

    return once(remainder, whole)


def deadline(anchor: Column, offset_days: Column, offset_months: Column) -> Column:
    """anchor plus days, else plus months; null without a valid anchor."""
    start = F.try_to_timestamp(anchor, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(offset_days.isNotNull(), F.date_add(start, offset_days)).when(offset_months.isNotNull(), F.add_months(start, offset_months))


def extract_obligations(blocks: DataFrame) -> DataFrame:
    """document_id, reading_order, unit, actor, action and the temporal fields of every sentence with a modal verb."""
    sentences = blocks.filter(F.col("text").rlike("(?i)" + P.MODALS)).select("document_id", "reading_order", F.posexplode(units(F.col("text"))).alias("unit", "sentence"))
    modal = F.regexp_extract("sentence", "(?i)" + P.MODALS, 1)
    rows = sentences.withColumn("modal", modal).filter("modal != ''").withColumn("t", temporal(F.col("sentence")))
    return rows.select(
        "document_id", F.col("reading_order").cast("int"), "unit", actor(F.col("sentence"), F.col("modal")).alias("actor"), action(F.col("sentence"), F.col("modal")).alias("action"),
        F.col("t.type").alias("temporal_type"), F.col("t.offset_days").alias("offset_days"), F.col("t.anchor_event").alias("anchor_event"), F.col("t.date").alias("calculated_date"),
    )
