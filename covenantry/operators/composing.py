"""Answers put together without a model: a definition, quoted sentences of the evidence, an overview of it, or a refusal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What asks for a definition or an overview, words that say nothing of the subject, sizes, and what is said.
DEFINING = ("what is a ", "what is an ", "what is ", "what does ", "define ", "meaning of ", "explain ")
BROAD = ("about", "summary", "summarize", "overview", "explain", "details", "scope", "cover", "tell me", "what is this")
UNSAID = ("what", "which", "when", "where", "how", "the", "and", "for", "with", "this", "that", "does", "agreement", "contract")
MOST_LINES, MOST_SPANS = 4, 5
SHORTEST_LINE, SHORTEST_QUOTE, SHORTEST_SENTENCE = 25, 30, 20
INTRO = "Based on the contractual evidence, this agreement establishes the following core provisions and operational terms:"
REFUSAL = "The available contract evidence does not establish this."

WORD = r"[\p{L}\p{N}_]+"
EDGES, BULLETS, SENTENCE_END, UNENDED = r"^\s+|\s+$", r"^[-*• ]+|[-*• ]+$", r"([a-zA-Z0-9”')\]])\.\s+", r"([^.;:])$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def first_sentence(line: Column) -> Column:
    """The first sentence of more than 20 characters, else the line; a full stop is put after it unless it ends in one of ``.;:``."""
    pieces = F.split(F.regexp_replace(line, SENTENCE_END, "$1\u001e"), "\u001e")
    whole = F.filter(F.transform(pieces, _bare), lambda s: F.length(s) > SHORTEST_SENTENCE)
    return F.regexp_replace(F.coalesce(F.get(whole, F.lit(0)), line), UNENDED, "$1.")


def _claims(rows: DataFrame, name: str) -> DataFrame:
    """query_id and the claims of rows (query_id, n, sentence, span_id) in order; there are at most five of a question."""
    held = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "sentence", "span_id"))).alias(name))
    return held


def definitions(asked: DataFrame, glossary: DataFrame) -> DataFrame:
    """query_id, definition: the first term of the glossary, by ``ord``, whose words stand in a row in the question.

    A term is met by an equi-join on its first word and compared whole then, so the glossary may be of any size
    and its terms of any length. Terms without a word are met by no question."""
    parts = glossary.select("ord", "definition", _words(F.lower("term")).alias("_t")).filter(F.size("_t") > 0)
    terms = parts.select("ord", "definition", F.get("_t", F.lit(0)).alias("_first"), _spaced(F.col("_t")).alias("_term"))
    said = _words(F.col("_q"))
    looked = asked.select("query_id", _spaced(said).alias("_said"), F.explode(F.array_distinct(said)).alias("_first"))
    met = looked.join(terms, "_first").filter(F.contains("_said", "_term"))
    return met.groupBy("query_id").agg(F.min_by("definition", F.struct("ord", "_term")).alias("definition"))


def quotes(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """query_id, n, sentence, span_id: sentences of the four lines of the evidence that hold most of the question's words.

    A word that the question has twice counts twice. Of equal sentences the first stays."""
    rows = spans.join(asked.select("query_id", "_words"), "query_id").select("query_id", "span_id", "position", "_words", F.posexplode(F.split("text", "\n")).alias("line_number", "_line"))
    rows = rows.withColumn("_line", _bare(F.col("_line"))).filter(F.length("_line") > SHORTEST_LINE)
    low, quote = F.lower("_line"), F.regexp_replace("_line", BULLETS, "")
    rows = rows.withColumn("hits", F.size(F.filter("_words", lambda w: F.contains(low, w)))).filter((F.col("hits") > 0) & (F.length(quote) > SHORTEST_QUOTE))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "position", "span_id", "line_number")
    best = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_LINES).select("query_id", "n", "span_id", first_sentence(quote).alias("sentence"))
    again = Window.partitionBy("query_id", "sentence").orderBy("n")
    return best.withColumn("_k", F.row_number().over(again)).filter("_k = 1").select("query_id", "n", "sentence", "span_id")


def overviews(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """query_id, n, sentence, span_id: the first sentence of the first long line of each of the first five spans."""
    order = Window.partitionBy("query_id").orderBy("position", "span_id")
    line = F.get(F.filter(F.transform(F.split("text", "\n"), _bare), lambda s: F.length(s) >= SHORTEST_LINE), F.lit(0))
    rows = spans.join(asked.select("query_id"), "query_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_SPANS)
    found = rows.select("query_id", "n", "span_id", F.regexp_replace(line, BULLETS, "").alias("_line")).filter("_line IS NOT NULL")
    return found.select("query_id", "n", first_sentence(F.col("_line")).alias("sentence"), "span_id")


def composed_answers(questions: DataFrame, spans: DataFrame, glossary: DataFrame) -> DataFrame:
    """query_id, kind, answer, claims array<struct<n, sentence, span_id>>: a row for each question (query_id, text).

    spans: query_id, span_id, position, text, the evidence of each question; glossary: ord, term, definition.
    kind is DEFINITION where the question asks for one that the glossary has (it makes no claims), QUOTES where a
    line of the evidence has a word of the question, OVERVIEW where it asks broadly or of nothing, else REFUSAL.
    Only a question's first line counts; a null text is empty; null texts of spans have no lines."""
    said = F.lower(_bare(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)))
    subject = F.filter(_words(F.col("_q")), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*UNSAID))
    asked = questions.select("query_id", said.alias("_q")).withColumn("_words", subject)
    has = lambda cues: reduce(lambda a, b: a | b, (F.col("_q").contains(c) for c in cues))
    broad = has(BROAD) | (F.size("_words") == 0)
    defined = definitions(asked.filter(has(DEFINING)), glossary)
    quoted, seen = _claims(quotes(asked, spans), "_quotes"), _claims(overviews(asked.filter(broad), spans), "_overview")
    rows = asked.select("query_id").join(defined, "query_id", "left").join(quoted, "query_id", "left").join(seen, "query_id", "left")
    kind = F.when(F.col("definition").isNotNull(), "DEFINITION").when(F.col("_quotes").isNotNull(), "QUOTES").when(F.col("_overview").isNotNull(), "OVERVIEW").otherwise("REFUSAL")
    rows = rows.withColumn("kind", kind)
    claims = F.when(F.col("kind") == "QUOTES", F.col("_quotes")).when(F.col("kind") == "OVERVIEW", F.col("_overview"))
    lines = F.array_join(F.transform(claims, lambda c: c["sentence"]), "\n\n")
    answer = F.when(F.col("kind") == "DEFINITION", F.col("definition")).when(F.col("kind") == "QUOTES", lines).when(F.col("kind") == "OVERVIEW", F.concat(F.lit(INTRO + "\n\n"), lines)).otherwise(REFUSAL)
    return rows.select("query_id", "kind", answer.alias("answer"), F.coalesce(claims, F.array().cast(quoted.schema["_quotes"].dataType)).alias("claims"))
