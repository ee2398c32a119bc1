"""Line-first quality rules, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed; a
document that loses too much of its text, or fails the base rules, is rejected. A line rule looks at
one line alone, so a document is one row throughout and nothing is shuffled.

The rules look at a line of any length: navigation by the share of its words that are separators,
boilerplate by the share of its characters that the phrase takes up.

Defined cases: null text = text without words, which fails; lines without a word neither count nor
fail; rows that repeat a doc_id are judged one by one; an empty table gives no rows; extra columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, text_of

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
MAX_PUNCTUATION_PERCENT = 20  # of a line's characters that are not white space
BOILERPLATE_PERCENT = 10  # of a line's characters, in the first phrase of boilerplate that it has
MIN_SEPARATORS = 2
SEPARATOR_WORDS_PERCENT = 20
MIN_KEPT_PERCENT = 50  # of the characters in lines that have a word

# Phrases of boilerplate, in lower case (English, German, French, Spanish).
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "this work is licensed",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "click here",
    "read more",
    "sign up for",
    "subscribe to our",
    "share this",
    "powered by",
    "alle rechte vorbehalten",
    "lizenziert unter",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "hier klicken",
    "weiterlesen",
    "newsletter abonnieren",
    "tous droits réservés",
    "sous licence",
    "accepter les cookies",
    "politique de confidentialité",
    "mentions légales",
    "conditions d'utilisation",
    "cliquez ici",
    "lire la suite",
    "todos los derechos reservados",
    "bajo licencia",
    "aceptar cookies",
    "política de privacidad",
    "términos de uso",
    "haga clic aquí",
    "leer más",
)
WHITE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_PUNCTUATION = r"[!-/:-@\[-`{-~]"
SEPARATORS = "|>»›•·"
_SEPARATOR = r"^[|>»›•·]$"


def _strip(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words within windows of ``WINDOW`` words that the text has twice or more.

    Windows are compared by 64-bit hashes within a text; only texts that repeat one are sorted."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, i: x == F.get(s, i)["h"]
        again = lambda s: F.filter(s, lambda p, i: F.coalesce(same(s, p["h"], i - 1), F.lit(False)) | F.coalesce(same(s, p["h"], i + 1), F.lit(False)))
        places = let(pairs, lambda s: F.array_sort(F.transform(again(s), lambda p: p["i"])))
        reach = lambda s: F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW))))
        return let(places, lambda s: F.aggregate(reach(s), F.lit(0).cast("long"), lambda a, x: a + x))

    at = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: at(w, i))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return F.when(F.size(words) >= WINDOW, let(hashes(words), count)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks a rule."""
    solid = F.length(_strip(line))
    punctuation = F.regexp_count(line, F.lit(_PUNCTUATION)) * 100 > solid * MAX_PUNCTUATION_PERCENT
    separated = lambda w: let(F.size(F.filter(w, lambda x: x.rlike(_SEPARATOR))), lambda n: (n >= MIN_SEPARATORS) & (n * 100 >= F.size(w) * SEPARATOR_WORDS_PERCENT))
    # a line without so many of their characters has no such words, and no phrase is a tenth of a line of over ten times the longest
    some = F.length(line) - F.length(F.translate(line, SEPARATORS, "")) >= MIN_SEPARATORS
    navigation = F.when(some, let(words_of(line), separated)).otherwise(False)
    phrase = let(F.length(F.regexp_extract(F.lower(line), "|".join(BOILERPLATE), 0)), lambda n: (n > 0) & (n * 100 >= F.length(line) * BOILERPLATE_PERCENT))
    boilerplate = F.when(F.length(line) * BOILERPLATE_PERCENT <= 100 * max(map(len, BOILERPLATE)), phrase).otherwise(False)
    return punctuation | navigation | boilerplate


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and clean_text (without the failing lines) of every row."""
    doc_id, text = F.col("doc_id").alias("doc_id"), text_of()
    solid = lambda x: F.length(_strip(x))
    judged = F.transform(F.split(text, "\n", -1), lambda x: let(solid(x), lambda n: F.struct(x.alias("line"), n.alias("n"), ((n > 0) & line_fails(x)).alias("fails"))))
    worded = lambda x: F.transform(F.filter(x, lambda y: y["n"] > 0), lambda y: y["line"])
    figures = docs.select(
        doc_id,
        text.alias("text"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(_strip(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(
            judged,
            lambda x: F.struct(
                let(worded(x), lambda y: (F.size(y) - F.size(F.array_distinct(y))).cast("long")).alias("n_dup_lines"),
                F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + F.when(y["fails"], y["n"]).otherwise(0)).alias("lost"),
                F.array_join(F.transform(F.filter(x, lambda y: ~y["fails"]), lambda y: y["line"]), "\n").alias("clean"),
            ),
        ).alias("l"),
    )
    n_words, repeated = F.col("w.n_words"), F.col("w.n_repeat_words")
    failed = (n_words < MIN_WORDS) | (repeated * 100 > n_words * MAX_REPEATED_PERCENT)
    enough = (F.col("word_chars") - F.col("l.lost")) * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT
    return figures.select(
        "doc_id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & enough).alias("kept"),
        F.col("l.clean").alias("clean_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The figures of ``judge``, with the length and checksum of each cleaned text in its place."""
    clean = F.col("clean_text")
    return judge(docs).select(*DIGEST, F.length(clean).cast("long").alias("clean_chars"), F.md5(clean).alias("clean_md5"))


DIGEST = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    """The digest in DuckDB SQL."""
    phrases = "'" + "|".join(BOILERPLATE).replace("'", "''") + "'"
    white = "[\\x20\\x09-\\x0D]"
    words, separators = "regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')", "('|', '>', '»', '›', '•', '·')"
    of_separators = f"len(list_filter({words}, lambda y: y IN {separators}))"
    phrase = f"length(regexp_extract(lower(x), {phrases}))"
    fails = f"""regexp_matches(x, '[^\\x20\\x09-\\x0D]') AND (
            len(regexp_extract_all(x, '[!-/:-@\\[-`{{-~]')) * 100 > length(regexp_replace(x, '{white}', '', 'g')) * {MAX_PUNCTUATION_PERCENT}
            OR ({of_separators} >= {MIN_SEPARATORS} AND {of_separators} * 100 >= len({words}) * {SEPARATOR_WORDS_PERCENT})
            OR ({phrase} > 0 AND {phrase} * 100 >= length(x) * {BOILERPLATE_PERCENT}))"""
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {{'line': x, 'fails': {fails}}}) AS judged, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT *, list_transform(range(0, greatest(len(words) - {WINDOW - 1}, 0)), lambda i: list_slice(words, i + 1, i + {WINDOW})) AS grams FROM w),
m AS (SELECT *, map_entries(list_histogram(list_transform(grams, lambda x: array_to_string(x, ' ')))) AS hist FROM g),
d AS (SELECT *, list_transform(list_filter(hist, lambda e: e.value > 1), lambda e: e.key) AS twice FROM m),
p AS (SELECT *, CASE WHEN len(twice) = 0 THEN [] ELSE
        list_filter(range(0, len(grams)), lambda i: list_contains(twice, array_to_string(grams[i + 1], ' '))) END AS places FROM d),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{white}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(list_sum(list_transform(range(0, len(places)), lambda i: CASE WHEN i + 1 < len(places)
            THEN least({WINDOW}, places[i + 2] - places[i + 1]) ELSE {WINDOW} END)), 0)::BIGINT AS n_repeat_words,
        coalesce(list_sum(list_transform(list_filter(judged, lambda y: y.fails), lambda y: length(regexp_replace(y.line, '{white}', '', 'g')))), 0)::BIGINT AS lost,
        array_to_string(list_transform(list_filter(judged, lambda y: NOT y.fails), lambda y: y.line), chr(10)) AS clean FROM p),
v AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED_PERCENT} AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (word_chars - lost) * 100 >= word_chars * {MIN_KEPT_PERCENT} AS kept,
       length(clean)::BIGINT AS clean_chars, md5(clean) AS clean_md5 FROM v
"""
