"""Contracts as read: fields with their evidence, parties of preambles, noise by page zone, tables, and the corpus as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .facts import _date
from .ingest import block_type
from .numbering import numbered

# Number words of days, cues and patterns of fields, how sure each is, and why one is missing.
DAY_WORDS = {"thirty": 30, "forty-five": 45, "sixty": 60, "ninety": 90, "fifteen": 15, "ten": 10}
PAYMENT_CUES = ("invoice", "payable", "payment", "net 30", "net 45", "net 60")
LAW_CUES = ("governed by", "governing law", "jurisdiction", "laws of the state of")
LAW_STOPWORDS = ("this", "such", "the", "any", "which")
NOTICE = r"\b((prior\s+)?written\s+notice\s+of|at\s+least)\s+(thirty|forty-five|sixty|ninety|\d{1,3})\s*(\((\d{1,3})\))?\s*(calendar\s+)?days?\b"
CONFIDENCE = {
    "contract_type": 0.95, "effective_date": 0.92, "expiration_date": 0.85, "renewal_language": 0.90, "governing_law": 0.88, "payment_terms": 0.90, "termination_notice": 0.88,
}
MISSING = {"contract_type": "Archetype not detected on title blocks", "expiration_date": "No fixed calendar expiration date identified"}
NOT_FOUND = "Clause not found in document"
RENEWAL = "Automatic / Successive Renewal Detected"
# What preambles, company names, page zones and file names look like.
LEGENDS = ("confidential treatment", "securities and exchange commission")
PREAMBLES = ("entered into", "by and between", "by and among", "made as of", "agreement", "amendment")
_WORD = r"[A-Za-z0-9*.'\-]+"
_SUFFIX = r"(?:Inc|LLC|Corp|Corporation|Co|Ltd|Pty\s+Ltd|L\.P\.|N\.A\.)(?:\b|\.)"
COMPANY = rf"({_WORD}(?:\s+{_WORD})*?,\s*{_SUFFIX}|{_WORD}(?:\s+{_WORD})*?\s+{_SUFFIX})"
LEADING = r"^((is\s+)?entered\s+into\s+)?(by\s+and\s+between|between|by\s+and\s+among|and|,)\s+"
REJECTED = ("a delaware", "a texas", "a california", "a new york", "the ", "each a ", "either a ")
ENDING = r"(.*?,\s*(?:Inc\.|LLC|Corp\.|Corporation|Co\.|Ltd\.|Pty\s+Ltd|L\.P\.|N\.A\.))"
BETWEEN = r"(?:by\s+and\s+between|between|by\s+and\s+among)\s+([A-Z0-9.,\s()'\-]+?)\s+(?:and|,)\s+([A-Z0-9.,\s()'\-]+?)(?:\s*\(|\s+RECITALS|\s+WHEREAS|\.$)"
MARGIN = 50
HEADER_WORDS, FOOTER_WORDS, FOOTER_NUMBER = ("EX-", "Exhibit", "AM", "PM", "sec.gov", "EDGAR"), ("https://", "sec.gov"), r"^(\d+|\d+\s*/\s*\d+)$"


def _days(word: Column, digits: Column) -> Column:
    numbers = F.create_map(*(F.lit(x) for k, v in DAY_WORDS.items() for x in (k, v)))
    value = F.lower(F.coalesce(F.nullif(digits, F.lit("")), word))
    return F.when(value.rlike(r"^\d+$"), value.try_cast("int")).otherwise(F.element_at(numbers, value))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def fields(typed: DataFrame) -> DataFrame:
    """document_id, field_name, raw_value, normalized_value, int_value, confidence, is_found, missing_reason, page_number, reading_order: a row for each field of each document.

    typed: blocks with section_title. A field that is not found has confidence 0 and says why; the governing
    law is that of the last block that names one."""
    text, low = F.col("text"), F.col("_low")
    get = lambda p, k: F.regexp_extract(text, "(?i)" + p, k)
    none = F.lit(None).cast("int")
    ranked = reversed(list(enumerate(P.CONTRACT_TYPES, 1)))
    kind = reduce(lambda out, x: F.when(text.rlike("(?i)" + x[1][1]), x[0]).otherwise(out), ranked, F.lit(None).cast("int"))
    kinds = F.array(*(F.lit(name) for name, _ in P.CONTRACT_TYPES))
    title = F.lower(F.coalesce("section_title", F.lit("")))
    order, back = F.struct("page_number", "reading_order"), F.struct((-F.col("page_number")).alias("page_number"), (-F.col("reading_order")).alias("reading_order"))
    # each pattern runs once on a block, and only where its field can be
    typed = typed.select("document_id", "page_number", "reading_order", "text", F.lower("text").alias("_low"), (title.contains("term") | title.contains("expiration")).alias("_in_term"))
    pays, ends = _any(low, PAYMENT_CUES), _any(low, ("termination", "terminate"))
    typed = typed.withColumns({
        "_kind": F.when((F.col("page_number") == 1) & (F.col("reading_order") < 6), kind),
        "_begins": (F.col("page_number") <= 2) & text.rlike("(?i)" + P.EFFECTIVE_CUE), "_expires": F.col("_in_term") & text.rlike("(?i)" + P.EXPIRATION_CUE),
        "_pay_word": F.when(pays, get(P.PAYMENT_DAYS, 2)), "_pay_digits": F.when(pays, get(P.PAYMENT_DAYS, 4)), "_notice_word": F.when(ends, get(NOTICE, 3)), "_notice_digits": F.when(ends, get(NOTICE, 5)),
        "_law": F.when(_any(low, LAW_CUES), F.trim(get(P.GOVERNING_LAW, 2))),
    })
    typed = typed.withColumns({
        "_day": F.when(F.col("_begins") | F.col("_expires"), _date(text)), "_pay": _days(F.col("_pay_word"), F.col("_pay_digits")), "_notice": _days(F.col("_notice_word"), F.col("_notice_digits")),
    })
    day, law, pay, notice = F.col("_day"), F.col("_law"), F.col("_pay"), F.col("_notice")
    made = {
        "contract_type": (F.col("_kind").isNotNull(), F.substring(text, 1, 80), F.get(kinds, F.col("_kind") - 1), none),
        "effective_date": (F.col("_begins") & day.isNotNull(), day, day, none),
        "expiration_date": (F.col("_expires") & day.isNotNull(), day, day, none),
        "renewal_language": (_any(low, P.RENEWAL_CUES), F.substring(text, 1, 120), F.lit(RENEWAL), none),
        "governing_law": ((law != "") & ~F.lower(law).isin(*LAW_STOPWORDS), get(P.GOVERNING_LAW, 0), law, none),
        "payment_terms": (pay > 0, get(P.PAYMENT_DAYS, 0), F.concat(F.lit("Net "), pay.cast("string")), pay),
        "termination_notice": (notice > 0, get(NOTICE, 0), F.when(low.contains("convenience"), "Convenience").otherwise("Standard / Breach"), notice),
    }
    candidate = lambda there, raw, normal, number: F.when(there, F.struct(raw.alias("raw"), normal.alias("normal"), number.alias("number"), "page_number", "reading_order"))
    rows = typed.select("document_id", order.alias("order"), back.alias("back"), F.col("_kind").alias("kind"), *(candidate(*x).alias(name) for name, x in made.items()))
    by = {"governing_law": F.col("back"), "contract_type": F.struct("kind", "order")}
    first = [F.min_by(name, F.when(F.col(name).isNotNull(), by.get(name, F.col("order")))).alias(name) for name in made]
    held = rows.groupBy("document_id").agg(*first)
    out = [F.struct(
        F.lit(name).alias("field_name"), F.col(name)["raw"].alias("raw_value"), F.col(name)["normal"].alias("normalized_value"), F.col(name)["number"].alias("int_value"),
        F.when(F.col(name).isNotNull(), CONFIDENCE[name]).otherwise(0.0).alias("confidence"), F.col(name).isNotNull().alias("is_found"),
        F.when(F.col(name).isNull(), MISSING.get(name, NOT_FOUND)).alias("missing_reason"), F.col(name)["page_number"].alias("page_number"), F.col(name)["reading_order"].alias("reading_order"),
    ) for name in made]
    return held.select("document_id", F.inline(F.array(*out)))


def field_rates(found: DataFrame) -> DataFrame:
    """field_name, n_documents, n_found, found_rate, mean_confidence (of those found; 0 if none)."""
    n, hit = F.count(F.lit(1)), F.count_if("is_found")
    return found.groupBy("field_name").agg(n.alias("n_documents"), hit.alias("n_found"), F.round(F.coalesce(hit / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias("found_rate"), F.round(F.coalesce(F.avg(F.when(F.col("is_found"), F.col("confidence"))), F.lit(0.0)), 4).alias("mean_confidence"))


def clean_name(raw: Column) -> Column:
    """A name up to its ending; one without is kept if it is short and does not begin with "this"; else null."""
    name = F.trim(raw)
    ended = F.trim(F.regexp_extract(name, "(?i)" + ENDING, 1))
    return F.when(ended != "", ended).when((F.length(name) < 60) & ~name.startswith("this"), name)


def preamble_parties(blocks: DataFrame) -> DataFrame:
    """document_id, ord, name, page_number, reading_order of the parties that preambles name, in reading order.

    Names with a company ending are taken from block after block until there are two; where the blocks so far
    have none, a block that says "between X and Y" gives two and is the last. Legends are passed over."""
    low = F.lower("text")
    there = (F.col("page_number") <= 2) & ~_any(low, LEGENDS) & _any(low, PREAMBLES)
    bare = F.transform(F.regexp_extract_all("text", F.lit("(?i)" + COMPANY), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "(?i)" + LEADING, "")))
    kept = F.filter(bare, lambda x: ~reduce(lambda a, b: a | b, (F.lower(x).startswith(r) for r in REJECTED)))
    names = F.array_distinct(F.filter(F.transform(kept, clean_name), lambda x: x.isNotNull() & (F.length(x) > 3)))
    pair = F.filter(F.transform(F.array(F.regexp_extract("text", BETWEEN, 1), F.regexp_extract("text", BETWEEN, 2)), clean_name), lambda x: x.isNotNull() & (x != ""))
    rows = blocks.filter(there).select("document_id", "page_number", "reading_order", names.alias("names"), F.when(F.col("text").rlike(BETWEEN), pair).alias("pair"))
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")  # preambles of one document
    rows = rows.withColumn("so_far", F.sum(F.size("names")).over(order))
    ends = (F.col("so_far") >= 2) | ((F.col("so_far") == 0) & F.col("pair").isNotNull())
    rows = rows.withColumn("ended", F.coalesce(F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    taken = rows.filter("NOT ended").select("document_id", "page_number", "reading_order", F.posexplode(F.when(F.size("names") > 0, F.col("names")).when(F.col("so_far") == 0, F.col("pair"))).alias("k", "name"))
    place = Window.partitionBy("document_id").orderBy("page_number", "reading_order", "k")
    return taken.select("document_id", (F.row_number().over(place) - 1).alias("ord"), "name", "page_number", "reading_order")


def noise_reason(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    """sec_footer_zone, sec_header_zone or null of a block by where it lies on its page; the foot decides over the head."""
    foot = (y1 > height - MARGIN) & (_any(text, FOOTER_WORDS) | text.rlike(FOOTER_NUMBER))
    return F.when(foot, "sec_footer_zone").when((y0 < MARGIN) & _any(text, HEADER_WORDS), "sec_header_zone")


def placed_types(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """document_id, page_number, reading_order, noise_reason, block_type, table_id of blocks with their boxes.

    blocks: x0, y0, y1, page_height; tables: document_id, page_number, table_id, x0, y0, y1. A block within a table is
    of type table, also where it is noise; of several tables the first counts. Others are noise, else typed by their text."""
    reason = noise_reason(F.col("text"), F.col("b.y0"), F.col("b.y1"), F.col("b.page_height"))
    same = (F.col("b.document_id") == F.col("t.document_id")) & (F.col("b.page_number") == F.col("t.page_number"))
    within = (F.col("b.y0") >= F.col("t.y0") - 2) & (F.col("b.y1") <= F.col("t.y1") + 2) & (F.col("b.x0") >= F.col("t.x0") - 5)
    rows = blocks.alias("b").join(tables.alias("t"), same & within, "left")
    keys = [F.col("b.document_id").alias("document_id"), F.col("b.page_number").alias("page_number"), "reading_order"]
    kind = F.when(F.col("table_id").isNotNull(), "table").when(reason.isNotNull(), "sec_noise").otherwise(block_type(F.col("text")))
    once = rows.select(*keys, reason.alias("noise_reason"), kind.alias("block_type"), "table_id")
    return once.groupBy("document_id", "page_number", "reading_order").agg(F.min("noise_reason").alias("noise_reason"), F.min("block_type").alias("block_type"), F.min("table_id").alias("table_id"))


def readable(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks that are no noise, in reading order: document_id, n (from 1), page_number, reading_order, text."""
    kept = placed.filter("noise_reason IS NULL").select("document_id", "page_number", "reading_order")
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    return blocks.join(kept, ["document_id", "page_number", "reading_order"], "left_semi").select("document_id", F.row_number().over(order).alias("n"), "page_number", "reading_order", "text")


def table_cells(tables: DataFrame) -> DataFrame:
    """document_id, table_id, row_idx, col_idx, text, is_header of the cells of ``matrix`` (array of rows); the first row is the header, a null cell is empty."""
    rows = tables.select("document_id", "table_id", F.posexplode("matrix").alias("row_idx", "cells"))
    cells = rows.select("document_id", "table_id", "row_idx", F.posexplode("cells").alias("col_idx", "text"))
    return cells.select("document_id", "table_id", "row_idx", "col_idx", F.coalesce("text", F.lit("")).alias("text"), (F.col("row_idx") == 0).alias("is_header"))


def corpus_listing(files: DataFrame, most: int | None = None) -> DataFrame:
    """filename, document_id (doc_01, doc_02, ... in order of names) of the uploads, or of the raw files if there is no upload.

    files: folder (uploads or raw), filename; only .pdf counts. ``most``: at most so many, a parameter of a listing."""
    pdf = files.filter(F.col("filename").endswith(".pdf"))
    chosen = pdf.agg(F.coalesce(F.max(F.when(F.col("folder") == "uploads", "uploads")), F.lit("raw")).alias("folder"))
    rows = pdf.join(F.broadcast(chosen), "folder")  # one row
    named = numbered(rows.select("filename"), "filename")
    listed = named if most is None else named.filter(F.col("n") <= most)
    return listed.select("filename", F.format_string("doc_%02d", "n").alias("document_id"))


def next_ids(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """filename, document_id of arriving files: the numbers after the greatest one known (doc_7), in order of names."""
    greatest = known.agg(F.coalesce(F.max(F.regexp_extract("document_id", r"^doc_(\d+)$", 1).try_cast("int")), F.lit(0)).alias("top"))
    return numbered(arriving.select("filename"), "filename").join(F.broadcast(greatest)).select("filename", F.format_string("doc_%02d", F.col("n") + F.col("top")).alias("document_id"))


def upsert(stored: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``saved`` put in or over it, by key."""
    return stored.join(saved.select(key), key, "left_anti").select(*stored.columns).unionByName(saved.select(*stored.columns))


def write_payload(df: DataFrame, folder: str, form: str = "json") -> None:
    """A table as JSON lines or Parquet below ``folder``. An earlier one goes before the new one is written, so a job that fails leaves none; collections grow by batches instead."""
    df.write.mode("overwrite").format(form).save(folder)


def markdown(df: DataFrame, order: str) -> DataFrame:
    """n, line: a table as lines of Markdown, head first; ``order`` is a column that tells the rows apart."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("/")), F.lit(""))
    head = df.sparkSession.createDataFrame([(-1, "| " + " | ".join(df.columns) + " |"), (0, "|" + "---|" * len(df.columns))], "n int, line string")
    lines = df.select(F.col(order).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("line"))
    body = numbered(lines, "place").select(F.col("n").cast("int").alias("n"), "line")
    return head.unionByName(body)
