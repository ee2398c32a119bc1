"""Blocks to typed blocks and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def _ci(pattern: str) -> str:
    return f"(?i){pattern}"


def block_type(text: Column) -> Column:
    """exhibit_marker, signature_block, heading, list_item or paragraph; the first rule that holds decides."""
    heading = (F.length(text) <= 150) & (text.rlike(_ci(P.HEADING_SECTION)) | text.rlike(P.HEADING_NUMBER) | text.rlike(_ci(P.HEADING_KEYWORD)))
    return (
        F.when((F.length(text) < 120) & text.rlike(_ci(P.HEADING_EXHIBIT)), "exhibit_marker")
        .when((F.length(text) < 300) & text.rlike(_ci(P.SIGNATURE)), "signature_block")
        .when(heading, "heading")
        .when(text.rlike(_ci(P.LIST_ITEM)), "list_item")
        .otherwise("paragraph")
    )


def section_number(text: Column) -> Column:
    """A heading's number; null for other blocks."""
    by_word, by_number = F.regexp_extract(text, _ci(P.HEADING_SECTION), 2), F.regexp_extract(text, P.HEADING_NUMBER, 1)
    return F.when(F.length(text) <= 150, F.coalesce(F.nullif(F.rtrim(by_word, F.lit(".")), F.lit("")), F.nullif(by_number, F.lit(""))))


def section_title(text: Column) -> Column:
    """A heading's title, empty if it has none; null for other blocks."""
    heading = lambda p, k: F.when(text.rlike(p), F.trim(F.regexp_extract(text, p, k)))
    return F.when(F.length(text) <= 150, F.coalesce(heading(_ci(P.HEADING_SECTION), 3), heading(P.HEADING_NUMBER, 3), heading(_ci(P.HEADING_KEYWORD), 1)))


def heading_parts(text: Column) -> Column:
    """struct<number, title> of a heading in full: the word and number of a section, the number alone, or a keyword in capitals and with capital letters; null for other blocks."""
    section, number, keyword = _ci(P.HEADING_SECTION), P.HEADING_NUMBER, _ci(P.HEADING_KEYWORD)
    part = lambda p, k: F.regexp_extract(text, p, k)
    made = lambda n, t: F.struct(n.alias("number"), t.alias("title"))
    return F.when(
        F.length(text) <= 150,
        F.when(text.rlike(section), made(F.concat_ws(" ", part(section, 1), part(section, 2)), F.trim(part(section, 3))))
        .when(text.rlike(number), made(part(number, 1), F.trim(part(number, 3))))
        .when(text.rlike(keyword), made(F.upper(part(keyword, 1)), F.initcap(part(keyword, 1)))),
    )


def with_sections(blocks: DataFrame) -> DataFrame:
    """Type every block and carry the last heading's number and title forward; a heading has its own."""
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order").rowsBetween(Window.unboundedPreceding, 0)
    own = blocks.withColumns({"block_type": block_type(F.col("text")), "own": section_number(F.col("text")), "title": section_title(F.col("text"))})
    return own.withColumns({"section_number": F.last("own", ignorenulls=True).over(order), "section_title": F.last("title", ignorenulls=True).over(order)}).drop("own", "title")


def section_rollup(typed: DataFrame) -> DataFrame:
    """document_id, section_number, start_page, end_page, n_blocks."""
    return typed.filter("section_number IS NOT NULL").groupBy("document_id", "section_number").agg(F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"), F.count(F.lit(1)).alias("n_blocks"))


def section_extents(typed: DataFrame) -> DataFrame:
    """document_id, n, section_number, section_title, start_page, end_page, block_ids (in order, joined by commas) of sections in order.

    typed: document_id, page_number, reading_order, block_id, block_type, text. Each heading begins a section, which ends on the page
    where the next one begins, the last one on the document's last page. Blocks before the first heading belong to the first section; a document without headings has none."""
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    heads = F.sum((F.col("block_type") == "heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = typed.withColumn("n", F.greatest(F.lit(1), heads))
    place = F.struct("page_number", "reading_order")
    heading = F.when(F.col("block_type") == "heading", place)
    # a document's sections and their lists are as many as its blocks; headings alone are compared with each other
    one = rows.groupBy("document_id", "n").agg(
        F.min_by(F.struct(heading_parts(F.col("text")).alias("own"), "page_number"), heading).alias("h"), F.max("page_number").alias("last_page"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "block_id"))), lambda b: b["block_id"]).alias("ids"),
    )
    sections = Window.partitionBy("document_id").orderBy("n")
    last = F.max("last_page").over(Window.partitionBy("document_id"))
    found = one.withColumns({"next_page": F.lead("h.page_number").over(sections), "pages": last}).filter("h IS NOT NULL")
    return found.select("document_id", "n", F.col("h.own.number").alias("section_number"), F.col("h.own.title").alias("section_title"), F.col("h.page_number").alias("start_page"), F.coalesce("next_page", "pages").alias("end_page"), F.array_join("ids", ",").alias("block_ids"))
