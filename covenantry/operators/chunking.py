"""Chunks of documents, by windows of characters or by sections.

A document's blocks are an array in its row, and a fold over that array, in the JVM, finds where chunks begin and end; the
text of a chunk is cut out of the array. Chunks of lines of a text shuffle nothing; chunks of placed blocks gather a
document's blocks, and no more, in a row. Rows without text have no chunks; equal doc_ids are chunked row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import block_type, section_number

TARGET, OVERLAP, LEAST_TAIL = 1000, 200, 30
LONGEST, SHORTEST = 2500, 150
_SPANS = "array<struct<first: int, n: int, is_table: boolean>>"
_FEWEST = 3  # characters that a block adds to a joined text at least: one and the gap before it


def blocks_of(text: Column) -> Column:
    """Lines that are not blank, white space normalised."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.coalesce(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>"))


def _span(first: Column, n: Column, is_table: bool = False) -> Column:
    return F.array(F.struct(first.alias("first"), n.alias("n"), F.lit(is_table).alias("is_table")))


def _kept(lengths: Column, first: Column, last: Column) -> Column:
    """The last blocks up to ``last``, one at least, none before ``first``, until they have ``OVERLAP`` characters: how many, and their characters."""
    begin = F.greatest(first, last - OVERLAP // _FEWEST)
    back = F.reverse(F.slice(lengths, begin, last - begin + 1))
    add = lambda s, n: F.when(s["held"] >= OVERLAP, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["held"] + n + F.when(s["n"] > 0, 2).otherwise(0)).alias("held")))
    return F.aggregate(back, F.struct(F.lit(0).alias("n"), F.lit(0).alias("held")), add)


def window_spans(lengths: Column) -> Column:
    """(first block from 1, number of blocks): filled to ``TARGET`` characters, with ``OVERLAP`` of the last kept."""

    def state(i: Column, first: Column, held: Column, spans: Column) -> Column:
        return F.struct(i.alias("i"), first.alias("first"), held.alias("held"), spans.alias("spans"))

    def add(s: Column, n: Column) -> Column:
        i, held = s["i"] + 1, s["held"] + n + F.when(s["held"] > 0, 2).otherwise(0)
        kept = F.element_at(F.transform(F.array(_kept(lengths, s["first"], i)), lambda k: state(i, i - k["n"] + 1, k["held"], F.concat(s["spans"], _span(s["first"], i - s["first"] + 1)))), 1)
        return F.when(held >= TARGET, kept).otherwise(state(i, s["first"], held, s["spans"]))

    def finish(s: Column) -> Column:
        return F.when(s["held"] > LEAST_TAIL, F.concat(s["spans"], _span(s["first"], s["i"] - s["first"] + 1))).otherwise(s["spans"])

    return F.aggregate(lengths, state(F.lit(0), F.lit(1), F.lit(0), F.array().cast(_SPANS)), add, finish)


def section_spans(blocks: Column) -> Column:
    """Spans of ``blocks`` (n: characters, mark: a heading or an exhibit's mark, number and title of its section, is_table).

    A chunk ends before a block that begins a section, if it has ``SHORTEST`` characters, and where ``LONGEST`` would be
    passed. A table stands alone and ends the chunk before it. A block without a section goes on with the last one."""

    def key(number: Column, title: Column) -> Column:
        return F.struct(number.alias("number"), title.alias("title"))

    def state(i: Column, first: Column, held: Column, section: Column, current: Column, spans: Column) -> Column:
        return F.struct(i.alias("i"), first.alias("first"), held.alias("held"), section.alias("section"), current.alias("current"), spans.alias("spans"))

    none = key(F.lit(None).cast("string"), F.lit(None).cast("string"))

    def add(s: Column, x: Column) -> Column:
        i, section = s["i"] + 1, key(F.coalesce(x["number"], s["section"]["number"]), F.coalesce(x["title"], s["section"]["title"]))
        number, some = section["number"], i > s["first"]
        new = x["mark"] | (number.isNotNull() & ~section.eqNullSafe(s["current"]))
        cut = some & ((new & (s["held"] >= SHORTEST)) | (s["held"] + x["n"] > LONGEST))
        before = _span(s["first"], i - s["first"])
        current = F.when(number.isNotNull() | (F.coalesce(section["title"], F.lit("")) != ""), section).otherwise(s["current"])
        return (
            F.when(x["is_table"], state(i, i + 1, F.lit(0), section, none, F.concat(F.when(some, F.concat(s["spans"], before)).otherwise(s["spans"]), _span(i, F.lit(1), True))))
            .when(cut, state(i, i, x["n"], section, section, F.concat(s["spans"], before)))
            .otherwise(state(i, s["first"], s["held"] + x["n"], section, current, s["spans"]))
        )

    def finish(s: Column) -> Column:
        return F.when(s["i"] >= s["first"], F.concat(s["spans"], _span(s["first"], s["i"] - s["first"] + 1))).otherwise(s["spans"])

    return F.aggregate(blocks, state(F.lit(0), F.lit(1), F.lit(0), none, none, F.array().cast(_SPANS)), add, finish)


def _lines(docs: DataFrame) -> DataFrame:
    """document_id, blocks (lines) and their lengths."""
    return docs.select(F.col("doc_id").alias("document_id"), blocks_of(F.col("text")).alias("blocks")).withColumn("sizes", F.transform("blocks", lambda x: F.length(x)))


def _line_sections() -> Column:
    """Lines as ``section_spans`` takes them: typed by their text, a heading brings its number, no titles and no tables."""
    title = F.lit(None).cast("string").alias("title")
    mark = lambda x: block_type(x).isin("heading", "exhibit_marker").alias("mark")
    return F.transform("blocks", lambda x: F.struct(F.length(x).alias("n"), mark(x), section_number(x).alias("number"), title, F.lit(False).alias("is_table")))


def _chunks(held: DataFrame, spans: Column) -> DataFrame:
    found = held.select("document_id", "blocks", F.posexplode(spans).alias("chunk", "span"))
    text = F.array_join(F.slice("blocks", F.col("span.first"), F.col("span.n")), "\n\n")
    return found.select("document_id", "chunk", F.col("span.first").alias("first_block"), F.col("span.n").alias("n_blocks"), F.length(text).alias("n_chars"), text.alias("text"))


def window_chunks(docs: DataFrame) -> DataFrame:
    """document_id, chunk, first_block, n_blocks, n_chars, text of sliding windows over whole texts."""
    return _chunks(_lines(docs), window_spans(F.col("sizes")))


def section_chunks(docs: DataFrame) -> DataFrame:
    """document_id, chunk, first_block, n_blocks, n_chars, text of chunks that respect sections."""
    return _chunks(_lines(docs), section_spans(_line_sections()))


def _numbered(number: Column) -> Column:
    return F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))


def described_chunks(docs: DataFrame) -> DataFrame:
    """chunk_id, document_id, chunk, chunk_type, section_number, first_block, last_block, n_chars of chunks that respect sections.

    A chunk with an exhibit's mark is EXHIBIT, else one that lies in a numbered section SECTION, else PARAGRAPH_GROUP. Its section
    is the first one that it has, be it carried over from before. Its first block is its evidence."""
    rows = _lines(docs).withColumns({"types": F.transform("blocks", block_type), "own": F.transform("blocks", section_number)})
    rows = rows.select("document_id", "types", "own", "sizes", F.posexplode(section_spans(_line_sections())).alias("chunk", "span"))
    first, n = F.col("span.first"), F.col("span.n")
    there = lambda c: F.slice(c, first, n)
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    carried = F.get(F.reverse(known(F.slice("own", F.lit(1), first))), F.lit(0))
    section = F.coalesce(carried, F.get(known(there("own")), F.lit(0)))
    kind = F.when(F.array_contains(there("types"), "exhibit_marker"), "EXHIBIT").when(section.isNotNull(), "SECTION").otherwise("PARAGRAPH_GROUP")
    size = F.aggregate(there("sizes"), F.lit(0), lambda a, x: a + x) + 2 * (n - 1)
    return rows.select(
        F.concat(F.lit("chk_sec_"), F.col("document_id").cast("string"), F.lit("_"), _numbered(F.col("chunk"))).alias("chunk_id"),
        "document_id", "chunk", kind.alias("chunk_type"), section.alias("section_number"), first.alias("first_block"), (first + n - 1).alias("last_block"), size.alias("n_chars"),
    )


def placed_chunks(blocks: DataFrame) -> DataFrame:
    """chunk_id, document_id, chunk (from 1), chunk_type, section_number, section_title, page_start, page_end, is_cross_page, block_ids, n_chars, text of
    blocks (document_id, page_number, reading_order, block_id, block_type, is_noise, section_number, section_title, text) by sections.

    Noise is left out, unless it lies in a table. A table is a chunk of its own (TABLE; without a title it is called Table) and ends the chunk before it. An empty
    block has no characters and no part in the text but is named. The section is the first one that a block of the chunk has, number and title by
    themselves."""
    kept = blocks.filter(~F.coalesce("is_noise", F.lit(False)) | (F.col("block_type") == "table"))
    names = ("page_number", "reading_order", "block_id", "block_type", "section_number", "section_title", "text")
    rows = kept.select("document_id", F.struct(*(F.col(x) for x in names)).alias("b")).groupBy("document_id").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    as_taken = lambda b: F.struct(
        F.length(F.coalesce(b["text"], F.lit(""))).alias("n"), b["block_type"].isin("heading", "exhibit_marker").alias("mark"), b["section_number"].alias("number"),
        b["section_title"].alias("title"), (b["block_type"] == "table").alias("is_table"),
    )
    found = rows.select("document_id", "blocks", F.posexplode(section_spans(F.transform("blocks", as_taken))).alias("at", "span"))
    found = found.select("document_id", (F.col("at") + 1).alias("chunk"), F.col("span.is_table").alias("is_table"), F.slice("blocks", F.col("span.first"), F.col("span.n")).alias("own"))
    some = lambda c: F.get(F.filter(F.col(f"own.{c}"), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    pages, number, title = F.col("own.page_number"), some("section_number"), some("section_title")
    text = F.array_join(F.filter(F.transform("own.text", lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), "\n\n")
    kind = F.when(F.col("is_table"), "TABLE").when(F.array_contains("own.block_type", "exhibit_marker"), "EXHIBIT").when(number.isNotNull(), "SECTION").otherwise("PARAGRAPH_GROUP")
    name = F.concat(F.when(F.col("is_table"), "chk_tbl_").otherwise("chk_sec_"), F.col("document_id").cast("string"), F.lit("_"), _numbered(F.col("chunk")))
    return found.select(
        name.alias("chunk_id"), "document_id", "chunk", kind.alias("chunk_type"), number.alias("section_number"), F.when(F.col("is_table"), F.coalesce(title, F.lit("Table"))).otherwise(title).alias("section_title"),
        F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), (F.array_min(pages) != F.array_max(pages)).alias("is_cross_page"),
        F.array_join("own.block_id", ",").alias("block_ids"), F.length(text).alias("n_chars"), text.alias("text"),
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """n_chunks and mean, median, least, greatest and standard deviation of their characters, to one decimal; also n_cross_page where chunks have pages."""
    n = F.col("n_chars")
    crossing = [F.count_if("is_cross_page").alias("n_cross_page")] if "is_cross_page" in chunks.columns else []
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(n), 1).alias("mean_chars"), F.round(F.percentile(n, F.lit(0.5)), 1).alias("median_chars"),
        F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.stddev_samp(n), 1).alias("std_chars"), *crossing,
    )
