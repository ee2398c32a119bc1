"""What comes in: uploads let in or turned away, scans without text, chunks that have no vector yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of an upload, and characters a page below which a file is a scan.
LARGEST_BYTES, MAGIC, LEAST_CHARS_A_PAGE = 25 * 1024 * 1024, "%PDF-", 30


def reject_reason(filename: Column, n_bytes: Column, head: Column) -> Column:
    """Why an upload is turned away; null if it is let in. The first failure counts; a null name, size or head fails its rule."""
    named = F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False))
    travels = filename.contains("..") | filename.contains("/") | filename.contains("\\")
    small, marked = F.coalesce(n_bytes <= LARGEST_BYTES, F.lit(False)), F.coalesce(head.startswith(MAGIC), F.lit(False))
    return F.when(~named, "not_a_pdf_name").when(travels, "path_in_name").when(~small, "too_large").when(~marked, "not_a_pdf")


def scans(blocks: DataFrame) -> DataFrame:
    """document_id, chars_per_page, needs_ocr; a document without a page number counts as one page."""
    pages = F.greatest(F.lit(1), F.coalesce(F.max("page_number"), F.lit(1)))
    rows = blocks.groupBy("document_id").agg((F.coalesce(F.sum(F.length("text")), F.lit(0)) / pages).alias("n"))
    return rows.select("document_id", F.round("n", 2).alias("chars_per_page"), (F.col("n") < LEAST_CHARS_A_PAGE).alias("needs_ocr"))


def vector_key(model: str, version: str, chunk_id: Column, text: Column) -> Column:
    """The key of a chunk's vector: any change of model, version, chunk or text makes another one."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), chunk_id.cast("string"), F.coalesce(text, F.lit(""))), 256)


def missing_vectors(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """The chunks (chunk_id, key) whose key the cache (key) lacks."""
    return chunks.join(cached.select("key"), "key", "left_anti").select("chunk_id", "key")


def without_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Any table with a document_id, without the documents that are deleted; rows without a document_id stay."""
    return rows.join(gone.select("document_id"), "document_id", "left_anti").select(*rows.columns)
