"""Chunks of placed blocks, and the SQL of all chunk queries: each chunk's end follows from where it begins, by a recursive walk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, ingest, reading
from . import queries as base
from . import reading as readings


def _typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their place: typed, noise marked, sections carried forward past noise."""
    blocks, tables = readings._placed(spark, sf_dir)
    keys = ["document_id", "page_number", "reading_order"]
    placed = reading.placed_types(blocks, tables).select(*keys, F.col("noise_reason").isNotNull().alias("is_noise"), F.col("block_type").alias("placed_type"))
    typed = ingest.with_sections(blocks.select(*keys, "text")).join(placed, keys)
    block_id = F.concat(F.lit("p"), F.lpad(F.col("page_number").cast("string"), 3, "0"), F.lit("_b"), F.lpad((F.col("reading_order") + 1).cast("string"), 2, "0"))
    return typed.select(*keys, block_id.alias("block_id"), F.col("placed_type").alias("block_type"), "is_noise", "section_number", "section_title", "text")


def placed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.placed_chunks(_typed_blocks(spark, sf_dir))


def placed_chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_statistics(placed_chunks(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (placed_chunks, placed_chunk_statistics)}


def _between(text: str, begin: str, end: str) -> str:
    return text[text.index(begin) : text.index(end)]


def _walk(blocks: str) -> str:
    """Spans by sections of ``blocks`` (document_id, i from 1, n, mark, number, title, is_table): document_id, chunk, f, e (last block)."""
    return f"""
k AS MATERIALIZED (SELECT *, sum(n) OVER w AS upto, mark OR (number IS NOT NULL AND i > 1 AND (number, coalesce(title, '~')) IS DISTINCT FROM (lag(number) OVER w, coalesce(lag(title) OVER w, '~'))) AS new
  FROM ({blocks}) WINDOW w AS (PARTITION BY document_id ORDER BY i)),
nx AS MATERIALIZED (SELECT f.document_id, f.i AS f, min(e.i) AS nxt FROM k f LEFT JOIN k e ON e.document_id = f.document_id AND e.i > f.i
  AND (f.is_table OR e.is_table OR (e.new AND e.upto - e.n - f.upto + f.n >= {chunking.SHORTEST}) OR e.upto - f.upto + f.n > {chunking.LONGEST}) GROUP BY ALL),
walk(document_id, chunk, f, nxt) AS (SELECT document_id, 0, f, nxt FROM nx WHERE f = 1 UNION ALL SELECT nx.document_id, chunk + 1, nx.f, nx.nxt FROM walk JOIN nx ON nx.document_id = walk.document_id AND nx.f = walk.nxt),
sp AS MATERIALIZED (SELECT document_id, chunk, f, coalesce(nxt - 1, n) AS e FROM walk JOIN (SELECT document_id, max(i) AS n FROM k GROUP BY 1) USING (document_id))"""


def oracle_sql() -> dict[str, str]:
    typed = base.oracle_sql()["typed_sections"]
    kind, own = _between(typed, "CASE WHEN length(text) < 120", " AS block_type"), _between(typed, "CASE WHEN length(text) <= 150 THEN coalesce", " AS own")
    listed = readings.oracle_sql()
    placed = readings.PLACED_SQL.format(blocks="(" + base.oracle_sql()["contract_blocks"] + ")")
    title = _between(readings.fields_sql(), "last_value(", " IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, reading_order) AS title").removeprefix("last_value(")
    lines = r"""
l AS (SELECT doc_id AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM documents),
b AS MATERIALIZED (SELECT document_id, unnest(range(1, len(blocks) + 1)) AS i, unnest(blocks) AS text FROM l)"""
    sections = f"""WITH RECURSIVE {lines},
t AS MATERIALIZED (SELECT document_id, i, length(text) AS n, text, {kind} AS kind, {own} AS own FROM b),
c AS MATERIALIZED (SELECT *, kind IN ('heading', 'exhibit_marker') AS mark, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i) AS number, NULL AS title, false AS is_table FROM t),
{_walk("SELECT * FROM c")}"""
    cut = f"SELECT document_id, chunk::INT AS chunk, f::INT AS first_block, (e - f + 1)::INT AS n_blocks, length(string_agg(text, chr(10) || chr(10) ORDER BY i))::INT AS n_chars, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM sp JOIN {{t}} USING (document_id) WHERE i BETWEEN f AND e GROUP BY document_id, chunk, f, e"
    number = "CASE WHEN {x} < 1000 THEN lpad({x}::VARCHAR, 3, '0') ELSE {x}::VARCHAR END"
    statistics = "count(*) AS n_chunks, round(avg(n_chars), 1) AS mean_chars, round(quantile_cont(n_chars, 0.5), 1) AS median_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(stddev_samp(n_chars), 1) AS std_chars"
    chunks = f"""WITH RECURSIVE p AS ({placed}), x AS ({listed["placed_types"]}),
s AS (SELECT *, last_value({own} IGNORE NULLS) OVER w AS number, last_value({title} IGNORE NULLS) OVER w AS title FROM p WINDOW w AS (PARTITION BY document_id ORDER BY page_number, reading_order)),
t AS MATERIALIZED (SELECT document_id, page_number, reading_order, printf('p%03d_b%02d', page_number, reading_order + 1) AS block_id, block_type, number, title, text, length(text) AS n, block_type IN ('heading', 'exhibit_marker') AS mark, block_type = 'table' AS is_table,
  row_number() OVER (PARTITION BY document_id ORDER BY page_number, reading_order) AS i FROM s JOIN x USING (document_id, page_number, reading_order) WHERE noise_reason IS NULL OR block_type = 'table'),
{_walk("SELECT * FROM t")},
g AS (SELECT document_id, chunk + 1 AS chunk, any_value(is_table) AS is_table, bool_or(block_type = 'exhibit_marker') AS exhibit, (list(number ORDER BY i) FILTER (WHERE number <> ''))[1] AS number, (list(title ORDER BY i) FILTER (WHERE title <> ''))[1] AS title,
  min(page_number) AS page_start, max(page_number) AS page_end, string_agg(block_id, ',' ORDER BY i) AS block_ids, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM sp JOIN t USING (document_id) WHERE i BETWEEN f AND e GROUP BY ALL)
SELECT CASE WHEN is_table THEN 'chk_tbl_' ELSE 'chk_sec_' END || document_id || '_' || {number.format(x="chunk")} AS chunk_id, document_id, chunk::INT AS chunk, CASE WHEN is_table THEN 'TABLE' WHEN exhibit THEN 'EXHIBIT' WHEN number IS NOT NULL THEN 'SECTION' ELSE 'PARAGRAPH_GROUP' END AS chunk_type,
  number AS section_number, CASE WHEN is_table THEN coalesce(title, 'Table') ELSE title END AS section_title, page_start, page_end, page_start <> page_end AS is_cross_page, block_ids, length(text)::INT AS n_chars, text FROM g"""
    return {
        "window_chunks": f"""WITH RECURSIVE {lines},
t AS MATERIALIZED (SELECT *, sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY i) AS upto, length(text) AS n FROM b),
r AS MATERIALIZED (SELECT e.document_id, e.i, coalesce(max(k.i), 1) AS back FROM t e LEFT JOIN t k ON k.document_id = e.document_id AND k.i <= e.i AND e.upto - k.upto + k.n >= {chunking.OVERLAP} GROUP BY ALL),
walk(document_id, chunk, f, e) AS (
  SELECT document_id, 0, 1, min(i) FILTER (WHERE upto - 2 >= {chunking.TARGET}) FROM t GROUP BY 1
  UNION ALL SELECT w.document_id, chunk + 1, w.g, min(x.i) FROM (SELECT walk.*, greatest(f, back) AS g FROM walk JOIN r ON r.document_id = walk.document_id AND r.i = walk.e) w
    JOIN t a ON a.document_id = w.document_id AND a.i = w.g LEFT JOIN t x ON x.document_id = w.document_id AND x.i > w.e AND x.upto - a.upto + a.n >= {chunking.TARGET} GROUP BY ALL),
sp AS (SELECT document_id, chunk, f, coalesce(e, most) AS e FROM (SELECT walk.*, most, total, a.upto - a.n - 2 AS before FROM walk JOIN (SELECT document_id, max(i) AS most, max(upto) AS total FROM t GROUP BY 1) USING (document_id) JOIN t a ON a.document_id = walk.document_id AND a.i = f)
  WHERE e IS NOT NULL OR total - before - 2 > {chunking.LEAST_TAIL})
{cut.format(t="t")}""",
        "section_chunks": f"{sections}\n{cut.format(t='t')}",
        "described_chunks": f"""{sections}
SELECT 'chk_sec_' || document_id || '_' || {number.format(x="chunk")} AS chunk_id, document_id, chunk::INT AS chunk,
  CASE WHEN bool_or(kind = 'exhibit_marker') THEN 'EXHIBIT' WHEN bool_or(number IS NOT NULL) THEN 'SECTION' ELSE 'PARAGRAPH_GROUP' END AS chunk_type, (list(number ORDER BY i) FILTER (WHERE number IS NOT NULL))[1] AS section_number,
  f::INT AS first_block, e::INT AS last_block, (sum(n) + 2 * (e - f))::INT AS n_chars FROM sp JOIN c USING (document_id) WHERE i BETWEEN f AND e GROUP BY document_id, chunk, f, e""",
        "chunk_statistics": f"SELECT {statistics} FROM ({sections} {cut.format(t='t')})",
        "placed_chunks": chunks,
        "placed_chunk_statistics": f"SELECT {statistics}, count(*) FILTER (WHERE is_cross_page) AS n_cross_page FROM ({chunks})",
    }
