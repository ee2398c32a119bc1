"""Registered queries of fields, preambles, page zones, tables and the corpus, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import ingest, reading
from ..sources import contracts
from . import queries as base

#: Valid in Spark and in DuckDB: two blocks of each contract's opening.
PREAMBLES_SQL = """
SELECT o_orderkey AS document_id, 1 AS page_number, 0 AS reading_order, CASE o_orderkey % 5 WHEN 0 THEN 'Confidential treatment has been requested by Acme Inc. for this agreement' WHEN 1 THEN 'Supply Agreement between Zed Trading Inc. and the buyer'
  WHEN 2 THEN 'Agreement' WHEN 3 THEN 'Master agreement, the Northern Corp.' ELSE 'Notes of a meeting' END AS text FROM {orders}
UNION ALL SELECT o_orderkey, 1, 1, CASE o_orderkey % 4 WHEN 0 THEN 'This Agreement, by and between ' || replace(c_name, '#', ' ') || ', Inc., and Vendor ' || CAST(o_orderkey % 9 AS VARCHAR(9)) || ' LLC, is made'
  WHEN 1 THEN 'The parties entered into, ' || replace(c_name, '#', ' ') || ' Ltd.' WHEN 2 THEN 'An agreement between ALPHA WORKS ' || CAST(o_orderkey % 9 AS VARCHAR(9)) || ' and BETA WORKS (the parties)'
  ELSE 'This amendment is made as of today, each a Delaware Corp.' END FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
#: Valid in both: boxes of the blocks, and pages of 792 points.
PLACED_SQL = """
SELECT document_id, page_number, reading_order, 50.0 AS x0, CASE reading_order WHEN 0 THEN 20.0 WHEN 7 THEN 755.0 ELSE 90.0 * reading_order END AS y0, CASE reading_order WHEN 0 THEN 40.0 WHEN 7 THEN 775.0 ELSE 90.0 * reading_order + 20 END AS y1, 792.0 AS page_height,
  CASE WHEN reading_order = 0 AND document_id % 5 = 0 THEN 'EX-10.1 of the filing' WHEN reading_order = 7 AND document_id % 3 = 0 THEN '12 / 15' WHEN reading_order = 7 AND document_id % 3 = 1 THEN 'https://www.sec.gov/Archives' ELSE text END AS text
FROM {blocks}
"""
#: Valid in both: a table on the second page of every fourth contract, and one that overlaps it.
TABLES_SQL = """
SELECT o_orderkey AS document_id, 2 AS page_number, 1 AS table_id, 40.0 AS x0, 268.0 AS y0, 385.0 AS y1 FROM {orders} WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 2, 2, 52.0, 350.0, 790.0 FROM {orders} WHERE o_orderkey % 4 = 1 OR o_orderkey % 6 = 0
"""
#: Valid in both: files as they lie in two folders.
FILES_SQL = """
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'uploads' ELSE 'raw' END AS folder, p_name || ' ' || CAST(p_partkey AS VARCHAR(9)) || CASE WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '.pdf' END AS filename FROM {part}
"""


def _preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREAMBLES_SQL, orders=contracts.table(spark, sf_dir, "orders"), customer=contracts.table(spark, sf_dir, "customer"))


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.sql(PLACED_SQL, blocks=contracts.contract_blocks(spark, sf_dir)), spark.sql(TABLES_SQL, orders=contracts.table(spark, sf_dir, "orders"))


def contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.fields(ingest.with_sections(contracts.contract_blocks(spark, sf_dir)))


def field_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.field_rates(contract_fields(spark, sf_dir))


def preamble_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.preamble_parties(_preambles(spark, sf_dir))


def placed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.placed_types(*_placed(spark, sf_dir))


def readable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, tables = _placed(spark, sf_dir)
    return reading.readable(blocks, reading.placed_types(blocks, tables))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of orders as tables: a head, and a row per line."""
    items = contracts.table(spark, sf_dir, "lineitem").filter("l_orderkey % 50 = 0").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("rows"))
    row = lambda x: F.array(x["l_linenumber"].cast("string"), F.when(x["l_partkey"] % 7 != 0, x["l_partkey"].cast("string")), x["l_quantity"].cast("int").cast("string"))
    head = F.array(F.array(F.lit("line"), F.lit("part"), F.lit("quantity")))
    tables = items.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("table_id"), F.concat(head, F.transform("rows", row)).alias("matrix"))
    return reading.table_cells(tables)


def corpus_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.corpus_listing(spark.sql(FILES_SQL, part=contracts.table(spark, sf_dir, "part")))


def next_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw files arrive after the uploads."""
    files = spark.sql(FILES_SQL, part=contracts.table(spark, sf_dir, "part"))
    return reading.next_ids(files.filter("folder = 'raw'").select("filename"), corpus_listing(spark, sf_dir))


def saved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, with a new status for every tenth and some that are new."""
    held = contracts.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    saved = held.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("S").alias("o_orderstatus")).unionByName(held.filter("o_orderkey % 100 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return reading.upsert(held, saved, "o_orderkey")


def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = contracts.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"))
    regions = contracts.table(spark, sf_dir, "region").select("r_regionkey", "r_name").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return reading.markdown(regions.select("r_regionkey", "r_name", "nations"), "r_regionkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (contract_fields, field_rates, preamble_parties, placed_types, readable_blocks, table_cells, corpus_listing, next_document_ids, saved_orders, region_report)
    return {f.__name__: f for f in found}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fields_sql() -> str:
    """A union of candidates, of which the first by place (the last for the law) stays."""
    blocks = base.oracle_sql()["contract_blocks"]
    ci = lambda x: _q("(?i)" + x)
    get = lambda p, k: f"regexp_extract(text, {ci(p)}, {k})"
    has = lambda words: "(" + " OR ".join(f"contains(lower(text), {_q(w)})" for w in words) + ")"
    words = " ".join(f"WHEN '{k}' THEN {v}" for k, v in reading.DAY_WORDS.items())
    days = lambda p, a, b: f"coalesce(try_cast(coalesce(nullif({get(p, b)}, ''), {get(p, a)}) AS INT), CASE lower({get(p, a)}) {words} END)"
    date = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {ci(d)}, 0), '')" for d in P.DATES) + ")"
    pos, law, pay, notice = "page_number * 1000 + reading_order", f"trim({get(P.GOVERNING_LAW, 2)})", days(P.PAYMENT_DAYS, 2, 4), days(reading.NOTICE, 3, 5)
    title = f"""CASE WHEN length(text) <= 150 THEN CASE WHEN regexp_matches(text, {ci(P.HEADING_SECTION)}) THEN trim(regexp_extract(text, {ci(P.HEADING_SECTION)}, 3))
    WHEN regexp_matches(text, {_q(P.HEADING_NUMBER)}) THEN trim(regexp_extract(text, {_q(P.HEADING_NUMBER)}, 3)) WHEN regexp_matches(text, {ci(P.HEADING_KEYWORD)}) THEN regexp_extract(text, {ci(P.HEADING_KEYWORD)}, 1) END END"""
    kinds = " UNION ALL ".join(
        f"SELECT document_id, 'contract_type', {k} * 100000 + {pos}, text[1:80], {_q(name)}, NULL::INT, page_number, reading_order FROM b WHERE page_number = 1 AND reading_order < 6 AND regexp_matches(text, {ci(p)})"
        for k, (name, p) in enumerate(P.CONTRACT_TYPES)
    )
    candidates = f"""{kinds}
UNION ALL SELECT document_id, 'effective_date', {pos}, {date}, {date}, NULL, page_number, reading_order FROM b WHERE page_number <= 2 AND regexp_matches(text, {ci(P.EFFECTIVE_CUE)}) AND {date} IS NOT NULL
UNION ALL SELECT document_id, 'expiration_date', {pos}, {date}, {date}, NULL, page_number, reading_order FROM s WHERE (contains(lower(title), 'term') OR contains(lower(title), 'expiration')) AND regexp_matches(text, {ci(P.EXPIRATION_CUE)}) AND {date} IS NOT NULL
UNION ALL SELECT document_id, 'renewal_language', {pos}, text[1:120], {_q(reading.RENEWAL)}, NULL, page_number, reading_order FROM b WHERE {has(P.RENEWAL_CUES)}
UNION ALL SELECT document_id, 'governing_law', -({pos}), {get(P.GOVERNING_LAW, 0)}, {law}, NULL, page_number, reading_order FROM b WHERE {has(reading.LAW_CUES)} AND {law} <> '' AND lower({law}) NOT IN ({", ".join(_q(w) for w in reading.LAW_STOPWORDS)})
UNION ALL SELECT document_id, 'payment_terms', {pos}, {get(P.PAYMENT_DAYS, 0)}, 'Net ' || {pay}, {pay}, page_number, reading_order FROM b WHERE {has(reading.PAYMENT_CUES)} AND {pay} > 0
UNION ALL SELECT document_id, 'termination_notice', {pos}, {get(reading.NOTICE, 0)}, CASE WHEN contains(lower(text), 'convenience') THEN 'Convenience' ELSE 'Standard / Breach' END, {notice}, page_number, reading_order FROM b WHERE {has(("termination", "terminate"))} AND {notice} > 0"""
    names = ", ".join(_q(x) for x in reading.CONFIDENCE)
    sure = "CASE field_name " + " ".join(f"WHEN {_q(k)} THEN {v}::DOUBLE" for k, v in reading.CONFIDENCE.items()) + " END"
    why = "CASE field_name " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in reading.MISSING.items()) + f" ELSE {_q(reading.NOT_FOUND)} END"
    return f"""
WITH b AS ({blocks}), s AS (SELECT *, last_value({title} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, reading_order) AS title FROM b),
c(document_id, field_name, pos, raw_value, normalized_value, int_value, page_number, reading_order) AS ({candidates}),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id, field_name ORDER BY pos) = 1),
d AS (SELECT DISTINCT document_id FROM b), n AS (SELECT unnest([{names}]) AS field_name)
SELECT document_id, field_name, raw_value, normalized_value, int_value, CASE WHEN pos IS NULL THEN 0.0::DOUBLE ELSE {sure} END AS confidence, pos IS NOT NULL AS is_found, CASE WHEN pos IS NULL THEN {why} END AS missing_reason, page_number, reading_order
FROM (d CROSS JOIN n) LEFT JOIN f USING (document_id, field_name)"""


def oracle_sql() -> dict[str, str]:
    blocks = base.oracle_sql()["contract_blocks"]
    preambles = PREAMBLES_SQL.format(orders="orders", customer="customer")
    placed, tables, files = PLACED_SQL.format(blocks=f"({blocks})"), TABLES_SQL.format(orders="orders"), FILES_SQL.format(part="part")
    has = lambda words: "(" + " OR ".join(f"contains(lower(text), {_q(w)})" for w in words) + ")"
    exact = lambda words: "(" + " OR ".join(f"contains(text, {_q(w)})" for w in words) + ")"
    clean = lambda x: f"CASE WHEN regexp_extract(trim({x}), {_q('(?i)' + reading.ENDING)}, 1) <> '' THEN trim(regexp_extract(trim({x}), {_q('(?i)' + reading.ENDING)}, 1)) WHEN length(trim({x})) < 60 AND NOT starts_with(trim({x}), 'this') THEN trim({x}) END"
    rejected = " OR ".join(f"starts_with(lower(x), {_q(r)})" for r in reading.REJECTED)
    pair = lambda k: f"regexp_extract(text, {_q(reading.BETWEEN)}, {k})"
    known = fields_sql()
    typed = base.oracle_sql()["typed_sections"]
    kind = typed[typed.index("CASE WHEN length(text) < 120") : typed.index(" AS block_type")]
    reason = f"CASE WHEN b.y1 > b.page_height - {reading.MARGIN} AND ({exact(reading.FOOTER_WORDS)} OR regexp_matches(text, {_q(reading.FOOTER_NUMBER)})) THEN 'sec_footer_zone' WHEN b.y0 < {reading.MARGIN} AND {exact(reading.HEADER_WORDS)} THEN 'sec_header_zone' END"
    types = f"""
SELECT b.document_id, b.page_number, b.reading_order, {reason} AS noise_reason, CASE WHEN min(table_id) IS NOT NULL THEN 'table' WHEN {reason} IS NOT NULL THEN 'sec_noise' ELSE {kind} END AS block_type, min(table_id) AS table_id
FROM ({placed}) b LEFT JOIN ({tables}) t ON b.document_id = t.document_id AND b.page_number = t.page_number AND b.y0 >= t.y0 - 2 AND b.y1 <= t.y1 + 2 AND b.x0 >= t.x0 - 5 GROUP BY b.document_id, b.page_number, b.reading_order, text, b.y0, b.y1, b.page_height"""
    listing = f"""
WITH f AS (SELECT * FROM ({files}) WHERE filename LIKE '%.pdf'), c AS (SELECT * FROM f WHERE folder = CASE WHEN (SELECT count(*) FROM f WHERE folder = 'uploads') > 0 THEN 'uploads' ELSE 'raw' END)
SELECT filename, 'doc_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS document_id FROM (SELECT filename, row_number() OVER (ORDER BY filename) AS n FROM c)"""
    return {
        "contract_fields": known,
        "field_rates": f"SELECT field_name, count(*) AS n_documents, count(*) FILTER (WHERE is_found) AS n_found, round(count(*) FILTER (WHERE is_found) / count(*), 4) AS found_rate, round(coalesce(avg(confidence) FILTER (WHERE is_found), 0), 4) AS mean_confidence FROM ({known}) GROUP BY 1",
        "preamble_parties": f"""
WITH b AS (SELECT * FROM ({preambles}) WHERE page_number <= 2 AND NOT {has(reading.LEGENDS)} AND {has(reading.PREAMBLES)}),
r AS (SELECT *, list_transform(regexp_extract_all(text, {_q("(?i)" + reading.COMPANY)}, 1), lambda x: trim(regexp_replace(x, {_q("(?i)" + reading.LEADING)}, ''))) AS raw, CASE WHEN regexp_matches(text, {_q(reading.BETWEEN)}) THEN [{clean(pair(1))}, {clean(pair(2))}] END AS pair0 FROM b),
n AS (SELECT document_id, page_number, reading_order, list_filter(list_transform(list_filter(raw, lambda x: NOT ({rejected})), lambda x: {clean("x")}), lambda x: x IS NOT NULL AND length(x) > 3) AS names0, list_filter(pair0, lambda x: x IS NOT NULL AND x <> '') AS pair FROM r),
m AS (SELECT *, list_filter(names0, lambda x, i: list_position(names0, x) = i) AS names FROM n),
s AS (SELECT *, sum(len(names)) OVER w AS so_far FROM m WINDOW w AS (PARTITION BY document_id ORDER BY page_number, reading_order)),
e AS (SELECT *, coalesce(bool_or(so_far >= 2 OR (so_far = 0 AND pair IS NOT NULL)) OVER (PARTITION BY document_id ORDER BY page_number, reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM s),
u AS (SELECT document_id, page_number, reading_order, CASE WHEN len(names) > 0 THEN names WHEN so_far = 0 THEN pair END AS taken FROM e WHERE NOT ended),
v AS (SELECT document_id, page_number, reading_order, unnest(range(len(taken))) AS k, unnest(taken) AS name FROM u WHERE taken IS NOT NULL)
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY page_number, reading_order, k) - 1)::INT AS ord, name, page_number, reading_order FROM v""",
        "placed_types": types,
        "readable_blocks": f"SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, reading_order)::INT AS n, page_number, reading_order, text FROM ({placed}) JOIN (SELECT document_id, page_number, reading_order FROM ({types}) WHERE noise_reason IS NULL) USING (document_id, page_number, reading_order)",
        "table_cells": """
WITH i AS (SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)::INT AS row_idx, * FROM lineitem WHERE l_orderkey % 50 = 0),
a AS (SELECT document_id, row_idx, unnest([0, 1, 2])::INT AS col_idx, unnest([l_linenumber::VARCHAR, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE l_partkey::VARCHAR END, l_quantity::INT::VARCHAR]) AS text FROM i)
SELECT document_id, 1 AS table_id, row_idx, col_idx, text, false AS is_header FROM a UNION ALL SELECT DISTINCT document_id, 1, 0, h.c, h.t, true FROM a, (VALUES (0, 'line'), (1, 'part'), (2, 'quantity')) h(c, t)""",
        "corpus_listing": listing,
        "next_document_ids": f"""
WITH g AS (SELECT max(document_id[5:]::INT) AS top FROM ({listing})), r AS (SELECT filename, row_number() OVER (ORDER BY filename) + top AS n FROM ({files}), g WHERE folder = 'raw')
SELECT filename, 'doc_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS document_id FROM r""",
        "saved_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 100 = 1",
        "region_report": """
WITH r AS (SELECT r_regionkey, r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT -1 AS n, '| r_regionkey | r_name | nations |' AS line UNION ALL SELECT 0, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey)::INT, '| ' || r_regionkey || ' | ' || r_name || ' | ' || nations || ' |' FROM r""",
    }
