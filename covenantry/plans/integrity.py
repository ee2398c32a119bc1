"""Sections by pages, actors by their obligations, a contract by its id, and a graph with planted faults, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import graph, ingest, provenance, registry
from ..sources import contracts
from ..sources.shared import stored
from . import graphs
from . import queries as base

ASKED = ("contract_100", "42", "contract_-1")

#: Valid in Spark and in DuckDB: the blocks of each contract, and of some a third and a fourth page with more headings.
PAGES_SQL = """
SELECT document_id, page_number, reading_order, text FROM {blocks}
UNION ALL SELECT o_orderkey, 3, 8, CASE o_orderkey % 4 WHEN 0 THEN 'ARTICLE IV: Duties of the Supplier' WHEN 1 THEN 'DEFINITIONS' WHEN 2 THEN '4.2 Fees and Costs' ELSE 'plain words' END FROM {orders} WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 4, 9, 'More is said on the fourth page.' FROM {orders} WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 4, 10, CASE o_orderkey % 2 WHEN 0 THEN 'Clause 12.' ELSE 'Exhibit A' END FROM {orders} WHERE o_orderkey % 3 = 2
"""
#: Valid in both: customers and orders as nodes; some have no id, some are not there, some boxes are inside out.
NODES_SQL = """
SELECT CASE WHEN c_custkey % 97 = 0 THEN ' ' WHEN c_custkey % 89 = 0 THEN NULL ELSE 'party_' || CAST(c_custkey AS VARCHAR(12)) END AS node_id, 10.0 AS x0, 20.0 AS y0, CASE WHEN c_custkey % 31 = 0 THEN 5.0 WHEN c_custkey % 7 = 0 THEN NULL ELSE 90.0 END AS x1, CASE WHEN c_custkey % 37 = 0 THEN 15.0 ELSE 40.0 END AS y1 FROM {customer}
UNION ALL SELECT 'contract_' || CAST(o_orderkey AS VARCHAR(12)), NULL, NULL, NULL, NULL FROM {orders} WHERE o_orderkey % 50 <> 0
"""
EDGES_SQL = """
SELECT 'edge_' || CAST(o_orderkey AS VARCHAR(12)) AS edge_id, 'contract_' || CAST(o_orderkey AS VARCHAR(12)) AS source, CASE WHEN o_orderkey % 41 = 0 THEN 'contract_' || CAST(o_orderkey AS VARCHAR(12)) WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'party_' || CAST(o_custkey AS VARCHAR(12)) END AS target FROM {orders}
"""
FACTS_SQL = """
SELECT 'fact_' || CAST(o_orderkey AS VARCHAR(12)) AS fact_id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey END AS document_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'b99' ELSE 'b' || CAST(o_orderkey % 8 AS VARCHAR(2)) END AS block_id,
  0.0 AS x0, CASE WHEN o_orderkey % 17 = 0 THEN 9.0 ELSE 1.0 END AS y0, 5.0 AS x1, 5.0 AS y1 FROM {orders}
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = spark.sql(PAGES_SQL, blocks=contracts.contract_blocks(spark, sf_dir), orders=contracts.table(spark, sf_dir, "orders"))
    return blocks.select("*", F.concat(F.lit("b"), F.col("reading_order").cast("string")).alias("block_id"), ingest.block_type(F.col("text")).alias("block_type"))


def section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.section_extents(_pages(spark, sf_dir))


def top_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.top_actors(base.contract_obligations(spark, sf_dir))


def contracts_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts asked for by their ids, with or without the prefix; one of them is not there."""
    nodes = graphs._nodes(graphs._Inputs(spark, sf_dir, ("facts",)))
    first, *more = (graph.get_contract(nodes, x) for x in ASKED)
    for found in more:
        first = first.unionByName(found)
    return first


def _faulty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    tables = {name: contracts.table(spark, sf_dir, name) for name in ("customer", "orders")}
    boxed = lambda df: df.withColumn("box", F.struct("x0", "y0", "x1", "y1").cast(provenance.BOX)).drop("x0", "y0", "x1", "y1")
    blocks = contracts.contract_blocks(spark, sf_dir).select("document_id", F.concat(F.lit("b"), F.col("reading_order").cast("string")).alias("block_id"))
    return boxed(spark.sql(NODES_SQL, **tables)), spark.sql(EDGES_SQL, orders=tables["orders"]), boxed(spark.sql(FACTS_SQL, orders=tables["orders"])), blocks


def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.findings(*_faulty(spark, sf_dir))


def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, facts, blocks = _faulty(spark, sf_dir)
    return provenance.report(nodes, edges, facts, stored(provenance.findings(nodes, edges, facts, blocks), "findings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (section_extents, top_actors, contracts_by_id, graph_findings, graph_report)}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    known, walks = base.oracle_sql(), graphs.oracle_sql()
    typed = known["typed_sections"]
    kind = typed[typed.index("CASE WHEN length(text) < 120") : typed.index(" AS block_type")]
    section, keyword, number = _q("(?i)" + P.HEADING_SECTION), _q("(?i)" + P.HEADING_KEYWORD), _q(P.HEADING_NUMBER)
    get = lambda p, k: f"regexp_extract(text, {p}, {k})"
    pick = lambda a, b, c: f"CASE WHEN regexp_matches(text, {section}) THEN {a} WHEN regexp_matches(text, {number}) THEN {b} WHEN regexp_matches(text, {keyword}) THEN {c} END"
    capitals = f"array_to_string(list_transform(string_split({get(keyword, 1)}, ' '), lambda z: upper(z[1]) || lower(z[2:])), ' ')"
    pages = PAGES_SQL.format(blocks=f"({known['contract_blocks']})", orders="orders")
    nodes, edges, facts = NODES_SQL.format(customer="customer", orders="orders"), EDGES_SQL.format(orders="orders"), FACTS_SQL.format(orders="orders")
    bad = "(x0 > x1 OR y0 > y1)"
    findings = f"""
SELECT 'node' AS subject, node_id AS id, 'empty_id' AS finding, true AS is_error FROM n WHERE trim(coalesce(node_id, '')) = '' UNION ALL SELECT 'node', node_id, 'malformed_box', true FROM n WHERE {bad}
UNION ALL SELECT 'edge', edge_id, 'self_loop', false FROM e WHERE source = target
UNION ALL SELECT 'edge', edge_id, 'orphan_source', true FROM e WHERE NOT EXISTS (FROM n WHERE node_id IS NOT DISTINCT FROM source) UNION ALL SELECT 'edge', edge_id, 'orphan_target', true FROM e WHERE NOT EXISTS (FROM n WHERE node_id IS NOT DISTINCT FROM target)
UNION ALL SELECT 'fact', fact_id, 'no_evidence', true FROM f WHERE document_id IS NULL UNION ALL SELECT 'fact', fact_id, 'malformed_box', true FROM f WHERE document_id IS NOT NULL AND {bad}
UNION ALL SELECT 'fact', fact_id, 'unknown_block', false FROM f WHERE document_id IS NOT NULL AND block_id NOT IN ('b0', 'b1', 'b2', 'b3', 'b4', 'b5', 'b6', 'b7')"""
    planted = f"WITH n AS MATERIALIZED ({nodes}), e AS MATERIALIZED ({edges}), f AS MATERIALIZED ({facts})"
    count = lambda *names: f"(SELECT count(*) FROM w WHERE finding IN ({', '.join(map(_q, names))}))"
    ids = ", ".join(_q("contract_" + x.removeprefix("contract_")) for x in ASKED)
    with_graph = walks["amendments_of_contracts"][: walks["amendments_of_contracts"].rindex("SELECT target AS contract_id")]
    return {
        "section_extents": f"""
WITH b AS ({pages}), t AS (SELECT *, {kind} AS kind FROM b), h AS (SELECT *, kind = 'heading' AS head, greatest(1, sum((kind = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY page_number, reading_order)) AS n FROM t),
s AS (SELECT document_id, n, max({pick(get(section, 1) + " || ' ' || " + get(section, 2), get(number, 1), f"upper({get(keyword, 1)})")}) FILTER (WHERE head) AS section_number, max({pick(f"trim({get(section, 3)})", f"trim({get(number, 3)})", capitals)}) FILTER (WHERE head) AS section_title,
  max(page_number) FILTER (WHERE head) AS start_page, max(page_number) AS last_page, string_agg('b' || reading_order, ',' ORDER BY page_number, reading_order) AS block_ids FROM h GROUP BY 1, 2)
SELECT document_id, n::INT AS n, section_number, section_title, start_page, coalesce(lead(start_page) OVER (PARTITION BY document_id ORDER BY n), max(last_page) OVER (PARTITION BY document_id)) AS end_page, block_ids FROM s QUALIFY start_page IS NOT NULL""",
        "top_actors": f"""
WITH o AS MATERIALIZED ({known["contract_obligations"]}), u AS (SELECT * FROM o UNION ALL SELECT * REPLACE ('all' AS temporal_type) FROM o)
SELECT temporal_type, actor, count(*) AS n_obligations, row_number() OVER (PARTITION BY temporal_type ORDER BY count(*) DESC, min((document_id, reading_order, unit)))::INT AS rank FROM u GROUP BY 1, 2 QUALIFY rank <= {registry.TOP_ACTORS}""",
        "contracts_by_id": f"{with_graph} SELECT * FROM nodes WHERE node_type IN ('CONTRACT', 'AMENDMENT') AND node_id IN ({ids})",
        "graph_findings": f"{planted} {findings}",
        "graph_report": f"""{planted}, w AS MATERIALIZED ({findings}), c AS (SELECT (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM e) AS total_edges, (SELECT count(*) FROM f) AS total_facts)
SELECT *, total_facts - {count("no_evidence")} AS facts_with_provenance, round((total_facts - {count("no_evidence")}) / total_facts, 4) AS provenance_coverage, {count("orphan_source", "orphan_target")} AS orphan_edges, round({count("orphan_source", "orphan_target")} / total_edges, 4) AS orphan_edge_rate,
  {count("malformed_box")} AS invalid_boxes, {count("self_loop")} AS self_loops, {count("empty_id")} AS empty_ids, {count("unknown_block")} AS unknown_blocks, NOT EXISTS (FROM w WHERE is_error) AS is_valid FROM c""",
    }
