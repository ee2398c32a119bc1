"""A library of contracts rendered from the relational tables: one contract per order, with its file, type, day, opening and parties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .contracts import table

#: Valid in Spark and in DuckDB.
LIBRARY_SQL = """
SELECT o_orderkey AS document_id,
  CASE o_orderkey % 4 WHEN 0 THEN lower(c_mktsegment) || '-Master Services Agreement ' || CAST(o_orderkey % 50 AS VARCHAR(9)) || '.pdf' WHEN 1 THEN lower(c_mktsegment) || '_Supply Agreement.pdf'
    WHEN 2 THEN 'First Amendment (' || lower(c_mktsegment) || ').pdf' ELSE 'Software License Agreement.pdf' END AS filename,
  CASE o_orderkey % 4 WHEN 0 THEN 'Master Services Agreement' WHEN 1 THEN 'Supply Agreement' WHEN 2 THEN 'Amendment' ELSE 'Software License Agreement' END AS contract_type,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS effective_date,
  CASE WHEN o_orderkey % 4 <> 2 THEN 'This Agreement is made for services.' WHEN o_orderkey % 3 = 0 THEN 'This First Amendment to the Master Services Agreement is made by the parties.'
    WHEN o_orderkey % 3 = 1 THEN 'This First Amendment changes the ' || lower(c_mktsegment) || ' supply terms.' ELSE 'This First Amendment is made by the parties.' END AS opening,
  CASE WHEN o_orderkey % 8 = 2 THEN 2 WHEN o_orderkey % 8 = 6 THEN 1 ELSE 0 END AS n_changes
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
#: Valid in both: one or two parties of each.
PARTIES_SQL = """
SELECT o_orderkey AS document_id, 0 AS ord, c_name || ', Inc.' AS name FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT o_orderkey, 1, 'Northern Supply ' || CAST(o_custkey % 700 AS VARCHAR(9)) || ' LLC' FROM {orders} WHERE o_orderkey % 3 <> 0
"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, filename, contract_type, effective_date, opening, n_changes."""
    return spark.sql(LIBRARY_SQL, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def library_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, ord, name."""
    return spark.sql(PARTIES_SQL, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
