"""Sources: text blocks of documents, and contract-shaped blocks rendered from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Valid in Spark and in DuckDB. One contract per order, eight blocks each; {blocks} has a row of an order for each.
CONTRACT_BLOCKS_SQL = """
SELECT o.o_orderkey AS document_id, o.reading_order, CASE WHEN o.reading_order < 3 THEN 1 ELSE 2 END AS page_number,
  CASE o.reading_order
    WHEN 0 THEN CASE o.o_orderkey % 4 WHEN 0 THEN 'MASTER SERVICES AGREEMENT' WHEN 1 THEN 'SUPPLY AGREEMENT'
                WHEN 2 THEN 'FIRST AMENDMENT' ELSE 'SOFTWARE LICENSE AGREEMENT' END
    WHEN 1 THEN 'This Agreement is entered into as of ' || CASE o.o_orderkey % 3 WHEN 0 THEN 'June' WHEN 1 THEN 'March' ELSE 'October' END
                || ' ' || CAST(1 + o.o_orderkey % 28 AS VARCHAR(9)) || ', ' || CAST(1995 + o.o_orderkey % 7 AS VARCHAR(9))
                || ' by and between ' || c.c_name || ' Inc. and the Supplier.'
    WHEN 2 THEN 'SECTION ' || CAST(1 + o.o_orderkey % 9 AS VARCHAR(9)) || '. Payment Terms'
    WHEN 3 THEN CASE o.o_orderkey % 5 WHEN 0 THEN 'Invoices are payable within thirty (30) days of receipt.' WHEN 1 THEN 'Customer shall pay all fees net 45 days after the invoice date.'
                WHEN 2 THEN 'Fees for the services are as agreed.' WHEN 3 THEN 'Payment of invoices is due within fifteen (15) days.' ELSE 'Invoices shall be paid within 60 days; late sums bear interest.' END
    WHEN 4 THEN CASE o.o_orderkey % 6 WHEN 0 THEN 'Supplier shall provide a monthly report to Customer.' WHEN 1 THEN 'If a force majeure event occurs, Supplier shall notify Customer within 15 days after discovering the breach.'
                WHEN 2 THEN 'Supplier shall maintain insurance throughout the term.' WHEN 3 THEN 'Customer must return the goods within 10 days after receipt of notice.'
                WHEN 4 THEN 'Supplier agrees to deliver all goods before June 30, 2027.' ELSE 'Each party shall keep the records in good order.' END
    WHEN 5 THEN CASE WHEN o.o_orderkey % 8 = 2 THEN 'Section 4.2 of the Agreement shall be deleted in its entirety and the following shall be inserted; all other terms remain in full force and effect.'
                WHEN o.o_orderkey % 8 = 6 THEN 'Section 7 of the Agreement shall be amended by adding the following insurance coverage.' ELSE 'Either party may terminate this Agreement upon prior written notice of ' || CASE o.o_orderkey % 3 WHEN 0 THEN 'sixty (60)' WHEN 1 THEN 'thirty (30)' ELSE '90' END || ' days.' END
    WHEN 6 THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'This Agreement shall automatically renew for successive terms of one year, unless notice of 60 days is given.' ELSE 'This Agreement shall expire on June 30, ' || CAST(2003 + o.o_orderkey % 5 AS VARCHAR(9)) || '.' END
    ELSE 'This Agreement is governed by the laws of the State of ' || CASE o.o_orderkey % 4 WHEN 0 THEN 'Delaware' WHEN 1 THEN 'Texas' WHEN 2 THEN 'California' ELSE 'Nevada' END || '.' END AS text
FROM {blocks} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, reading_order, page_number, text."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("reading_order"))
    return spark.sql(CONTRACT_BLOCKS_SQL, blocks=orders, customer=table(spark, sf_dir, "customer"))


def document_blocks(documents: DataFrame) -> DataFrame:
    """A block per line that is not blank: block_id counts blank lines too; white space is normalised as Unicode."""
    lines = documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("reading_order", "raw_text"))
    normal = F.trim(F.regexp_replace("raw_text", r"(?U)\s+", " "))
    block_id = F.concat(F.col("document_id").cast("string"), F.lit("_p001_b"), F.lpad((F.col("reading_order") + 1).cast("string"), 2, "0"))
    padded = F.when(F.col("reading_order") < 99, block_id).otherwise(F.concat(F.col("document_id").cast("string"), F.lit("_p001_b"), (F.col("reading_order") + 1).cast("string")))
    return lines.select("document_id", F.col("reading_order").cast("int"), padded.alias("block_id"), normal.alias("text")).filter("text != ''")
