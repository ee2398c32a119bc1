"""Collections that grow: documents ingested whole or not at all, and contracts that come again, with the SQL of what is visible in the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, facts, intake, portfolio
from ..sources import contracts
from ..sources.collection import Collection, IngestError
from ..sources.shared import shared_folder
from ..streaming import rebuild
from . import chunks
from . import queries as base

BATCHES = 3
COMING = {0: "true", 1: "o_orderkey % 3 = 0", 2: "o_orderkey % 9 = 0"}  # of the n-th arrival: which contracts come, rendered as another's text


def _with_blocks(documents: DataFrame) -> dict[str, DataFrame]:
    lines = contracts.document_blocks(documents.select(F.col("document_id").alias("doc_id"), "text"))
    return {"blocks": lines}


def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads in three batches. A batch with a text too short to have been read fails as a whole; it comes again without those, and once more."""
    docs = contracts.table(spark, sf_dir, "documents").select("doc_id", F.format_string("%09d.pdf", "doc_id").alias("filename"), F.coalesce("text", F.lit("")).alias("text"))
    held = Collection(spark, shared_folder(spark, "collection"))
    refuse = F.when(F.length("text") < intake.LEAST_CHARS_A_PAGE, "needs_ocr")
    for k in range(BATCHES):
        files = docs.filter(F.col("doc_id") % BATCHES == k)
        try:
            held.ingest(f"upload {k}", files, refuse, _with_blocks)
        except IngestError:
            held.ingest(f"upload {k}", files.filter(refuse.isNull()), refuse, _with_blocks)
        held.ingest(f"upload {k}", files.filter(refuse.isNull()), refuse, _with_blocks)
    lines = held.table("blocks").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    seen = held.table("documents").join(lines, "document_id", "left")
    return seen.select("document_id", "filename", F.length("text").cast("long").alias("n_chars"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


def derived(documents: DataFrame) -> dict[str, DataFrame]:
    """Facts, edges and chunks of documents (document_id, blocks), each a function of one document."""
    blocks = documents.select("document_id", F.inline("blocks"))
    found = facts.extract_facts(blocks)
    edges = portfolio.graph_edges(portfolio.parties(blocks), found)
    contract = F.regexp_extract(F.concat_ws(" ", "source", "target"), r"contract_(\d+)", 1).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.col("blocks")), lambda b: b["text"]), "\n")
    return {
        "facts": found,
        "edges": edges.withColumn("document_id", contract),
        "chunks": chunking.described_chunks(documents.select(F.col("document_id").alias("doc_id"), text.alias("text"))),
    }


def _arrival(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Contracts of the arrival ``shift``, which have the text of the order so many keys further."""
    orders = contracts.table(spark, sf_dir, "orders").filter(COMING[shift]).select((F.col("o_orderkey") + shift).alias("o_orderkey"), "o_custkey")
    blocks = spark.sql(contracts.CONTRACT_BLOCKS_SQL, blocks=orders.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("reading_order")), customer=contracts.table(spark, sf_dir, "customer"))
    block = F.struct("page_number", "reading_order", "text")
    rows = blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    return rows.select((F.col("document_id") - shift).alias("document_id"), F.lit(shift).alias("seq"), "blocks")


def rebuilt_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contracts arrive, then a third of them changed, then a ninth once more; what is derived of each follows its last text."""
    work = shared_folder(spark, "rebuilt")
    held = Collection(spark, f"{work}/collection")
    for shift in COMING:
        arriving = _arrival(spark, sf_dir, shift)
        arriving.write.mode("append").parquet(f"{work}/in")
        rebuild.follow(spark, f"{work}/in", arriving.schema, held, derived, f"{work}/log", "contracts", "seq")
    count = lambda name: held.table(name).groupBy("document_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    return held.table("facts").join(count("edges"), "document_id", "left").join(count("chunks"), "document_id", "left")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (ingested_documents, rebuilt_contracts)}


def oracle_sql() -> dict[str, str]:
    known = base.oracle_sql()
    rendered = []
    for shift, coming in COMING.items():
        later = [f"NOT ({c})" for k, c in COMING.items() if k > shift]
        orders = f"(SELECT *, unnest(range(8))::INT AS reading_order FROM (SELECT o_orderkey + {shift} AS o_orderkey, o_custkey FROM orders WHERE {' AND '.join([coming, *later])}))"
        rendered.append(f"SELECT document_id - {shift} AS document_id, reading_order, page_number, text FROM ({contracts.CONTRACT_BLOCKS_SQL.format(blocks=orders, customer='customer')})")
    last = " UNION ALL ".join(rendered)
    of_last = lambda sql: sql.replace(known["contract_blocks"], "SELECT * FROM last_text")
    as_lines = "(SELECT document_id AS doc_id, string_agg(text, chr(10) ORDER BY page_number, reading_order) AS text FROM last_text GROUP BY 1)"
    chunked = chunks.oracle_sql()["described_chunks"].replace("FROM documents)", f"FROM {as_lines})")
    edges = f"SELECT coalesce(nullif(regexp_extract(source, 'contract_(\\d+)', 1), ''), regexp_extract(target, 'contract_(\\d+)', 1))::BIGINT AS document_id FROM ({of_last(known['graph_edges'])})"
    return {
        "ingested_documents": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id % {BATCHES}, doc_id) AS n FROM documents WHERE length(coalesce(text, '')) >= {intake.LEAST_CHARS_A_PAGE}),
b AS (SELECT document_id AS doc_id, count(*) AS n_blocks FROM ({known["document_blocks"]}) GROUP BY 1)
SELECT printf('doc_%02d', n) AS document_id, printf('%09d.pdf', doc_id) AS filename, length(text) AS n_chars, coalesce(n_blocks, 0) AS n_blocks FROM d LEFT JOIN b USING (doc_id)""",
        "rebuilt_contracts": f"""
WITH last_text AS MATERIALIZED ({last}), f AS ({of_last(known["contract_facts"])}), e AS (SELECT document_id, count(*) AS n_edges FROM ({edges}) GROUP BY 1), c AS (SELECT document_id, count(*) AS n_chunks FROM ({chunked}) GROUP BY 1)
SELECT * FROM f LEFT JOIN e USING (document_id) LEFT JOIN c USING (document_id)""",
    }
