"""Registered queries of events, evidence, claims, questions, chunks, comparison and streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import chunking, evidence, facts, ingest, lifecycle, obligations, portfolio, questions, retrieval
from ..sources import contracts
from ..sources.shared import shared_folder
from ..streaming import events as streams
from . import queries as base

TODAY = "1997-01-01"
POOL = 50  # as deep as rankings are fused

#: Valid in Spark and in DuckDB. A claim on each contract, the block it cites (null: none) and the page it says.
CLAIMS_SQL = """
SELECT o_orderkey AS claim_id, o_orderkey AS document_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Invoices are payable within 30 days of receipt.' WHEN 1 THEN 'Customer may pay all fees after the invoice date.'
    WHEN 2 THEN 'The contract does not renew.' ELSE 'Fees for the services are as agreed' END AS text,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 9 WHEN o_orderkey % 4 = 2 THEN 6 ELSE 3 END AS reading_order,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 WHEN o_orderkey % 19 = 0 THEN 3 ELSE 2 END AS page_number
FROM {orders}
"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLAIMS_SQL, orders=contracts.table(spark, sf_dir, "orders"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.extract_facts(contracts.contract_blocks(spark, sf_dir))


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contracts.contract_blocks(spark, sf_dir)
    expirations, amendments = facts.expiration_dates(ingest.with_sections(blocks)), facts.amendment_facts(blocks)
    return lifecycle.lifecycle_events(facts.extract_facts(blocks), expirations, amendments, obligations.extract_obligations(blocks))


def expiration_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.expiration_dates(ingest.with_sections(contracts.contract_blocks(spark, sf_dir)))


def amendment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.amendment_facts(contracts.contract_blocks(spark, sf_dir))


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.milestones(lifecycle_events(spark, sf_dir), F.to_date(F.lit(TODAY)))


def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.window_chunks(contracts.table(spark, sf_dir, "documents"))


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_chunks(contracts.table(spark, sf_dir, "documents"))


def described_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.described_chunks(contracts.table(spark, sf_dir, "documents"))


def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_statistics(section_chunks(spark, sf_dir))


def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = _claims(spark, sf_dir).filter("reading_order IS NOT NULL").drop("text")
    return evidence.validate_references(references, contracts.contract_blocks(spark, sf_dir)).select("claim_id", "status")


def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    name = F.concat_ws("/", F.col("document_id").cast("string"), F.col("reading_order").cast("string")).alias("evidence_id")
    spans = contracts.contract_blocks(spark, sf_dir).select(name, "text")
    citations = claims.filter("reading_order IS NOT NULL").select("claim_id", F.lit(0).alias("position"), name)
    return evidence.verify_claims(claims.select("claim_id", "text"), citations, spans)


def turn_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = contracts.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", questions.intent(F.col("text")).alias("intent"), F.md5(evidence.sanitise(F.col("text"))).alias("sanitised_md5"))


def _pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The best chunks of each question by BM25 and by the share of its tokens, from one reading of the texts."""
    chunks, asked = base._ranking_inputs(spark, sf_dir)
    found = retrieval.top(chunks, asked, POOL, ("lexical", "overlap"))
    return (found["lexical"], found["overlap"]) if found is not None else (retrieval.bm25(chunks, asked, POOL), retrieval.overlap(chunks, asked, POOL))


def _fused(lexical: DataFrame, other: DataFrame) -> DataFrame:
    return retrieval.fuse([(lexical, 0.7), (other, 0.3)], base.TOP)


def fused_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(*_pools(spark, sf_dir))


def cosine_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked vector is relevant if it has the query's label and is another one."""
    label = contracts.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = base.cosine_top(spark, sf_dir)
    joined = ranked.join(label.toDF("query_id", "want"), "query_id").join(label.toDF("chunk_id", "got"), "chunk_id")
    relevant = F.coalesce((F.col("want") == F.col("got")) & (F.col("query_id") != F.col("chunk_id")), F.lit(False))
    return questions.evaluate(joined.select("query_id", "rank", relevant.alias("relevant")))


def party_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contracts.contract_blocks(spark, sf_dir)
    return portfolio.comparison(portfolio.parties(blocks), facts.extract_facts(blocks))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.graph_nodes(portfolio.parties(contracts.contract_blocks(spark, sf_dir)), _facts(spark, sf_dir))


def graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.graph_check(base.graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir))


def _arriving(sf_dir: str, name: str) -> str:
    """A table as a stream's source; as a pattern it may be one file or a folder."""
    return f"{sf_dir}/{{{name}.parquet}}"


def streamed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, work = contracts.table(spark, sf_dir, "documents").schema, shared_folder(spark, "streamed-blocks")
    found = streams.stream_blocks(spark, _arriving(sf_dir, "documents"), schema, work + "/out", work + "/log")
    return found.select("document_id", "reading_order", "block_id", "text")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill is one batch, whatever the order of its files; rows that arrive later may be a day late."""
    schema, work = contracts.table(spark, sf_dir, "events").schema, shared_folder(spark, "streamed-windows")
    found = streams.stream_windows(spark, _arriving(sf_dir, "events"), schema, work + "/out", work + "/log", "1 hour", "1 day")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        expiration_dates, amendment_facts, lifecycle_events, milestones, window_chunks, section_chunks, described_chunks, chunk_statistics, reference_status, claim_status, turn_intents, fused_top,
        cosine_evaluation, party_comparison, graph_nodes, graph_check, streamed_blocks, streamed_windows,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """No SQL for chunks: where one ends depends on where the last ended. They are tested against brute force."""
    known = base.oracle_sql()
    q = lambda x: "'" + x.replace("'", "''") + "'"
    ci = lambda x: q("(?i)" + x)
    claims = CLAIMS_SQL.format(orders="orders")
    expirations = f"""
WITH b AS ({known["contract_blocks"]}), t AS (SELECT *, CASE WHEN length(text) <= 150 THEN CASE WHEN regexp_matches(text, {ci(P.HEADING_SECTION)}) THEN trim(regexp_extract(text, {ci(P.HEADING_SECTION)}, 3))
    WHEN regexp_matches(text, {q(P.HEADING_NUMBER)}) THEN trim(regexp_extract(text, {q(P.HEADING_NUMBER)}, 3)) WHEN regexp_matches(text, {ci(P.HEADING_KEYWORD)}) THEN regexp_extract(text, {ci(P.HEADING_KEYWORD)}, 1) END END AS own FROM b),
s AS (SELECT *, lower(last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, reading_order)) AS title,
  coalesce({", ".join(f"nullif(regexp_extract(text, {ci(d)}, 0), '')" for d in P.DATES)}) AS day FROM t)
SELECT document_id, (list(day ORDER BY page_number, reading_order))[1] AS expiration_date FROM s
WHERE (contains(title, 'term') OR contains(title, 'expiration')) AND regexp_matches(text, {ci(P.EXPIRATION_CUE)}) AND day IS NOT NULL GROUP BY 1"""
    amendments = " UNION ALL ".join(
        f"SELECT document_id, reading_order, '{a}' AS action, coalesce(nullif(regexp_extract(text, {ci(p)}, 1), ''), 'General') AS target_section FROM ({known['contract_blocks']}) WHERE regexp_matches(text, {ci(p)})"
        for a, p in P.AMENDMENT_ACTIONS
    )
    life = f"""
WITH f AS ({known["contract_facts"]}), x AS ({expirations}), a AS ({amendments}), o AS ({known["contract_obligations"]}), e AS (
  SELECT document_id, 0 AS branch, 'effective_date' AS event_type, effective_date AS date_or_trigger, true AS is_fixed_date, 0 AS reading_order, 0 AS unit FROM f
  UNION ALL SELECT document_id, 1, 'expiration', expiration_date, true, 0, 0 FROM x
  UNION ALL SELECT document_id, 2, 'renewal', renewal[1:100], false, 0, 0 FROM f
  UNION ALL SELECT document_id, 3, 'notice_deadline', notice_days || ' days prior notice', false, 0, 0 FROM f
  UNION ALL SELECT document_id, 4, 'payment_deadline', 'Invoice received + ' || payment_days || ' days', false, 0, 0 FROM f
  UNION ALL SELECT document_id, 5, 'amendment_effective_date', action, false, reading_order, 0 FROM a
  UNION ALL SELECT document_id, 6, 'recurring_obligation', action[1:50], false, reading_order, unit FROM o WHERE temporal_type = 'recurring')
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY branch, reading_order, unit, date_or_trigger)::INT AS n, event_type, date_or_trigger, is_fixed_date
FROM e WHERE date_or_trigger IS NOT NULL"""
    bounds = " ".join(f"WHEN days <= {w} THEN 'within_{w}'" for w in lifecycle.WINDOWS)
    any_of = lambda x, words: "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"
    intents = "CASE " + " ".join("WHEN " + " AND ".join(any_of("lower(text)", g) for g in groups) + f" THEN {q(name)}" for name, groups in P.INTENTS) + " ELSE 'information' END"
    words = "regexp_extract_all(lower(text), '\\b[a-z]{3,}\\b')"
    without = lambda stop: f"list_filter({words}, lambda w: w NOT IN ({', '.join(q(s) for s in stop)}))"
    numbers = lambda x: f"regexp_extract_all({x}, {q(P.CLAIM_NUMBER)})"
    denies, rlike = f"regexp_matches(lower(text), {q(P.NEGATION)})", lambda p: f"regexp_matches(lower(source), {q(p)})"
    nodes = f"""
WITH f AS ({known["contract_facts"]}), g AS ({known["graph_edges"]})
SELECT 'contract_' || document_id AS node_id, CASE WHEN contract_type = 'Amendment' THEN 'AMENDMENT' ELSE 'CONTRACT' END AS node_type FROM f
UNION ALL SELECT DISTINCT target, CASE relationship WHEN 'HAS_PARTY' THEN 'PARTY' ELSE 'JURISDICTION' END FROM g WHERE relationship <> 'COUNTERPARTY_TO'"""
    pool = known["bm25_top"].replace(f"rank <= {base.TOP}", f"rank <= {POOL}")
    attributes = " UNION ALL ".join(
        f"SELECT party_key, '{a}' AS attribute, coalesce(lower({a}::VARCHAR), 'not specified') AS value FROM f"
        for a in ("contract_type", "effective_date", "renewal", "payment_days", "notice_days", "governing_law")
    )
    return {
        "expiration_dates": expirations,
        "amendment_facts": amendments,
        "lifecycle_events": life,
        "milestones": f"""
WITH l AS ({life}), d AS (SELECT event_type, CASE WHEN is_fixed_date THEN date_diff('day', DATE '{TODAY}', try_strptime(date_or_trigger, '%B %d, %Y')::DATE) END AS days FROM l)
SELECT event_type, CASE WHEN days IS NULL THEN 'undated' WHEN days < 0 THEN 'past' {bounds} ELSE 'later' END AS time_window, count(*) AS n_events FROM d GROUP BY ALL""",
        "reference_status": f"""
WITH c AS ({claims}), b AS ({known["contract_blocks"]}), p AS (SELECT document_id, max(page_number) AS pages FROM b GROUP BY 1)
SELECT c.claim_id, CASE WHEN b.page_number IS NULL THEN 'INVALID_BLOCK' WHEN pages IS NULL OR c.page_number IS NULL OR c.page_number < 1 OR c.page_number > pages THEN 'INVALID_PAGE'
  WHEN b.page_number <> c.page_number THEN 'INCONSISTENT_PROVENANCE' WHEN coalesce(trim(b.text), '') = '' THEN 'MISSING_TEXT' ELSE 'VALID' END AS status
FROM c LEFT JOIN p USING (document_id) LEFT JOIN b ON b.document_id = c.document_id AND b.reading_order = c.reading_order WHERE c.reading_order IS NOT NULL""",
        "claim_status": f"""
WITH c AS ({claims}), b AS ({known["contract_blocks"]}),
j AS (SELECT claim_id, c.text, c.reading_order AS cited, b.text AS source FROM c LEFT JOIN b ON b.document_id = c.document_id AND b.reading_order = c.reading_order),
w AS (SELECT *, CASE WHEN len({without(P.CLAIM_STOPWORDS)}) > 0 THEN {without(P.CLAIM_STOPWORDS)} ELSE {without(P.CLAIM_STOPWORDS[:3])} END AS words FROM j),
s AS (SELECT *, len(list_filter(words, lambda t: contains(lower(source), t))) / len(words) AS share FROM w)
SELECT claim_id, CASE WHEN cited IS NULL THEN 0 ELSE 1 END::BIGINT AS n_cited, CASE WHEN cited IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN source IS NULL THEN 'UNSUPPORTED'
  WHEN contains(lower(text), 'renew') AND contains(lower(source), 'renew') AND ((NOT {denies} AND {rlike(P.NO_RENEWAL)})
    OR ({denies} AND {rlike(P.RENEWAL)} AND NOT {rlike(P.NOT_RENEW)} AND {any_of("lower(text)", P.DENIALS)})) THEN 'CONTRADICTED'
  WHEN len(list_filter({numbers("text")}, lambda n: NOT list_contains({numbers("source")}, n))) > 0 THEN 'UNSUPPORTED'
  WHEN regexp_matches(lower(text), '\\bmay\\b') AND NOT {rlike(chr(92) + "bmay" + chr(92) + "b")} AND {rlike(P.MANDATORY)} THEN 'PARTIALLY_SUPPORTED'
  WHEN len(words) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN share >= 0.5 THEN 'SUPPORTED' WHEN share >= 0.3 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM s""",
        "turn_intents": f"""
SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN {intents} END AS intent,
  md5(regexp_replace(regexp_replace(replace(trim(text), chr(13) || chr(10), chr(10)), {q("(?i)" + P.DIRECTIVES)}, '[NEUTRALIZED_DIRECTIVE: \\1]', 'g'), {q(P.FENCE)}, '''''''', 'g')) AS sanitised_md5 FROM conversations""",
        "fused_top": f"""
WITH k AS ({pool}), a AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM benchmark),
h AS (SELECT doc_id AS chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM documents),
o AS (SELECT query_id, chunk_id, round(count(*) / any_value(n), 6) AS score FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM a) JOIN h USING (term) GROUP BY ALL),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o QUALIFY rank <= {POOL}),
u AS (SELECT query_id, chunk_id, 0.7::DOUBLE / ({retrieval.RRF_K} + rank) AS part FROM k UNION ALL SELECT query_id, chunk_id, 0.3::DOUBLE / ({retrieval.RRF_K} + rank) FROM r),
s AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score FROM u GROUP BY ALL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= {base.TOP}""",
        "cosine_evaluation": f"""
WITH k AS ({known["cosine_top"]}), f AS (SELECT query_id, min(CASE WHEN a.label = b.label AND query_id <> chunk_id THEN rank END) AS best
  FROM k JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id GROUP BY 1)
SELECT count(*) AS n_queries, {", ".join(f"round(avg(CASE WHEN best <= {n} THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_{n}" for n in (1, 3, 5))}, round(avg(coalesce(1 / best, 0)), 4) AS mrr FROM f""",
        "party_comparison": f"""
WITH g AS (SELECT DISTINCT source, target[7:] AS party_key FROM ({known["graph_edges"]}) WHERE relationship = 'HAS_PARTY'),
f AS (SELECT party_key, x.* FROM g JOIN ({known["contract_facts"]}) x ON g.source = 'contract_' || x.document_id), v AS ({attributes})
SELECT party_key, attribute, count(*) AS n_contracts, count(DISTINCT value) AS n_values, count(DISTINCT value) > 1 AS differs FROM v GROUP BY ALL""",
        "graph_nodes": nodes,
        "graph_check": f"""
WITH e AS ({known["graph_edges"]}), n AS (SELECT DISTINCT node_id FROM ({nodes}))
SELECT relationship, count(*) AS n_edges, count(*) FILTER (WHERE a.node_id IS NULL OR b.node_id IS NULL) AS n_orphans, count(*) FILTER (WHERE source = target) AS n_loops
FROM e LEFT JOIN n a ON a.node_id = source LEFT JOIN n b ON b.node_id = target GROUP BY 1""",
        "streamed_blocks": known["document_blocks"],
        "streamed_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n_events, max(value) AS max_value FROM events GROUP BY ALL",
    }
