"""The registered queries over whole tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import facts, ingest, obligations, portfolio, retrieval
from ..sources import contracts

TOP = 5  # a ranking is a top-k report


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.contract_blocks(spark, sf_dir)


def contract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.document_blocks(contracts.table(spark, sf_dir, "documents"))


def typed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_sections(_blocks(spark, sf_dir)).select("document_id", "reading_order", "block_type", "section_number")


def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.section_rollup(ingest.with_sections(_blocks(spark, sf_dir)))


def contract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.extract_facts(_blocks(spark, sf_dir))


def contract_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obligations.extract_obligations(_blocks(spark, sf_dir))


def governing_law_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.histogram(facts.extract_facts(_blocks(spark, sf_dir)), "governing_law", "Unspecified")


def payment_term_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.histogram(facts.extract_facts(_blocks(spark, sf_dir)), "payment_days", "Standard / Unspecified")


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    found = facts.extract_facts(blocks)
    return portfolio.risk_scores(found, portfolio.risk_signals(found, obligations.extract_obligations(blocks)))


def counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.counterparties(portfolio.parties(_blocks(spark, sf_dir)))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return portfolio.graph_edges(portfolio.parties(blocks), facts.extract_facts(blocks))


def _ranking_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = contracts.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return docs, contracts.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(*_ranking_inputs(spark, sf_dir), TOP)


def cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = contracts.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    return retrieval.cosine(vectors, vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), TOP)


def event_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines: an offset in days by event type from each event's day; counts by day and type."""
    events = contracts.table(spark, sf_dir, "events")
    anchor, offset = F.date_format("ts", "yyyy-MM-dd"), F.length("event_type")
    due = obligations.deadline(anchor, offset, F.lit(None).cast("int"))
    return events.groupBy("event_type", due.cast("string").alias("due")).agg(F.count(F.lit(1)).alias("n_events"))


def _all() -> tuple[Callable[[SparkSession, str], DataFrame], ...]:
    return (
        contract_blocks, document_blocks, typed_sections, section_rollup, contract_facts, contract_obligations, governing_law_histogram,
        payment_term_histogram, risk_scores, counterparties, graph_edges, bm25_top, cosine_top, event_milestones,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _all()}


def oracle_sql() -> dict[str, str]:
    blocks = contracts.CONTRACT_BLOCKS_SQL.format(blocks="(SELECT *, unnest(range(8))::INT AS reading_order FROM orders)", customer="customer")
    q = lambda x: "'" + x.replace("'", "''") + "'"
    ci = lambda x: q("(?i)" + x)
    words = "CASE lower({w}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.NUMBER_WORDS.items()) + " END"
    days = lambda p: (
        f"coalesce(try_cast(nullif(regexp_extract(text, {ci(p)}, 4), '') AS INT), try_cast(regexp_extract(text, {ci(p)}, 2) AS INT), "
        + words.format(w=f"regexp_extract(text, {ci(p)}, 2)") + ")"
    )
    any_of = lambda xs: "(" + " OR ".join(f"contains(lower(text), {q(x)})" for x in xs) + ")"
    date = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {ci(d)}, 0), '')" for d in P.DATES) + ")"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(text, {ci(p)}) THEN {k}" for k, (_, p) in enumerate(P.CONTRACT_TYPES, 1)) + " END"
    kinds = "[" + ", ".join(q(n) for n, _ in P.CONTRACT_TYPES) + "]"
    first = lambda x: f"(list({x} ORDER BY page_number, reading_order) FILTER (WHERE {x} IS NOT NULL))[1]"
    facts_sql = f"""
WITH b AS ({blocks}), f AS (SELECT *, CASE WHEN page_number = 1 AND reading_order < 6 THEN {kind} END AS kind,
  CASE WHEN page_number <= 2 AND regexp_matches(text, {ci(P.EFFECTIVE_CUE)}) THEN {date} END AS effective_date,
  CASE WHEN {any_of(P.RENEWAL_CUES)} THEN text[1:120] END AS renewal, CASE WHEN {any_of(P.PAYMENT_CUES)} THEN {days(P.PAYMENT_DAYS)} END AS payment_days,
  CASE WHEN contains(lower(text), 'terminat') THEN {days(P.NOTICE_DAYS)} END AS notice_days,
  nullif(trim(regexp_extract(text, {ci(P.GOVERNING_LAW)}, 2)), '') AS governing_law FROM b)
SELECT document_id, {kinds}[min(kind)] AS contract_type, {", ".join(f"{first(x)} AS {x}" for x in ("effective_date", "renewal", "payment_days", "notice_days"))},
  (list(governing_law ORDER BY page_number DESC, reading_order DESC) FILTER (WHERE governing_law IS NOT NULL))[1] AS governing_law FROM f GROUP BY document_id"""
    typed = f"""
WITH b AS ({blocks}), t AS (SELECT *, CASE WHEN length(text) < 120 AND regexp_matches(text, {ci(P.HEADING_EXHIBIT)}) THEN 'exhibit_marker'
    WHEN length(text) < 300 AND regexp_matches(text, {ci(P.SIGNATURE)}) THEN 'signature_block'
    WHEN length(text) <= 150 AND (regexp_matches(text, {ci(P.HEADING_SECTION)}) OR regexp_matches(text, {q(P.HEADING_NUMBER)}) OR regexp_matches(text, {ci(P.HEADING_KEYWORD)})) THEN 'heading'
    WHEN regexp_matches(text, {ci(P.LIST_ITEM)}) THEN 'list_item' ELSE 'paragraph' END AS block_type,
    CASE WHEN length(text) <= 150 THEN coalesce(nullif(rtrim(regexp_extract(text, {ci(P.HEADING_SECTION)}, 2), '.'), ''), nullif(regexp_extract(text, {q(P.HEADING_NUMBER)}, 1), '')) END AS own FROM b),
s AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, reading_order) AS section_number FROM t)"""
    offset = lambda k: f"regexp_extract({{x}}, {ci(P.OFFSET)}, {k})"
    number = f"coalesce(try_cast(nullif({offset(4)}, '') AS INT), try_cast({offset(2)} AS INT), " + words.format(w=offset(2)) + ")"
    low = f"lower({offset(8)})"
    has = lambda *ws: "(" + " OR ".join(f"contains({low}, '{w}')" for w in ws) + ")"
    anchor = (
        f"CASE WHEN {has('invoice', 'receipt', 'billing')} THEN 'invoice_received' WHEN {has('breach', 'default')} THEN 'breach_discovered' "
        f"WHEN {has('effective date', 'commencement')} THEN 'effective_date' WHEN {has('expiration', 'end of the term')} THEN 'expiration_date' "
        f"WHEN {has('notice')} THEN 'notice_received' WHEN {has('termination')} THEN 'termination_notice' WHEN {has('delivery', 'shipment')} THEN 'delivery_date' "
        f"WHEN {has('audit')} THEN 'audit_requested' ELSE regexp_replace(regexp_replace({low}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[1:40] END"
    )
    recurring = f"(regexp_matches(lower({{x}}), {q(P.RECURRING)}) AND regexp_matches(lower({{x}}), {q(P.RECURRING_NOUNS)}))"
    cases = lambda a, b, c, d, e: f"CASE WHEN {recurring} THEN {a} WHEN regexp_matches(lower({{x}}), {q(P.ONGOING)}) THEN {b} WHEN regexp_matches(lower({{x}}), {q(P.FIXED_DATE)}) THEN {c} WHEN regexp_matches({{x}}, {ci(P.OFFSET)}) THEN {d} WHEN regexp_matches(lower({{x}}), {q(P.NET)}) THEN {e}"
    quoted = lambda template, x: template.replace("{x}", x)
    relative = "breach|default|termination|change|notice|audit|request|discover|occurrence"
    kind_t = cases("'recurring'", "'ongoing'", "'fixed_date'", f"CASE WHEN regexp_matches({anchor}, '{relative}') THEN 'event_relative' ELSE 'relative_offset' END", "'relative_offset'") + " ELSE 'unspecified' END"
    days_t = cases("NULL", "NULL", "NULL", f"CASE lower({offset(6)}) WHEN 'days' THEN {number} WHEN 'months' THEN {number} * 30 END", f"try_cast(regexp_extract(lower({{x}}), {q(P.NET)}, 1) AS INT)") + " END"
    anchor_t = cases("NULL", "'contract_term'", "NULL", anchor, "'invoice_date'") + " END"
    month = "list_position([" + ", ".join(q(m) for m in P.MONTHS) + f"], regexp_extract(lower({{x}}), {q(P.FIXED_DATE)}, 1))"
    date_t = cases("NULL", "NULL", f"printf('%04d-%02d-%02d', regexp_extract(lower({{x}}), {q(P.FIXED_DATE)}, 3)::INT, {month}::INT, regexp_extract(lower({{x}}), {q(P.FIXED_DATE)}, 2)::INT)", "NULL", "NULL") + " END"
    before = "lower(string_split(sentence, modal)[1])"
    role = "CASE " + " ".join(f"WHEN contains({before}, {q(r)}) THEN {q(r.title())}" for r in P.ROLES) + " WHEN contains(lower(sentence), 'each party') OR contains(lower(sentence), 'the parties shall') THEN 'The Parties' ELSE 'unresolved' END"
    after = "trim(substr(sentence, instr(sentence, modal) + length(modal)))"
    action = f"modal || ' ' || regexp_replace(array_to_string(regexp_split_to_array({after}, '\\s+')[1:6], ' '), '^[,;.]+|[,;.]+$', '', 'g')"
    rest = f"regexp_extract(sentence, {ci(P.CONDITION)}, 3)"
    # the rendered blocks have one sentence each, or two parts at a semicolon
    obligations_sql = f"""
WITH b AS ({blocks}), p AS (SELECT *, CASE WHEN contains(text, ';') THEN list_transform(string_split(text, ';'), lambda x: trim(x)) ELSE [text] END AS parts FROM b WHERE regexp_matches(text, {ci(P.MODALS)})),
u AS (SELECT document_id, reading_order, unnest(range(len(parts)))::INT AS unit, unnest(parts) AS sentence FROM p),
m AS (SELECT *, regexp_extract(sentence, {ci(P.MODALS)}, 1) AS modal FROM u),
c AS (SELECT *, {rest} <> '' AND regexp_matches(lower(sentence), 'shall|must|agrees to|within') AS conditional, {rest} AS rest FROM m WHERE modal <> '')
SELECT document_id, reading_order, unit, {role} AS actor, {action} AS action, CASE WHEN conditional THEN 'conditional' ELSE {quoted(kind_t, 'sentence')} END AS temporal_type,
  CASE WHEN conditional THEN {quoted(days_t, 'rest')} ELSE {quoted(days_t, 'sentence')} END AS offset_days,
  CASE WHEN conditional THEN 'condition_' || regexp_extract(sentence, {ci(P.CONDITION)}, 2)[1:30] ELSE {quoted(anchor_t, 'sentence')} END AS anchor_event,
  CASE WHEN NOT conditional THEN {quoted(date_t, 'sentence')} END AS calculated_date FROM c"""
    key = f"regexp_replace(trim(regexp_replace(lower(regexp_replace(name, '[,.\"'']', '', 'g')), {q(P.COMPANY_WORDS)}, '', 'g')), '\\s+', '_', 'g')"
    parties_sql = f"SELECT document_id, name, {key} AS party_key FROM (SELECT document_id, regexp_extract(text, 'between\\s+(.{{1,80}}?\\s+(Inc|LLC|Ltd|Corp)\\.?)\\s', 1) AS name FROM ({blocks}) WHERE page_number <= 2) WHERE name <> ''"
    return {
        "contract_blocks": blocks,
        "document_blocks": """
WITH l AS (SELECT doc_id AS document_id, unnest(range(len(string_split(text, chr(10)))))::INT AS reading_order, unnest(string_split(text, chr(10))) AS raw FROM documents),
n AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM l)
SELECT document_id, reading_order, document_id || '_p001_b' || CASE WHEN reading_order < 9 THEN '0' ELSE '' END || (reading_order + 1) AS block_id, text FROM n WHERE text <> ''""",
        "typed_sections": typed + " SELECT document_id, reading_order, block_type, section_number FROM s",
        "section_rollup": typed + " SELECT document_id, section_number, min(page_number) AS start_page, max(page_number) AS end_page, count(*) AS n_blocks FROM s WHERE section_number IS NOT NULL GROUP BY ALL",
        "contract_facts": facts_sql,
        "contract_obligations": obligations_sql,
        "governing_law_histogram": f"SELECT coalesce(governing_law, 'Unspecified') AS governing_law, count(*) AS n_contracts FROM ({facts_sql}) GROUP BY 1",
        "payment_term_histogram": f"SELECT coalesce(payment_days::VARCHAR, 'Standard / Unspecified') AS payment_days, count(*) AS n_contracts FROM ({facts_sql}) GROUP BY 1",
        "risk_scores": f"""
WITH f AS ({facts_sql}), o AS ({obligations_sql}), s AS (
  SELECT document_id, CASE WHEN regexp_matches(lower(renewal), '60 days|90 days|120 days') THEN 45 ELSE 25 END AS w FROM f WHERE regexp_matches(lower(renewal), 'automatic|successive')
  UNION ALL SELECT document_id, 45 FROM f WHERE payment_days::VARCHAR LIKE '15%'
  UNION ALL SELECT DISTINCT document_id, 25 FROM o WHERE contains(lower(action), 'late') AND regexp_matches(lower(action), '1\\.5%|interest'))
SELECT f.document_id, count(s.w) AS n_signals, least(100, coalesce(sum(s.w), 0))::BIGINT AS risk_score FROM f LEFT JOIN s USING (document_id) GROUP BY 1""",
        "counterparties": f"SELECT party_key, count(DISTINCT document_id) AS n_contracts, min(document_id) AS first_document FROM ({parties_sql}) GROUP BY 1",
        "graph_edges": f"""
WITH p AS ({parties_sql}), f AS ({facts_sql})
SELECT 'contract_' || document_id AS source, 'HAS_PARTY' AS relationship, 'party_' || party_key AS target FROM p
UNION ALL SELECT 'party_' || party_key, 'COUNTERPARTY_TO', 'contract_' || document_id FROM p
UNION ALL SELECT 'contract_' || document_id, 'GOVERNED_BY', 'jurisdiction_' || replace(lower(governing_law), ' ', '_') FROM f WHERE governing_law IS NOT NULL""",
        "bm25_top": f"""
WITH c AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
a AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {retrieval.K1 + 1} / (tf + {retrieval.K1} * ({1 - retrieval.B} + {retrieval.B} * dl / avgdl)) * times), 6) AS score
  FROM a JOIN p USING (term) JOIN d USING (term), n GROUP BY ALL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= {TOP}""",
        "cosine_top": f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= {TOP}""",
        "event_milestones": "SELECT event_type, (ts::DATE + length(event_type)::INT)::VARCHAR AS due, count(*) AS n_events FROM events GROUP BY ALL",
    }
