"""Registered queries of intake, registry, clauses and answers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import answers, clauses, facts, ingest, intake, lifecycle, obligations, portfolio, registry, retrieval, roles
from ..sources import contracts
from ..sources.shared import stored
from . import more
from . import queries as base

MODEL, VERSION = "terms", "1"
PARTY, DAYS = "customer#00000001", "60"
POOL = 20

#: Valid in Spark and in DuckDB: a clause for each order.
CLAUSES_SQL = """
SELECT o_orderkey AS document_id, 0 AS reading_order, 1 AS page_number, CASE o_orderkey % 4
  WHEN 0 THEN 'Supplier shall cure any breach within ' || CAST(5 + o_orderkey % 40 AS VARCHAR(9)) || ' days after receipt of notice.'
  WHEN 1 THEN 'Customer may terminate this Agreement without cause upon ' || CAST(1 + o_orderkey % 90 AS VARCHAR(9)) || ' days prior written notice.'
  WHEN 2 THEN 'Fees are set out in Schedule ' || CAST(o_orderkey % 12 AS VARCHAR(9)) || ' and in exhibit ' || substr('ABCDEFG', CAST(1 + o_orderkey % 7 AS INT), 1) || ', see Schedule 3.'
  ELSE 'Either party may leave upon notice.' END AS text
FROM {orders}
"""
#: Valid in both: an upload for each document.
UPLOADS_SQL = """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'notes.txt' WHEN 1 THEN '../up.pdf' WHEN 2 THEN NULL ELSE 'contract.PDF' END AS filename,
  CASE WHEN doc_id % 6 = 3 THEN 26214401 ELSE n_chars END AS n_bytes, CASE WHEN doc_id % 6 = 4 THEN 'plain' ELSE '%PDF-1.7' END AS head
FROM {documents}
"""
#: Valid in both: the opening of a contract between two parties for each order.
OPENINGS_SQL = """
SELECT o_orderkey AS document_id, CASE o_orderkey % 5 WHEN 0 THEN 'Supply Agreement' WHEN 1 THEN 'Master Services Agreement' WHEN 2 THEN 'Software License Agreement' ELSE 'Agreement' END AS contract_type,
  'Customer ' || CAST(o_custkey AS VARCHAR(20)) || ' Inc.' AS one, 'Works ' || CAST(o_orderkey AS VARCHAR(20)) || ' LLC' AS two,
  'Between Customer ' || CAST(o_custkey AS VARCHAR(20)) || ' Inc.' || CASE o_orderkey % 4 WHEN 0 THEN ' ("Customer")' WHEN 1 THEN '' WHEN 2 THEN ' acts as the lender' ELSE '' END
    || ' and Works ' || CAST(o_orderkey AS VARCHAR(20)) || ' LLC' || CASE o_orderkey % 3 WHEN 0 THEN ' (the "Vendor")' ELSE '' END || ' as agreed.' AS preamble,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Borrower means the company known as Works ' || CAST(o_orderkey AS VARCHAR(20)) || ' LLC.' END AS definitions
FROM {orders}
"""
#: Valid in both: an answer for each order.
ANSWERS_SQL = """
SELECT o_orderkey AS answer_id, CASE o_orderkey % 4 WHEN 0 THEN 'Invoices are due in ' || CAST(o_orderkey % 90 AS VARCHAR(9)) || ' days [E1]. The law is stated. It renews [E2][E1]!'
  WHEN 1 THEN 'The contracts do not say.' WHEN 2 THEN NULL ELSE 'Notice is due.[E3] It ends soon [E4]' END AS text
FROM {orders}
"""


def party_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = spark.sql(OPENINGS_SQL, orders=contracts.table(spark, sf_dir, "orders"))
    return roles.party_roles(opened.withColumns({"parties": F.array("one", "two"), "definitions": F.array("definitions")}))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLAUSES_SQL, orders=contracts.table(spark, sf_dir, "orders"))


def referenced_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.referenced_schedules(_clauses(spark, sf_dir))


def clause_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.clause_risks(_clauses(spark, sf_dir))


def upload_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = spark.sql(UPLOADS_SQL, documents=contracts.table(spark, sf_dir, "documents"))
    return uploads.select("doc_id", intake.reject_reason(F.col("filename"), F.col("n_bytes"), F.col("head")).alias("reject_reason"))


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.scans(contracts.contract_blocks(spark, sf_dir))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds the vectors of the labelled documents."""
    docs = contracts.table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), intake.vector_key(MODEL, VERSION, F.col("doc_id"), F.col("text")).alias("key"))
    cached = chunks.join(contracts.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    return intake.missing_vectors(chunks, cached)


def open_contract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of contracts, without those of finished orders."""
    gone = contracts.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    return intake.without_documents(contracts.contract_blocks(spark, sf_dir), gone).select("document_id", "reading_order", "page_number", "text")


def contract_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contracts.contract_blocks(spark, sf_dir)
    return registry.summaries(blocks, facts.extract_facts(blocks), obligations.extract_obligations(blocks))


def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contracts.contract_blocks(spark, sf_dir)
    found, held = stored(facts.extract_facts(blocks), "facts"), stored(obligations.extract_obligations(blocks), "obligations")  # each is read three times
    events = lifecycle.lifecycle_events(found, facts.expiration_dates(ingest.with_sections(blocks)), facts.amendment_facts(blocks), held)
    scores = portfolio.risk_scores(found, portfolio.risk_signals(found, held))
    return registry.totals(registry.summaries(blocks, found, held), events, scores)


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.fact_rows(base.contract_facts(spark, sf_dir))


def party_and_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of a party that also have a payment term: an intersection."""
    return registry.contracts_of(base.graph_edges(spark, sf_dir), PARTY).intersect(registry.contracts_with(fact_rows(spark, sf_dir), "payment_days", DAYS))


def obligation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.obligation_distribution(base.contract_obligations(spark, sf_dir))


def answer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four claims in a row make an answer."""
    claims = more.claim_status(spark, sf_dir)
    return answers.answer_reports(claims.select(F.floor(F.col("claim_id") / 4).cast("long").alias("answer_id"), "status"))


def _spans(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    chunks, asked = base._ranking_inputs(spark, sf_dir)
    pool = retrieval.bm25(chunks, asked, k).select("query_id", "chunk_id", F.col("rank").alias("position"))
    return asked, pool.join(chunks, "chunk_id").select("query_id", F.col("chunk_id").alias("span_id"), "position", "text")


def ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.rank_evidence(*_spans(spark, sf_dir, POOL))


def quoted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.extract_lines(*_spans(spark, sf_dir, base.TOP)).withColumn("line_md5", F.md5("line")).drop("line")


def inline_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.sql(ANSWERS_SQL, orders=contracts.table(spark, sf_dir, "orders"))
    found = said.select("answer_id", F.posexplode(answers.inline_claims(F.col("text"))).alias("n", "c"))
    return found.select("answer_id", "n", F.col("c.claim").alias("claim"), F.array_join("c.evidence_ids", ",").alias("evidence_ids"))


def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for citations: a supplier's questions cite pages of parts."""
    items = contracts.table(spark, sf_dir, "lineitem")
    return answers.bundle(items.select(
        F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.lit(0).alias("reading_order"),
        F.col("l_orderkey").alias("source"), F.col("l_orderkey").alias("rank"),
    ))


def retrieval_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, other = more._pools(spark, sf_dir)  # deeper than what is compared
    return answers.difficulty(lexical, other, more._fused(lexical, other))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        referenced_schedules, clause_risks, upload_decisions, scanned_documents, missing_vectors, open_contract_blocks, contract_summaries, portfolio_totals, fact_rows,
        party_and_term, obligation_distribution, answer_reports, ranked_evidence, retrieval_difficulty, party_roles, quoted_answers, inline_claims, evidence_bundles,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    known = base.oracle_sql() | more.oracle_sql()
    q = lambda x: "'" + x.replace("'", "''") + "'"
    ci = lambda x: q("(?i)" + x)
    made = CLAUSES_SQL.format(orders="orders")
    modal = f"regexp_extract(text, {ci(P.MODALS)}, 1)"
    summary = f"""
WITH b AS (SELECT document_id, max(page_number)::BIGINT AS n_pages FROM ({known["contract_blocks"]}) GROUP BY 1), f AS ({known["contract_facts"]}),
o AS (SELECT document_id, count(*) AS n FROM ({known["contract_obligations"]}) GROUP BY 1)
SELECT b.document_id, coalesce(contract_type, 'Agreement') AS contract_type, coalesce(governing_law, 'Unspecified') AS governing_law,
  coalesce('Net ' || payment_days, 'Standard / Unspecified') AS payment_term, n_pages, coalesce(n, 0)::BIGINT AS n_obligations
FROM b LEFT JOIN f USING (document_id) LEFT JOIN o USING (document_id)"""
    rows = " UNION ALL ".join(f"SELECT 'contract_' || document_id AS subject_id, '{p}' AS predicate, {p}::VARCHAR AS value FROM f WHERE {p} IS NOT NULL" for p in registry.PREDICATES)
    as_facts = f"WITH f AS ({known['contract_facts']}) {rows}"
    each = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s.lower()}" for s in answers.PRECEDENCE)
    overall = "CASE " + " ".join(f"WHEN n_{s.lower()} > 0 THEN '{s}'" for s in answers.PRECEDENCE) + " ELSE 'INSUFFICIENT_EVIDENCE' END"
    stop = ", ".join(q(w) for w in answers.QUESTION_WORDS)
    ranked = known["bm25_top"].replace(f"rank <= {base.TOP}", f"rank <= {POOL}")
    mark = lambda text, n: f"replace(lower({text}), lower({n}), chr(1))"
    role = lambda text, p: "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p.replace('WORDS', '|'.join(words)))}) THEN '{r}'" for r, words in roles.ROLE_WORDS.items()) + " END"
    stated = lambda n: f"coalesce({role(mark('preamble', n), roles.STATED)}, {role(mark('definitions', n), roles.DEFINED)})"
    implied = lambda k: "CASE WHEN s1 IS NULL AND s2 IS NULL THEN CASE " + " ".join(f"WHEN contains(lower(contract_type), '{a[0]}') THEN '{a[k]}'" for a in roles.ARCHETYPES) + " END END"
    acting = lambda n: role(mark("preamble", n), roles.ACTING)
    return {
        "party_roles": f"""
WITH s AS (SELECT *, {stated("one")} AS s1, {stated("two")} AS s2 FROM ({OPENINGS_SQL.format(orders="orders")}))
SELECT document_id, 0::INT AS ord, one AS name, coalesce(s1, {implied(1)}, {acting("one")}) AS role FROM s
UNION ALL SELECT document_id, 1::INT, two, coalesce(s2, {implied(2)}, {acting("two")}) FROM s""",
        "referenced_schedules": f"""
WITH r AS (SELECT document_id, unnest(regexp_extract_all(text, {ci(clauses.REFERENCE)}, 1)) AS r FROM ({made})),
d AS (SELECT DISTINCT document_id, upper(r[1]) || lower(string_split(r, ' ')[1][2:]) || ' ' || string_split(r, ' ')[2] AS reference FROM r)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY reference)::INT AS n, reference FROM d QUALIFY n <= {clauses.MOST_REFERENCES}""",
        "clause_risks": f"""
WITH m AS (SELECT *, {modal} AS modal FROM ({made})), a AS (SELECT *, array_to_string(regexp_split_to_array(trim(substr(text, instr(text, modal) + length(modal))), '\\s+')[1:6], ' ') AS does FROM m WHERE modal <> '')
SELECT DISTINCT document_id, 'SHORT_CURE_PERIOD' AS risk_type, 'HIGH' AS severity FROM a
WHERE contains(lower(does), 'cure') AND regexp_matches(lower(regexp_extract(text, {ci(P.OFFSET)}, 0)), {q(clauses.SHORT_CURE)})
UNION ALL SELECT DISTINCT document_id, 'ASYMMETRIC_TERMINATION', 'MEDIUM' FROM ({made}) WHERE contains(lower(text), 'terminat') AND regexp_matches(lower(text), 'immediate|without cause')""",
        "upload_decisions": f"""
SELECT doc_id, CASE WHEN filename IS NULL OR NOT lower(filename) LIKE '%.pdf' THEN 'not_a_pdf_name' WHEN contains(filename, '..') OR contains(filename, '/') THEN 'path_in_name'
  WHEN n_bytes IS NULL OR n_bytes > {intake.LARGEST_BYTES} THEN 'too_large' WHEN head IS NULL OR NOT starts_with(head, '{intake.MAGIC}') THEN 'not_a_pdf' END AS reject_reason
FROM ({UPLOADS_SQL.format(documents="documents")})""",
        "scanned_documents": f"""
SELECT document_id, round(sum(length(text)) / max(page_number), 2) AS chars_per_page, sum(length(text)) / max(page_number) < {intake.LEAST_CHARS_A_PAGE} AS needs_ocr
FROM ({known["contract_blocks"]}) GROUP BY 1""",
        "missing_vectors": f"""
WITH c AS (SELECT doc_id AS chunk_id, sha256('{MODEL}|{VERSION}|' || doc_id || '|' || coalesce(text, '')) AS key FROM documents)
SELECT chunk_id, key FROM c WHERE key NOT IN (SELECT key FROM c WHERE chunk_id IN (SELECT doc_id FROM labels))""",
        "open_contract_blocks": f"SELECT document_id, reading_order, page_number, text FROM ({known['contract_blocks']}) WHERE document_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
        "contract_summaries": summary,
        "portfolio_totals": f"""
WITH s AS ({summary}), r AS ({known["risk_scores"]}), e AS ({known["lifecycle_events"]})
SELECT 'contracts' AS metric, count(*)::BIGINT AS value FROM s UNION ALL SELECT 'pages', sum(n_pages)::BIGINT FROM s UNION ALL SELECT 'obligations', sum(n_obligations)::BIGINT FROM s
UNION ALL SELECT 'signals', sum(n_signals)::BIGINT FROM r UNION ALL SELECT 'high_risk', count(*) FILTER (WHERE risk_score >= {registry.HIGH_SCORE})::BIGINT FROM r UNION ALL SELECT 'events', count(*)::BIGINT FROM e""",
        "fact_rows": as_facts,
        "party_and_term": f"""
SELECT DISTINCT source AS subject_id FROM ({known["graph_edges"]}) WHERE relationship = 'HAS_PARTY' AND contains(target, '{PARTY}')
  AND source IN (SELECT subject_id FROM ({as_facts}) WHERE predicate = 'payment_days' AND value = '{DAYS}')""",
        "obligation_distribution": f"SELECT actor, temporal_type, count(*) AS n_obligations, count(DISTINCT document_id) AS n_documents FROM ({known['contract_obligations']}) GROUP BY ALL",
        "answer_reports": f"""
WITH a AS (SELECT claim_id // 4 AS answer_id, count(*) AS n_claims, {each} FROM ({known["claim_status"]}) GROUP BY 1)
SELECT *, round(n_supported / n_claims, 4) AS support_rate, {overall} AS overall_status, n_supported = n_claims AS fully_grounded FROM a""",
        "ranked_evidence": f"""
WITH k AS ({ranked}), w AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), lambda t: regexp_full_match(t, '[a-z]{{3,}}') AND t NOT IN ({stop})) AS words FROM benchmark),
h AS (SELECT k.query_id, chunk_id AS span_id, rank, len(list_filter(words, lambda t: contains(lower(d.text), t))) AS hits FROM k JOIN w USING (query_id) JOIN documents d ON d.doc_id = chunk_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, rank, span_id) AS n FROM h)
SELECT query_id, span_id, hits::BIGINT AS hits, 'E' || n AS evidence_id FROM n WHERE n <= {answers.MOST_EVIDENCE}""",
        "quoted_answers": f"""
WITH k AS ({known["bm25_top"]}), w AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), lambda t: regexp_full_match(t, '[a-z]{{3,}}') AND t NOT IN ({stop})) AS words FROM benchmark),
l AS (SELECT query_id, chunk_id AS span_id, rank, unnest(range(len(string_split(text, chr(10)))))::INT AS line_number, trim(unnest(string_split(text, chr(10)))) AS line FROM k JOIN documents d ON d.doc_id = chunk_id),
h AS (SELECT l.*, len(list_filter(words, lambda t: contains(lower(line), t)))::BIGINT AS hits FROM l JOIN w USING (query_id) WHERE length(line) > {answers.SHORTEST_LINE})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, rank, line_number, span_id)::INT AS n, span_id, line_number, hits, md5(line) AS line_md5 FROM h WHERE hits > 0 QUALIFY n <= {answers.MOST_LINES}""",
        "inline_claims": f"""
WITH a AS (SELECT answer_id, list_filter(string_split(regexp_replace(text, '([.!?](\\[E[0-9]+\\])*)\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: regexp_matches(x, '\\[E[0-9]+\\]')) AS s FROM ({ANSWERS_SQL.format(orders="orders")})),
u AS (SELECT answer_id, unnest(range(len(s)))::INT AS n, unnest(s) AS x FROM a)
SELECT answer_id, n, trim(regexp_replace(x, '\\s*\\[E[0-9]+\\]', '', 'g')) AS claim, CASE WHEN contains(x, '[E2][E1]') THEN 'E2,E1' ELSE regexp_extract(x, '\\[(E[0-9]+)\\]', 1) END AS evidence_ids FROM u""",
        "evidence_bundles": """
SELECT l_suppkey AS query_id, l_partkey AS document_id, l_linenumber AS page_number, 0 AS reading_order, min(l_orderkey) AS first_rank, count(DISTINCT l_orderkey) AS n_sources,
  array_to_string(list_sort(list_distinct(list(l_orderkey))), ',') AS sources FROM lineitem GROUP BY ALL""",
        "retrieval_difficulty": f"""
WITH k AS ({known["bm25_top"]}), f AS ({known["fused_top"]}), a AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM benchmark),
h AS (SELECT doc_id AS chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM documents),
o AS (SELECT query_id, chunk_id, round(count(*) / any_value(n), 6) AS score FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM a) JOIN h USING (term) GROUP BY ALL),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o QUALIFY rank <= {answers.DEPTH}),
u AS (SELECT query_id, chunk_id, count(*) AS n FROM (SELECT query_id, chunk_id FROM k UNION ALL SELECT query_id, chunk_id FROM r) GROUP BY ALL),
g AS (SELECT query_id, count(*) FILTER (WHERE n = 2) / count(*) AS agreement FROM u GROUP BY 1),
m AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) - coalesce(max(score) FILTER (WHERE rank = 2), 0) AS margin FROM f GROUP BY 1)
SELECT query_id, round(margin, 9) AS margin, round(agreement, 6) AS agreement, CASE WHEN margin < {answers.NARROW_MARGIN} OR agreement < {answers.LOW_AGREEMENT} THEN 'HIGH' ELSE 'LOW' END AS level
FROM m JOIN g USING (query_id)""",
    }
