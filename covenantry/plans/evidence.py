"""Registered queries of retrieval by question, evidence, prompts, answers and metrics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import citing, measuring, retrieval
from ..sources import contracts
from ..sources.shared import stored
from . import more
from . import queries as base

PAGE_LINES = 20
#: Valid in Spark and in DuckDB: intents of the benchmark's items, taken as questions.
ASKED_SQL = "SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'payment' WHEN 1 THEN 'amendment' ELSE 'information' END AS intent, text AS expanded FROM {benchmark}"
#: Valid in both: the documents that every second question is bound to.
BOUND_SQL = "SELECT item_id AS query_id, doc_id AS document_id FROM {benchmark} JOIN {documents} ON item_id % 2 = 0 AND doc_id % 20 = item_id % 20"
#: Valid in both: replies of a model for some orders.
REPLIES_SQL = """
SELECT o_orderkey AS answer_id, CASE o_orderkey % 6 WHEN 0 THEN '{{"answer": "Paid within 30 days [E1].", "claims": [{{"text": " Net 30. ", "evidence_ids": ["[e1]", "E2"]}}, {{"text": "", "evidence_ids": []}}]}}'
  WHEN 1 THEN '```json' || chr(10) || '{{"answer": "It renews [E2]. It ends [E3][E2]. No more.", "claims": []}}' || chr(10) || '```' WHEN 2 THEN '{{"answer": "Broken [E4]. Rest is cut'
  WHEN 3 THEN 'Plain words [E1] only. And more.' WHEN 4 THEN '{{"answer": "No claims at all."}}' ELSE NULL END AS reply FROM {orders} WHERE o_orderkey % 7 = 0
"""
#: Valid in both: what questions need: a document, a page, and words.
REQUIRED_SQL = """
SELECT item_id AS query_id, 0 AS requirement_id, item_id % 40 AS document_id, substr(text, 1, 12) AS one, 'e' AS two, 1 AS page FROM {benchmark} WHERE item_id % 5 <> 0
UNION ALL SELECT item_id, 1, doc_id, substr(x.text, 1, 10), 'a', 1 FROM {benchmark} JOIN {documents} x ON doc_id = item_id * 3
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", F.concat_ws(" ", "lang", "source", F.substring("text", 1, 20)).alias("title"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ASKED_SQL, benchmark=contracts.table(spark, sf_dir, "benchmark"))


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOUND_SQL, benchmark=contracts.table(spark, sf_dir, "benchmark"), documents=contracts.table(spark, sf_dir, "documents").select("doc_id"))


def titled_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).select("query_id", F.col("expanded").alias("text"))
    return retrieval.ranked(retrieval.scores(_chunks(spark, sf_dir), asked).filter("score > 0"), base.TOP)


def bound_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = _asked(spark, sf_dir).select("query_id", F.col("expanded").alias("text")), _chunks(spark, sf_dir)
    return retrieval.bound_bm25(chunks, asked, _bound(spark, sf_dir), base.TOP)


def adaptive_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.adaptive(_asked(spark, sf_dir), _chunks(spark, sf_dir), _bound(spark, sf_dir), base.TOP)


def _blocks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Lines of documents (those ``of`` a table of document_id, if it is given), with pages of 20 lines and boxes; every thirteenth box is broken."""
    at = F.col("reading_order") % PAGE_LINES
    x1 = F.when((F.col("document_id") + F.col("reading_order")) % 13 == 0, 10.0).otherwise(500.0)
    box = F.struct(F.lit(50.0).alias("x0"), (at * 30.0).alias("y0"), x1.alias("x1"), (at * 30.0 + 20).alias("y1"))
    docs = contracts.table(spark, sf_dir, "documents")
    lines = contracts.document_blocks(docs if of is None else docs.join(of.withColumnRenamed("document_id", "doc_id"), "doc_id", "left_semi"))
    return lines.select("document_id", "block_id", "reading_order", (F.floor(F.col("reading_order") / PAGE_LINES) + 1).cast("int").alias("page_number"), "text", box.alias("box"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a chunk of its first three lines; some name a line that is not there, or none."""
    docs = contracts.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_start"), F.substring("text", 1, 50).alias("text"))
    name = lambda n: F.concat(F.col("document_id").cast("string"), F.lit(f"_p001_b{n}"))
    ids = F.when(F.col("document_id") % 10 == 3, F.array().cast("array<string>")).when(F.col("document_id") % 10 == 4, F.array(name("01"), name("xx"))).otherwise(F.array(name("01"), name("02"), name("03")))
    return docs.select("chunk_id", "document_id", "page_start", "text", ids.alias("block_ids"), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("boxes"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    pages = blocks.filter("document_id % 10 != 5").select("document_id", "page_number").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return citing.resolve_chunks(_references(spark, sf_dir), blocks, pages)


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.bm25_top(spark, sf_dir).select("query_id", "chunk_id", "rank")


def resolved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = citing.evidence_spans(_retrieved(spark, sf_dir), _resolved(spark, sf_dir))
    return found.withColumn("citation", citing.citation(F.col("document_id").cast("string"), F.col("page_number"), F.when(F.col("document_id") % 2 == 0, F.lit("4.2"))))


def chunk_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citing.bundles(_retrieved(spark, sf_dir), _resolved(spark, sf_dir))


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best documents' openings as evidence; a digest of each prompt."""
    top = _retrieved(spark, sf_dir).filter("rank <= 2 AND query_id % 3 != 0").join(_chunks(spark, sf_dir), "chunk_id")
    spans = top.select("query_id", F.col("rank").alias("n"), F.concat(F.lit("Document: "), F.col("chunk_id").cast("string")).alias("header"), F.substring("text", 1, 200).alias("text"))
    made = citing.prompts(contracts.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), spans)
    return made.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = spark.sql(REPLIES_SQL, orders=contracts.table(spark, sf_dir, "orders"))
    rows = replies.select("answer_id", citing.parsed_answer(F.col("reply")).alias("p")).select("answer_id", "p.answer", F.posexplode_outer("p.claims").alias("n", "c"))
    return rows.select("answer_id", "answer", "n", F.col("c.text").alias("claim"), F.array_join("c.evidence_ids", ",").alias("evidence_ids"))


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four claims in a row make an answer; claims cite their block, and every third one that of its neighbour too."""
    claims = more.claim_status(spark, sf_dir).select(F.floor(F.col("claim_id") / 4).cast("long").alias("answer_id"), "claim_id", "status")
    said = more._claims(spark, sf_dir).filter("reading_order IS NOT NULL")
    own = said.select("claim_id", F.lit(0).alias("position"), F.floor(F.col("document_id") / 8).cast("long").alias("document_id"), "page_number", F.concat(F.lit("b"), F.col("reading_order").cast("string")).alias("block_id"))
    return citing.distinct_citations(claims, own.unionByName(own.filter("claim_id % 3 = 0").withColumns({"position": F.lit(1), "block_id": F.lit("b0")})))


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(REQUIRED_SQL, benchmark=contracts.table(spark, sf_dir, "benchmark"), documents=contracts.table(spark, sf_dir, "documents"))
    return rows.select("query_id", "requirement_id", "document_id", F.array("one", "two").alias("phrases"), F.array("page").alias("pages"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.bm25(*base._ranking_inputs(spark, sf_dir), 10)
    chunks = _chunks(spark, sf_dir).withColumns({"page_start": (F.col("document_id") % 3).cast("int"), "page_end": (F.col("document_id") % 3 + 1).cast("int")})
    questions = contracts.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), (F.col("item_id") % 5 != 0).alias("answerable"))
    ranked = stored(ranked.select("query_id", "chunk_id", "rank"), "ranked")
    return measuring.question_results(questions, measuring.requirement_ranks(ranked, chunks, _required(spark, sf_dir)), ranked)


def question_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measuring.retrieval_metrics(_results(spark, sf_dir))


def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = stored(_resolved(spark, sf_dir).select("chunk_id", "document_id", "block_id", "page_number", "status"), "resolved")
    spans = stored(citing.evidence_spans(_retrieved(spark, sf_dir), resolved), "spans")
    cited = F.broadcast(spans.select("document_id").distinct())  # some of each question; the texts of other documents are not split, nor shuffled
    blocks = _blocks(spark, sf_dir, cited).select("document_id", "block_id", "text")
    spans = spans.join(blocks, ["document_id", "block_id"])
    return measuring.evidence_metrics(spans, _required(spark, sf_dir), resolved)


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of answers, by the order's kind; every third question is unanswerable."""
    from . import service

    reports = service.answer_reports(spark, sf_dir).select("answer_id", "overall_status", "fully_grounded")
    return measuring.answer_metrics(reports.withColumns({"answerable": F.col("answer_id") % 3 != 0, "category": F.concat(F.lit("k"), (F.col("answer_id") % 4).cast("string"))}), "category")


def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = contracts.document_blocks(contracts.table(spark, sf_dir, "documents"))
    return measuring.containment(lines, _required(spark, sf_dir))


def slowest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measuring.nearest_rank(contracts.table(spark, sf_dir, "events"), "value", 0.95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        titled_top, bound_top, adaptive_top, resolved_chunks, evidence_spans, chunk_bundles, answer_prompts, parsed_answers, answer_citations, question_results, retrieval_metrics,
        evidence_metrics, answer_metrics, phrase_containment, slowest_events,
    )
    return {f.__name__: f for f in found}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    from . import service

    known = base.oracle_sql()
    words = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9_]+')"
    best = lambda scored, k=base.TOP: f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM ({scored}) QUALIFY rank <= {k}"
    bm25 = known["bm25_top"][: known["bm25_top"].rindex("SELECT query_id, chunk_id, score, row_number()")] + "SELECT query_id, chunk_id, score FROM s"
    title = "concat_ws(' ', lang, source, text[1:20])"
    titled = f"""
WITH k AS ({bm25}), a AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({words("text")}) AS term FROM benchmark) GROUP BY ALL),
h AS (SELECT doc_id AS chunk_id, unnest(list_distinct({words(title)})) AS term FROM documents), u AS (SELECT * FROM k UNION ALL SELECT query_id, chunk_id, sum(times) * {retrieval.TITLE_BOOST}::DOUBLE FROM a JOIN h USING (term) GROUP BY ALL)
SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM u GROUP BY ALL"""
    overlap = f"""
WITH a AS (SELECT item_id AS query_id, list_distinct({words("text")}) AS t FROM benchmark), h AS (SELECT doc_id AS chunk_id, unnest(list_distinct({words("text")})) AS term FROM documents)
SELECT query_id, chunk_id, round(count(*) / any_value(n), 6) AS score FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM a) JOIN h USING (term) GROUP BY ALL"""
    bound = BOUND_SQL.format(benchmark="benchmark", documents="documents")
    within = lambda scored: f"SELECT query_id, chunk_id, score FROM ({scored}) WHERE query_id NOT IN (SELECT query_id FROM ({bound})) OR (query_id, chunk_id) IN (SELECT (query_id, document_id) FROM ({bound}))"
    weight = lambda side: "CASE intent " + " ".join(f"WHEN {_q(k)} THEN {2 * w[side]}::DOUBLE" for k, w in retrieval.INTENT_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
    lines = f"""SELECT document_id, block_id, reading_order, (floor(reading_order / {PAGE_LINES}) + 1)::INT AS page_number, text, (reading_order % {PAGE_LINES}) * 30.0 AS y0, CASE WHEN (document_id + reading_order) % 13 = 0 THEN 10.0 ELSE 500.0 END AS x1 FROM ({known["document_blocks"]})"""
    resolved = f"""
WITH b AS ({lines}), pg AS (SELECT DISTINCT document_id, page_number FROM b WHERE document_id % 10 <> 5), kd AS (SELECT DISTINCT document_id FROM pg),
r AS (SELECT doc_id AS chunk_id, text[1:50] AS chunk_text, unnest(CASE WHEN doc_id % 10 = 3 THEN [NULL] WHEN doc_id % 10 = 4 THEN [doc_id || '_p001_b01', doc_id || '_p001_bxx'] ELSE [doc_id || '_p001_b01', doc_id || '_p001_b02', doc_id || '_p001_b03'] END) AS block_id,
  unnest(CASE WHEN doc_id % 10 = 3 THEN [0] WHEN doc_id % 10 = 4 THEN [0, 1] ELSE [0, 1, 2] END)::INT AS n FROM documents),
j AS (SELECT r.*, b.page_number AS block_page, coalesce(b.page_number, 1) AS page_number, b.text AS block_text, x1, y0, kd.document_id IS NOT NULL AS has_document FROM r LEFT JOIN b ON b.document_id = chunk_id AND b.block_id = r.block_id LEFT JOIN kd ON kd.document_id = chunk_id),
w AS (SELECT j.*, pg.page_number IS NULL AS no_page, block_page IS NOT NULL AND x1 < 50 AS bad FROM j LEFT JOIN pg ON pg.document_id = chunk_id AND pg.page_number = j.page_number)
SELECT chunk_id, n, chunk_id AS document_id, block_id, page_number, CASE WHEN block_id IS NULL THEN 'MISSING_PROVENANCE' WHEN NOT has_document THEN 'INVALID_DOCUMENT' WHEN bad THEN 'INVALID_BBOX' WHEN block_page IS NULL THEN 'INVALID_BLOCK' WHEN no_page THEN 'INVALID_PAGE' ELSE 'VALID' END AS status,
  CASE WHEN block_id IS NULL THEN 'no block' WHEN NOT has_document THEN 'no document' ELSE nullif(concat_ws('; ', CASE WHEN no_page THEN 'no page' END, CASE WHEN block_page IS NULL THEN 'no such block' END, CASE WHEN bad THEN 'x0 beyond x1' END), '') END AS reasons, coalesce(block_text, chunk_text) AS snippet FROM w"""
    spans = f"SELECT query_id, document_id, block_id, page_number, min(rank) AS first_rank, count(DISTINCT chunk_id) AS n_sources, string_agg(DISTINCT chunk_id::VARCHAR, ',' ORDER BY chunk_id::VARCHAR) AS sources FROM ({known['bm25_top']}) JOIN ({resolved}) USING (chunk_id) WHERE status = 'VALID' GROUP BY ALL"
    sanitised = lambda x: f"regexp_replace(regexp_replace(replace(trim({x}), chr(13) || chr(10), chr(10)), {_q('(?i)' + P.DIRECTIVES)}, '[NEUTRALIZED_DIRECTIVE: \\1]', 'g'), {_q(P.FENCE)}, '', 'g')"
    text = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    replies = REPLIES_SQL.format(orders="orders")
    required = REQUIRED_SQL.format(benchmark="benchmark", documents="documents")
    fold = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    top10 = best(bm25, 10)
    ranks = f"""
SELECT q.query_id, q.requirement_id, min(rank) AS rank, arg_min(CASE WHEN document_id IS NULL THEN NULL ELSE ps <= page AND page <= ps + 1 END, rank) AS on_page FROM ({required}) q LEFT JOIN (
  SELECT k.query_id, k.rank, doc_id, text, doc_id % 3 AS ps FROM ({top10}) k JOIN documents ON doc_id = chunk_id) c ON c.query_id = q.query_id AND c.doc_id = q.document_id AND contains({fold("text")}, {fold("one")}) AND contains({fold("text")}, {fold("two")}) GROUP BY 1, 2"""
    results = f"""
WITH r AS ({ranks}), h AS (SELECT query_id, min(rank) AS first_rank, bool_and(rank IS NOT NULL) AS all_met, bool_and(coalesce(on_page, true)) AS pages_right FROM r GROUP BY 1), t AS (SELECT DISTINCT query_id FROM ({top10})),
q AS (SELECT item_id AS query_id, 'c' || item_id % 3 AS category, item_id % 5 <> 0 AS answerable FROM benchmark)
SELECT q.query_id, category, answerable, CASE WHEN answerable THEN first_rank END AS first_rank, answerable AND coalesce(all_met, true) AS contained, answerable AND coalesce(all_met, true) AND coalesce(pages_right, true) AS provenance,
  CASE WHEN NOT answerable THEN 'unanswerable_query' WHEN first_rank <= 10 THEN NULL WHEN t.query_id IS NULL THEN 'empty_retrieval' ELSE 'semantic_lexical_mismatch' END AS failure FROM q LEFT JOIN h USING (query_id) LEFT JOIN t USING (query_id)"""
    rate = lambda c: f"round(coalesce(sum({c}) FILTER (WHERE answerable) / nullif(count(*) FILTER (WHERE answerable), 0), 0), 4)"
    hits = ", ".join(f"{rate(f'CASE WHEN first_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END')} AS hit_{k}" for k in (1, 3, 5, 10))
    share = lambda c, of: f"round(coalesce(count(*) FILTER (WHERE {c}) / nullif({of}, 0), 0), 4)"
    refused = "overall_status = 'INSUFFICIENT_EVIDENCE'"
    claims = more.CLAIMS_SQL.format(orders="orders")
    own = f"SELECT claim_id, 0 AS position, (document_id // 8) AS document_id, page_number, 'b' || reading_order AS block_id FROM ({claims}) WHERE reading_order IS NOT NULL"
    return {
        "titled_top": best(f"SELECT * FROM ({titled}) WHERE score > 0"),
        "bound_top": best(within(bm25)),
        "adaptive_top": f"""
WITH x AS ({best(within(f"SELECT * FROM ({titled}) WHERE score > 0"), 50)}), y AS ({best(within(overlap), 50)}), w AS (SELECT query_id, {weight(0)} AS w0, {weight(1)} AS w1 FROM ({ASKED_SQL.format(benchmark="benchmark")})),
u AS (SELECT query_id, chunk_id, w0 / ({retrieval.RRF_K} + rank) AS part FROM x JOIN w USING (query_id) UNION ALL SELECT query_id, chunk_id, w1 / ({retrieval.RRF_K} + rank) FROM y JOIN w USING (query_id)),
s AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score FROM u GROUP BY ALL) {best("SELECT * FROM s")}""",
        "resolved_chunks": resolved,
        "evidence_spans": f"SELECT *, document_id || ' (Page ' || page_number || CASE WHEN document_id % 2 = 0 THEN ', §4.2' ELSE '' END || ')' AS citation FROM ({spans})",
        "chunk_bundles": f"SELECT query_id, count(*) FILTER (WHERE status <> 'MISSING_PROVENANCE') AS n_citations, count(DISTINCT CASE WHEN status = 'VALID' THEN document_id || '/' || page_number || '/' || block_id END) AS n_spans, bool_and(status = 'VALID') AS fully_valid FROM ({known['bm25_top']}) JOIN ({resolved}) USING (chunk_id) GROUP BY 1",
        "answer_prompts": f"""
WITH e AS (SELECT query_id, string_agg('[E' || rank || '] Document: ' || chunk_id || chr(10) || replace(trim(text[1:200]), chr(13) || chr(10), chr(10)) || chr(10), chr(10) ORDER BY rank) AS evidence FROM ({known["bm25_top"]}) JOIN documents ON doc_id = chunk_id WHERE rank <= 2 AND query_id % 3 <> 0 GROUP BY 1),
p AS (SELECT item_id AS query_id, {text(citing.PROMPT_HEAD)} || {sanitised(f"coalesce(evidence, {_q(citing.NO_EVIDENCE)})")} || {text(citing.PROMPT_TAIL)} || trim(text) || {text(citing.PROMPT_END)} AS prompt FROM benchmark LEFT JOIN e ON query_id = item_id)
SELECT query_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
        # the six kinds of replies, by hand
        "parsed_answers": f"""
WITH a AS (SELECT answer_id, answer_id % 6 AS k FROM ({replies})), v(k, answer, n, claim, evidence_ids) AS (VALUES (0, 'Paid within 30 days.', 0, 'Net 30.', 'E1,E2'), (1, 'It renews. It ends. No more.', 0, 'It renews [E2].', 'E2'), (1, 'It renews. It ends. No more.', 1, 'It ends [E3][E2].', 'E3,E2'),
  (2, 'Broken. Rest is cut', 0, 'Broken [E4].', 'E4'), (3, 'Plain words only. And more.', 0, 'Plain words [E1] only.', 'E1'), (4, 'No claims at all.', NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL))
SELECT answer_id, answer, n, claim, evidence_ids FROM a JOIN v USING (k)""",
        "answer_citations": f"""
WITH c AS (SELECT claim_id // 4 AS answer_id, claim_id FROM ({more.oracle_sql()["claim_status"]}) WHERE status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')), o AS ({own}), u AS (SELECT * FROM o UNION ALL SELECT claim_id, 1, document_id, page_number, 'b0' FROM o WHERE claim_id % 3 = 0),
f AS (SELECT answer_id, document_id, page_number, block_id, min(claim_id * 10 + position) AS pos FROM c JOIN u USING (claim_id) GROUP BY ALL)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos, block_id)::INT AS n, document_id, page_number, block_id FROM f""",
        "question_results": results,
        "retrieval_metrics": f"""
WITH r AS ({results}), b AS (SELECT * FROM r UNION ALL SELECT query_id, 'ALL', answerable, first_rank, contained, provenance, failure FROM r)
SELECT category, count(*) AS n_questions, count(*) FILTER (WHERE answerable) AS n_answerable, {hits}, {rate("coalesce(1.0::DOUBLE / first_rank, 0)")} AS mrr, {rate("contained::INT")} AS containment, {rate("provenance::INT")} AS provenance FROM b GROUP BY 1""",
        "evidence_metrics": f"""
WITH s AS (SELECT sp.*, b.text FROM ({spans}) sp JOIN ({lines}) b USING (document_id, block_id)), e AS (SELECT q.query_id, q.requirement_id, bool_or(coalesce(s.document_id = q.document_id, false)) AS doc, bool_or(coalesce(s.document_id = q.document_id AND s.page_number = page, false)) AS pg,
  bool_or(coalesce(s.document_id = q.document_id AND (contains({fold("text")}, {fold("one")}) OR contains({fold("text")}, {fold("two")})), false)) AS says FROM ({required}) q LEFT JOIN s ON s.query_id = q.query_id GROUP BY 1, 2)
SELECT count(*) AS n_requirements, round(avg(doc::INT), 4) AS document_accuracy, round(avg(pg::INT), 4) AS page_accuracy, round(avg(says::INT), 4) AS phrase_containment,
  (SELECT round(avg((status <> 'INVALID_BBOX')::INT), 4) FROM ({resolved}) WHERE status <> 'MISSING_PROVENANCE') AS box_validity FROM e""",
        "answer_metrics": f"""
WITH a AS (SELECT *, answer_id % 3 <> 0 AS answerable, 'k' || answer_id % 4 AS category FROM ({service.oracle_sql()["answer_reports"]}))
SELECT category, count(*) AS n_answers, count(*) FILTER (WHERE overall_status = 'SUPPORTED') AS n_supported, count(*) FILTER (WHERE overall_status = 'CONTRADICTED') AS n_contradicted, {share(refused, "count(*)")} AS refusal_rate,
  {share("overall_status = 'SUPPORTED'", "count(*)")} AS support_rate, {share("fully_grounded", "count(*)")} AS grounded_rate, {share(f"{refused} AND NOT answerable", "count(*) FILTER (WHERE NOT answerable)")} AS handled_rate FROM a GROUP BY 1""",
        "phrase_containment": f"""
WITH l AS (SELECT document_id, {fold("text")} AS t FROM ({known["document_blocks"]})), x AS (SELECT q.query_id, q.requirement_id, coalesce(contains(t, {fold("one")}), false) AS a, coalesce(contains(t, {fold("two")}), false) AS b FROM ({required}) q LEFT JOIN l USING (document_id))
SELECT query_id, requirement_id, CASE WHEN bool_or(a AND b) THEN 'single_chunk' WHEN bool_or(a) AND bool_or(b) THEN 'split' ELSE 'not_found' END AS outcome FROM x GROUP BY 1, 2""",
        "slowest_events": "SELECT value AS p FROM events WHERE value IS NOT NULL ORDER BY value LIMIT 1 OFFSET (SELECT floor(count(value) * 0.95::DOUBLE)::BIGINT FROM events)",
    }
