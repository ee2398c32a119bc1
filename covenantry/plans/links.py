"""Registered queries of amendments and the catalog, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import amendments, facts
from ..sources import contracts, library
from ..sources.shared import stored
from . import more
from . import queries as base

#: Valid in Spark and in DuckDB: a stated set of names to look up.
ASKED_SQL = """
SELECT c_name AS query FROM {customer} WHERE c_custkey % 100 = 0 UNION ALL SELECT 'the ' || c_name || ', Inc. company' FROM {customer} WHERE c_custkey % 100 = 1 UNION ALL SELECT 'nobody at all'
"""


#: Valid in both: of every fiftieth order the contract, by its id or a part of its name, and for some a parent, which may not be there.
COMPARED_SQL = """
SELECT o_orderkey AS ask_id, CASE WHEN o_orderkey % 400 = 150 THEN 'first amendment (' || c_mktsegment WHEN o_orderkey % 700 = 0 THEN 'no such file' ELSE CAST(o_orderkey AS VARCHAR(20)) END AS wanted,
  CASE WHEN o_orderkey % 200 = 50 THEN o_orderkey - 1 WHEN o_orderkey % 300 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 350 = 0 THEN -o_orderkey END AS parent_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 50 = 0 UNION ALL
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)), CAST(NULL AS BIGINT) FROM {orders} WHERE o_orderkey % 8 = 2 AND o_orderkey % 50 <> 0
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendments.link_amendments(library.library(spark, sf_dir), library.library_parties(spark, sf_dir))


def amendment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


def contract_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendments.catalog(library.library(spark, sf_dir), library.library_parties(spark, sf_dir), _links(spark, sf_dir))


def all_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendments.all_parties(library.library_parties(spark, sf_dir))


def documents_by_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(ASKED_SQL, customer=contracts.table(spark, sf_dir, "customer"))
    return amendments.documents_by_party(asked, library.library_parties(spark, sf_dir))


def recital_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendments.recital_evidence(contracts.contract_blocks(spark, sf_dir))


def _changes(blocks: DataFrame) -> DataFrame:
    texts = blocks.select("document_id", "page_number", F.col("reading_order").cast("int").alias("reading_order"), F.substring("text", 1, 120).alias("raw_text"))
    return facts.amendment_facts(blocks).join(texts, ["document_id", "reading_order"]).withColumnRenamed("document_id", "amendment_id")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contracts.contract_blocks(spark, sf_dir)
    return amendments.align_sections(_changes(blocks), stored(_links(spark, sf_dir), "links"), blocks).drop("page_number", "parent_at")


def aligned_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)


def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendments.compare_versions(_aligned(spark, sf_dir))


def compared_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = contracts.contract_blocks(spark, sf_dir)
    asked = spark.sql(COMPARED_SQL, orders=contracts.table(spark, sf_dir, "orders"), customer=contracts.table(spark, sf_dir, "customer"))
    found = amendments.compared_amendments(asked, library.library(spark, sf_dir), stored(_links(spark, sf_dir), "links"), stored(_changes(blocks), "changes"), blocks)
    place = F.transform("evidence", lambda x: F.concat_ws(":", x["document_id"].cast("string"), x["page_number"].cast("string"), x["reading_order"].cast("string")))
    return found.withColumns({"evidence": F.array_join(place, ",")})


def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked amendments of an agreement by their day."""
    days = library.library(spark, sf_dir).select(F.col("document_id").alias("amendment_id"), F.col("effective_date").alias("ord"))
    linked = _links(spark, sf_dir).filter("parent_id IS NOT NULL").join(days, "amendment_id")
    return amendments.version_chains(linked.select(F.col("parent_id").alias("root_id"), F.coalesce("ord", F.lit("")).alias("ord"), "amendment_id"))


def amendment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendments.pairs_of(_links(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (amendment_links, contract_catalog, all_parties, documents_by_party, recital_evidence, aligned_sections, version_comparison, compared_amendments, version_chains, amendment_pairs)
    return {f.__name__: f for f in found}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def links_sql() -> str:
    lib = library.LIBRARY_SQL.format(orders="orders", customer="customer")
    parties = library.PARTIES_SQL.format(orders="orders", customer="customer")
    says = "(contains(lower(coalesce(contract_type, '')), 'amend') OR contains(lower(filename), 'amend'))"
    some = lambda words: "(" + ", ".join(_q(w) for w in words) + ")"
    w = amendments.WEIGHTS
    title_words = f"list_filter(regexp_split_to_array(lower(trim(regexp_replace(c.filename, {_q(amendments.TITLE_CHARACTERS)}, ' ', 'g'))), '\\s+'), lambda w: length(w) > 3 AND w NOT IN {some(amendments.EMPTY_TITLE_WORDS)})"
    mine = f"list_filter(list_distinct(regexp_extract_all(lower(a.filename), '\\b[a-z]{{4,}}\\b')), lambda w: w NOT IN {some(amendments.EMPTY_FILE_WORDS)})"
    theirs = "list_distinct(regexp_extract_all(lower(c.filename), '\\b[a-z]{4,}\\b'))"
    return f"""
WITH lib AS ({lib}), np AS (SELECT DISTINCT document_id, lower(trim(name)) AS party FROM ({parties})), z AS (SELECT document_id, count(*) AS n FROM np GROUP BY 1),
r AS (SELECT lib.*, z.n FROM lib JOIN z USING (document_id)), am AS (SELECT * FROM r WHERE {says} OR n_changes > 0), ag AS (SELECT * FROM r WHERE NOT {says}),
sh AS (SELECT x.document_id AS aid, y.document_id AS cid, count(*) AS both_n FROM np x JOIN np y USING (party) WHERE x.document_id <> y.document_id AND x.document_id IN (SELECT document_id FROM am) AND y.document_id IN (SELECT document_id FROM ag) GROUP BY ALL),
pr AS (SELECT aid, cid, round_even(
    CASE WHEN both_n = a.n THEN 1.0::DOUBLE ELSE both_n / (a.n + c.n - both_n) END * {w["parties"]}::DOUBLE
    + CASE WHEN len(list_filter({title_words}, lambda t: contains(lower(a.opening), t))) > 0 THEN 1.0::DOUBLE
        WHEN regexp_matches(a.opening, {_q("(?i)" + amendments.AGREEMENT)}) AND (contains(lower(c.filename), 'msa') OR contains(lower(c.filename), 'supply') OR contains(lower(c.filename), 'agreement')) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END * {w["recital"]}::DOUBLE
    + CASE WHEN len({mine}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({mine}, {theirs})) / greatest(len({mine}), 1) END * {w["title"]}::DOUBLE
    + CASE WHEN c.effective_date IS NULL OR a.effective_date IS NULL THEN 0.7::DOUBLE WHEN c.effective_date <= a.effective_date THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END * {w["date"]}::DOUBLE
    + CASE WHEN a.n_changes > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * {w["changes"]}::DOUBLE, 3) AS score
  FROM sh JOIN am a ON a.document_id = aid JOIN ag c ON c.document_id = cid),
rk AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, cid) AS k, count(*) OVER (PARTITION BY aid) AS n FROM pr),
tp AS (SELECT aid, any_value(n) AS n_candidates, max(CASE WHEN k = 1 THEN cid END) AS pid, max(CASE WHEN k = 1 THEN score END) AS top_score, max(CASE WHEN k = 2 THEN score END) AS second FROM rk GROUP BY 1),
mg AS (SELECT *, round_even(top_score - coalesce(second, 0), 3) AS margin FROM tp)
SELECT l.document_id AS amendment_id, CASE WHEN top_score >= {amendments.LEAST_SCORE} AND (margin >= {amendments.LEAST_MARGIN} OR n_candidates = 1) THEN pid END AS parent_id,
  CASE WHEN pid IS NULL THEN 'NO_PARENT_CANDIDATES' WHEN top_score >= {amendments.LEAST_SCORE} AND (margin >= {amendments.LEAST_MARGIN} OR n_candidates = 1) THEN 'RESOLVED' ELSE 'UNKNOWN_PARENT' END AS status,
  top_score, margin, coalesce(n_candidates, 0)::BIGINT AS n_candidates FROM lib l LEFT JOIN mg ON l.document_id = aid WHERE {says} OR n_changes > 0"""


def oracle_sql() -> dict[str, str]:
    links, blocks = links_sql(), base.oracle_sql()["contract_blocks"]
    lib = library.LIBRARY_SQL.format(orders="orders", customer="customer")
    parties = library.PARTIES_SQL.format(orders="orders", customer="customer")
    changes = more.oracle_sql()["amendment_facts"]
    impacts = "CASE key " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in amendments.IMPACTS.items()) + " ELSE 'Modifications made to ' || target_section || '.' END"
    number = "rtrim(regexp_extract(trim(text), '(?i)^(?:Section\\s+)?([0-9.]+)\\b(?:\\s+([A-Za-z\\s]+))?', 1), '.')"
    names = "(contains(text, key || '.') OR contains(text, 'Section ' || key))"
    aligned_of = lambda k, *more: f"""
WITH k AS ({k}), b AS ({blocks}), ch AS (SELECT document_id AS amendment_id, reading_order, action, target_section, coalesce(nullif(regexp_extract(target_section, '([0-9.]+)', 1), ''), 'general') AS key FROM ({changes})),
rw AS (SELECT ch.*, k.parent_id, t.text[1:120] AS raw_text, t.page_number FROM ch JOIN k USING (amendment_id) JOIN b t ON t.document_id = amendment_id AND t.reading_order = ch.reading_order WHERE parent_id IS NOT NULL),
nb AS (SELECT document_id, {number} AS key, text, page_number, reading_order FROM b WHERE {number} <> ''),
n1 AS (SELECT document_id, key, arg_min(text, page_number * 1000 + reading_order) AS numbered, min(page_number * 1000 + reading_order) AS npos FROM nb GROUP BY ALL),
f1 AS (SELECT rw.parent_id, rw.key, arg_min(b.text, page_number * 1000 + b.reading_order) AS naming, min(page_number * 1000 + b.reading_order) AS fpos FROM (SELECT DISTINCT parent_id, key FROM rw WHERE key <> 'general') rw JOIN b ON b.document_id = rw.parent_id WHERE {names} GROUP BY ALL),
o1 AS (SELECT rw.amendment_id, rw.key, arg_max(b.text, page_number * 1000 - b.reading_order) AS became FROM (SELECT DISTINCT amendment_id, key FROM rw) rw JOIN b ON b.document_id = rw.amendment_id WHERE contains(text, 'Section ' || key) AND contains(text, 'shall be') GROUP BY ALL)
SELECT rw.amendment_id, rw.parent_id, rw.reading_order, target_section AS section_number,
  CASE WHEN numbered IS NOT NULL THEN coalesce(nullif(trim(regexp_extract(numbered, '^(?:Section\\s+)?[0-9.]+\\s+([A-Za-z\\s]+)', 1)), ''), 'General') WHEN naming IS NOT NULL THEN 'Section ' || rw.key ELSE 'General' END AS section_title,
  CASE WHEN action IN ('ADD_COVERAGE', 'CONFIRM_FULL_FORCE') THEN action ELSE 'DELETE_AND_REPLACE' END AS change_type, coalesce(numbered, naming) AS before_text, coalesce(became, raw_text) AS after_text, {impacts.replace("CASE key", "CASE rw.key")} AS impact
{"".join(", " + x for x in more)} FROM rw LEFT JOIN n1 ON n1.document_id = rw.parent_id AND n1.key = rw.key LEFT JOIN f1 ON f1.parent_id = rw.parent_id AND f1.key = rw.key AND numbered IS NULL LEFT JOIN o1 ON o1.amendment_id = rw.amendment_id AND o1.key = rw.key"""  # noqa: E731
    aligned = aligned_of(links)
    compared = lambda a: f"""
SELECT amendment_id, parent_id, count(*) AS total_modifications, bool_or(change_type = 'CONFIRM_FULL_FORCE') AS full_force_confirmed,
  concat_ws('; ', string_agg(section_number || ' (' || section_title || '): ' || impact, '; ' ORDER BY reading_order) FILTER (WHERE change_type <> 'CONFIRM_FULL_FORCE'), CASE WHEN bool_or(change_type = 'CONFIRM_FULL_FORCE') THEN {_q(amendments.PRESERVED)} END) AS impacts
FROM ({a}) GROUP BY ALL"""  # noqa: E731
    asked = COMPARED_SQL.format(orders="orders", customer="customer")
    return {
        "amendment_links": links,
        "contract_catalog": f"""
WITH k AS ({links}), n AS (SELECT document_id, list_sort(list_distinct(list(trim(name)))) AS names FROM ({parties}) GROUP BY 1)
SELECT l.document_id, coalesce(len(names), 0)::BIGINT AS n_parties, coalesce(array_to_string(names, '; '), '') AS parties, parent_id FROM ({lib}) l LEFT JOIN n USING (document_id) LEFT JOIN k ON k.amendment_id = l.document_id""",
        "all_parties": f"SELECT trim(name) AS name, count(DISTINCT document_id) AS n_documents FROM ({parties}) GROUP BY 1",
        "documents_by_party": f"""
WITH a AS ({ASKED_SQL.format(customer="customer")}), p AS ({parties}), h AS (SELECT query, count(DISTINCT document_id) AS n, min(document_id) AS document_id FROM a JOIN p ON contains(lower(trim(query)), lower(trim(name))) OR contains(lower(trim(name)), lower(trim(query))) GROUP BY 1)
SELECT a.query, CASE WHEN n = 1 THEN document_id END AS document_id FROM a LEFT JOIN h USING (query)""",
        "recital_evidence": f"""
WITH b AS (SELECT *, page_number * 1000 + reading_order AS pos FROM ({blocks})), m AS (SELECT document_id, coalesce(min(pos) FILTER (WHERE page_number <= 2 AND regexp_matches(text, {_q("(?i)" + amendments.AGREEMENT)})), min(pos)) AS pos FROM b GROUP BY 1)
SELECT document_id, page_number, reading_order FROM b JOIN m USING (document_id, pos)""",
        "aligned_sections": aligned,
        "version_comparison": compared(aligned),
        "compared_amendments": f"""
WITH lib AS MATERIALIZED ({lib}), lk AS MATERIALIZED ({links}), bl AS MATERIALIZED (SELECT *, page_number * 1000 + reading_order AS pos FROM ({blocks})), q AS MATERIALIZED ({asked}),
e AS (SELECT ask_id, min(document_id) AS aid, true AS exact FROM q JOIN lib ON document_id::VARCHAR = wanted GROUP BY 1),
pt AS (SELECT ask_id, min(document_id) AS aid, false AS exact FROM q JOIN lib ON contains(lower(filename), lower(wanted)) OR contains(document_id::VARCHAR, lower(wanted)) WHERE ask_id NOT IN (SELECT ask_id FROM e) GROUP BY 1),
f AS (SELECT q.ask_id, aid, coalesce(exact AND n.document_id IS NOT NULL, false) AS explicit, CASE WHEN exact AND n.document_id IS NOT NULL THEN n.document_id ELSE lk.parent_id END AS pid, top_score
  FROM q LEFT JOIN (FROM e UNION ALL FROM pt) x USING (ask_id) LEFT JOIN lib n ON n.document_id = q.parent_id LEFT JOIN lk ON lk.amendment_id = aid),
pr AS MATERIALIZED (SELECT DISTINCT aid AS amendment_id, pid AS parent_id, explicit FROM f WHERE pid IS NOT NULL),
al AS MATERIALIZED ({aligned_of("SELECT DISTINCT amendment_id, parent_id FROM pr", "rw.page_number", "coalesce(npos, fpos) AS ppos")}),
cv AS ({compared("SELECT * FROM al")}),
rc AS (SELECT document_id, coalesce(min(pos) FILTER (WHERE page_number <= 2 AND regexp_matches(text, {_q("(?i)" + amendments.AGREEMENT)})), min(pos)) AS recital, min(pos) AS opening FROM bl GROUP BY 1),
ev AS (SELECT amendment_id, parent_id, explicit, amendment_id AS did, CASE WHEN explicit THEN opening ELSE recital END AS pos, -1 AS o FROM pr JOIN rc ON document_id = amendment_id
  UNION ALL SELECT amendment_id, parent_id, explicit, amendment_id, page_number * 1000 + reading_order, 2 * reading_order FROM al JOIN pr USING (amendment_id, parent_id)
  UNION ALL SELECT amendment_id, parent_id, explicit, parent_id, ppos, 2 * reading_order + 1 FROM al JOIN pr USING (amendment_id, parent_id) WHERE ppos IS NOT NULL),
ef AS (SELECT amendment_id, parent_id, explicit, did, pos, min(o) AS o FROM ev GROUP BY ALL),
es AS (SELECT amendment_id, parent_id, explicit, string_agg(did || ':' || (pos // 1000) || ':' || (pos % 1000), ',' ORDER BY o) AS evidence FROM ef GROUP BY ALL)
SELECT ask_id, CASE WHEN pid IS NULL THEN 'NO_RESULTS' ELSE 'SUCCESS' END AS status, CASE WHEN pid IS NOT NULL THEN aid END AS amendment_id, pid AS parent_id, CASE WHEN pid IS NOT NULL THEN a.filename END AS amendment_filename, p.filename AS parent_filename,
  CASE WHEN pid IS NULL THEN NULL WHEN f.explicit THEN 1.0::DOUBLE ELSE top_score END AS confidence, CASE WHEN pid IS NULL THEN NULL WHEN f.explicit THEN {_q(amendments.BASES[0])} ELSE {_q(amendments.BASES[1])} END AS basis,
  CASE WHEN pid IS NOT NULL THEN coalesce(total_modifications, 0) END AS total_modifications, CASE WHEN pid IS NOT NULL THEN coalesce(full_force_confirmed, false) END AS full_force_confirmed, CASE WHEN pid IS NOT NULL THEN coalesce(impacts, '') END AS impacts, evidence
FROM f LEFT JOIN lib a ON a.document_id = aid LEFT JOIN lib p ON p.document_id = pid LEFT JOIN cv ON cv.amendment_id = aid AND cv.parent_id = pid LEFT JOIN es ON es.amendment_id = aid AND es.parent_id = pid AND es.explicit = f.explicit""",
        "version_chains": f"""
SELECT parent_id AS root_id, row_number() OVER w::INT AS layer, amendment_id, coalesce(lag(amendment_id) OVER w, parent_id) AS base_id
FROM ({links}) JOIN (SELECT document_id AS amendment_id, coalesce(effective_date, '') AS day FROM ({lib})) USING (amendment_id) WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id ORDER BY day, amendment_id)""",
        "amendment_pairs": f"""
WITH k AS (SELECT * FROM ({links}) WHERE parent_id IS NOT NULL)
SELECT amendment_id AS document_id, 'amendment' AS side, parent_id AS other_id FROM k UNION ALL SELECT parent_id, 'parent', amendment_id FROM k""",
    }
