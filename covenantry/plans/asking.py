"""Registered queries of question analysis, with their SQL. The questions are a stated set rendered from orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P
from ..operators import understanding as U
from ..sources import contracts, library
from . import graphs

#: Valid in Spark and in DuckDB: a question for every hundredth order.
QUESTIONS_SQL = """
SELECT o_orderkey AS query_id, CASE CAST(o_orderkey / 100 AS INT) % 12
  WHEN 0 THEN 'Which contracts involving ' || c_name || ' have net 45 payment terms?' WHEN 1 THEN 'What obligations does the vendor have under the ' || c_name || ' agreement?'
  WHEN 2 THEN 'When does the contract with ' || c_name || ', Inc. expire, within 3 months?' WHEN 3 THEN 'What changed in section 4.2 and section 7 of the ' || lower(c_mktsegment) || ' amendment?'
  WHEN 4 THEN 'Compare the two agreements side by side' WHEN 5 THEN 'How is the weather in doc_' || CAST(o_orderkey AS VARCHAR(12)) || '?'
  WHEN 6 THEN 'What are the supplier obligations of ' || c_name || ' in doc_' || CAST(o_orderkey AS VARCHAR(12)) || '?' WHEN 7 THEN 'Who must send monthly reports 15 days before the meeting of the licensees?'
  WHEN 8 THEN 'Which duties has the unknown vendor under doc_' || CAST(o_orderkey AS VARCHAR(12)) || '?' WHEN 9 THEN 'Responsibilities of the customers in doc_' || CAST(o_orderkey + 2 AS VARCHAR(12)) || ' for ' || c_name || '?'
  WHEN 10 THEN 'Summarize this contract of Northern Supply ' || CAST(o_custkey % 700 AS VARCHAR(9)) || ' LLC' ELSE NULL END AS text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 100 = 0
"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUESTIONS_SQL, orders=contracts.table(spark, sf_dir, "orders"), customer=contracts.table(spark, sf_dir, "customer"))


def question_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cues(_questions(spark, sf_dir))


def question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.entities(_questions(spark, sf_dir), library.library_parties(spark, sf_dir))


def question_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.documents_of(_questions(spark, sf_dir), library.library(spark, sf_dir), library.library_parties(spark, sf_dir))


def analysed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = library.library_parties(spark, sf_dir)
    roles = spark.sql(graphs.ROLES_SQL.replace("({parties}) x", "{parties}"), parties=parties)
    return U.analyse(_questions(spark, sf_dir), library.library(spark, sf_dir), parties, roles)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (question_cues, question_entities, question_documents, analysed_questions)}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    asked = QUESTIONS_SQL.format(orders="orders", customer="customer").replace("CAST(o_orderkey / 100 AS INT)", "CAST(floor(o_orderkey / 100) AS INT)")
    parties, lib = library.PARTIES_SQL.format(orders="orders", customer="customer"), library.LIBRARY_SQL.format(orders="orders", customer="customer")
    has = lambda words: "(" + " OR ".join(f"contains(low, {_q(w)})" for w in words) + ")"
    some = lambda words: "(" + ", ".join(_q(w) for w in words) + ")"
    matches = lambda p: f"regexp_matches(low, {_q(p)})"
    group = lambda p, k: f"regexp_extract(low, {_q(p)}, {k})"
    compared = f"CASE WHEN {has(U.CHANGE_WORDS)} THEN 'amendment_change' WHEN {has(U.COMPARE_WORDS)} THEN 'multi_contract' END"
    intents = " ".join("WHEN " + " AND ".join(has(g) for g in groups) + f" THEN {_q(name)}" for name, groups in P.INTENTS)
    intent = f"CASE WHEN {matches('|'.join(U.UNANSWERABLE))} THEN 'unanswerable' WHEN {compared} = 'amendment_change' THEN 'amendment' WHEN {compared} = 'multi_contract' THEN 'comparison' {intents} ELSE 'information' END"
    longest = sorted(U.ROLES, key=lambda r: -len(r[0]))
    role = lambda k: "CASE " + f"WHEN {matches(U.UNKNOWN_ROLE)} THEN {('unknown vendor', 'UNKNOWN')[k]!r} " + " ".join(f"WHEN {matches(rf'{chr(92)}b{r[0]}s?{chr(92)}b')} THEN {r[k]!r}" for r in longest) + " END"
    t = f"t AS (SELECT query_id, trim(coalesce(text, '')) AS text, lower(trim(coalesce(text, ''))) AS low FROM ({asked}))"
    cues = f"""WITH {t} SELECT query_id, {intent} AS intent, {compared} AS comparison,
  CASE WHEN {compared} = 'amendment_change' THEN array_to_string(regexp_extract_all(low, 'section\\s+([0-9.]+)', 1), ',') END AS sections, {role(0)} AS role_surface, {role(1)} AS role,
  try_cast({group(U.WITHIN, 1)} AS INT) * CASE WHEN contains({group(U.WITHIN, 2)}, 'month') THEN 30 WHEN contains({group(U.WITHIN, 2)}, 'year') THEN 365 ELSE 1 END AS within_days,
  nullif({group(U.RECURRING, 1)}, '') AS recurring, try_cast({group(U.BEFORE_AFTER, 1)} AS INT) * CASE WHEN {group(U.BEFORE_AFTER, 2)} = 'after' THEN 1 ELSE -1 END AS offset_days,
  nullif(trim({group(U.BEFORE_AFTER, 3)}), '') AS offset_event, coalesce(nullif(regexp_extract(text, '(?i)\\b(net\\s*)?(\\d{{2,3}})\\b', 2), ''), '30') AS payment_term, try_cast(regexp_extract(text, '\\b(\\d{{1,3}})\\b', 1) AS INT) AS number FROM t"""
    ending = _q("(?i)" + U.COMPANY_END)
    whole = "regexp_matches(low, '(^|[^a-z0-9])\\Q' || part || '\\E([^a-z0-9]|$)')"
    entities = f"""WITH {t}, p AS ({parties}), n AS (SELECT name, min(document_id * 10 + ord) AS pos FROM p GROUP BY 1),
v AS (SELECT name, pos, 0 AS k, name AS surface FROM n UNION ALL SELECT name, pos, 1, trim(regexp_replace(name, {ending}, '')) FROM n
  UNION ALL SELECT name, pos, 2, list_filter(regexp_split_to_array(name, '[\\s,]'), lambda w: w <> '' AND lower(w) NOT IN {some(U.FIRST_STOPWORDS)})[1] FROM n),
o AS (SELECT lower(trim(surface)) AS part, arg_min(surface, pos * 10 + k) AS surface, arg_min(name, pos * 10 + k) AS canonical_name, min(pos) // 10 AS document_id FROM v WHERE length(surface) > 2 GROUP BY 1)
SELECT query_id, surface, canonical_name, document_id FROM t JOIN o ON contains(low, part) AND {whole}"""
    one = lambda name: f"CASE WHEN min(lo) = max(hi) THEN min(lo) END AS {name}, CASE WHEN min(lo2) = max(hi2) THEN min(lo2) END AS {name}2"
    documents = f"""WITH {t}, l AS (SELECT document_id, filename, contains(lower(filename), 'amend') AS amends FROM ({lib})), p AS ({parties}),
b AS (SELECT document_id, lower(name) AS low, lower(trim(regexp_replace(name, {ending}, ''))) AS base FROM p),
x AS (SELECT DISTINCT document_id, unnest(list_concat(list_concat(list_transform(regexp_split_to_array(low, '[,–-]'), lambda y: trim(y)), [base]), regexp_split_to_array(base, '\\s+'))) AS part FROM b),
y AS (SELECT part, min(document_id) AS lo, max(document_id) AS hi, min(document_id) FILTER (WHERE NOT amends) AS lo2, max(document_id) FILTER (WHERE NOT amends) AS hi2 FROM x JOIN l USING (document_id)
  WHERE length(part) >= 3 AND part NOT IN {some(U.NAME_STOPWORDS)} AND regexp_matches(part, '^[a-z0-9]') AND regexp_matches(part, '[a-z0-9]$') GROUP BY 1),
w AS (SELECT DISTINCT document_id, amends, unnest(regexp_extract_all(lower(regexp_replace(filename, '[()\\-_.pdf]', ' ', 'g')), '[a-z0-9]+')) AS part FROM l),
z AS (SELECT part, min(document_id) AS lo, max(document_id) AS hi, min(document_id) FILTER (WHERE NOT amends) AS lo2, max(document_id) FILTER (WHERE NOT amends) AS hi2 FROM w WHERE length(part) > 3 AND part NOT IN {some(U.FILE_STOPWORDS)} GROUP BY 1),
bp AS (SELECT query_id, {one("pd")} FROM t JOIN y ON contains(t.low, part) AND {whole} GROUP BY 1), bf AS (SELECT query_id, {one("fd")} FROM t JOIN z ON contains(t.low, part) AND {whole} GROUP BY 1),
bt AS (SELECT query_id, min(document_id) AS td FROM t JOIN w ON amends AND length(part) > 3 AND part NOT IN {some(U.AMENDMENT_FILE_STOPWORDS)} AND contains(t.low, part) AND {whole} GROUP BY 1),
bi AS (SELECT query_id, min(document_id) AS id FROM (SELECT query_id, unnest(regexp_extract_all(low, 'doc_([0-9]+)', 1))::BIGINT AS document_id FROM t) JOIN l USING (document_id) GROUP BY 1)
SELECT query_id, coalesce(id, CASE WHEN contains(low, 'amend') THEN td END, pd, CASE WHEN NOT contains(low, 'amend') THEN pd2 END, fd, CASE WHEN NOT contains(low, 'amend') THEN fd2 END, (SELECT min(document_id) FROM l HAVING count(*) = 1)) AS document_id
FROM t LEFT JOIN bi USING (query_id) LEFT JOIN bt USING (query_id) LEFT JOIN bp USING (query_id) LEFT JOIN bf USING (query_id)"""
    triggered = lambda name: matches("|".join(U.TRIGGERS[name]))
    synonyms = "CASE intent " + " ".join(f"WHEN {_q(k)} THEN [{', '.join(_q(w) for w in v)}]" for k, v in U.SYNONYMS.items()) + " ELSE []::VARCHAR[] END"
    known = "(contains(lower(p.name), lower(e.canonical_name)) OR contains(lower(e.canonical_name), lower(p.name)))"
    short = "lower(trim(string_split(x.name, ',')[1]))"
    swapped = f"((x.role = 'SUPPLIER' AND {has(('customer obligations', 'buyer obligations'))}) OR (x.role IN ('BUYER', 'CUSTOMER') AND {has(('supplier obligations', 'vendor obligations', 'as the supplier'))}))"
    analysed = f"""WITH {t}, c AS ({cues}), d AS ({documents}), e AS ({entities}), p AS ({parties}), x AS ({graphs.ROLES_SQL.format(parties=parties)}),
s AS (SELECT query_id, bool_and(ok) AS all_known FROM (SELECT e.query_id, e.canonical_name, bool_or(coalesce({known}, false)) AS ok FROM e JOIN d USING (query_id) LEFT JOIN p ON p.document_id = d.document_id WHERE d.document_id IS NOT NULL GROUP BY ALL) GROUP BY 1),
h AS (SELECT d.query_id, bool_or(contains(low, {short}) AND {swapped}) AS swapped, count(*) FILTER (WHERE x.role = c.role) AS n_role, min(x.name) FILTER (WHERE x.role = c.role) AS role_party
  FROM d JOIN t USING (query_id) JOIN c USING (query_id) JOIN x ON x.document_id = d.document_id GROUP BY 1),
n AS (SELECT query_id, list_distinct(list(canonical_name ORDER BY document_id, canonical_name)) AS names0, list(canonical_name ORDER BY document_id, canonical_name) AS names1 FROM (SELECT DISTINCT query_id, document_id, canonical_name FROM e) GROUP BY 1),
j AS (SELECT t.*, d.document_id, c.intent, c.role, all_known, swapped, n_role, role_party, coalesce(list_filter(names1, lambda a, i: list_position(names1, a) = i), []) AS names,
  CASE WHEN c.intent = 'unanswerable' THEN 'out_of_domain' WHEN NOT coalesce(all_known, true) AND {has(U.DISTRACTING)} THEN 'other_party' WHEN coalesce(swapped, false) THEN 'inverted_role' END AS note
  FROM t JOIN d USING (query_id) JOIN c USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id)),
k AS (SELECT *, list_filter(list_concat(list_concat(CASE WHEN role IS NOT NULL AND role <> 'UNKNOWN' THEN [CASE WHEN n_role = 1 THEN role_party ELSE lower(role) END] ELSE [] END, names), {synonyms}), lambda a: NOT contains(low, lower(a))) AS terms FROM j)
SELECT query_id, document_id, CASE WHEN note IS NOT NULL THEN 'unanswerable' ELSE intent END AS intent, CASE WHEN role IS NULL THEN NULL WHEN n_role = 1 THEN 'resolved' WHEN n_role > 1 THEN 'ambiguous' ELSE 'unresolved' END AS role_status,
  CASE WHEN n_role = 1 THEN role_party END AS resolved_party, array_to_string(names, '; ') AS entities, note,
  CASE WHEN note IS NOT NULL THEN text ELSE trim(concat_ws(' ', text, array_to_string(list_filter(terms, lambda a, i: list_position(list_transform(terms, lambda b: lower(b)), lower(a)) = i), ' '))) END AS expanded,
  CASE WHEN note IS NOT NULL THEN 'UNANSWERABLE' WHEN len(names) > 0 AND {has(U.MONEY)} AND (intent = 'cross_contract' OR ({has(U.AMONG)} AND contains(low, 'which contracts'))) THEN 'HYBRID_REASONING'
    WHEN {triggered("comparison")} THEN 'COMPARISON_QUERY' WHEN intent = 'amendment' OR {triggered("amendment")} THEN 'AMENDMENT_QUERY' WHEN intent = 'timeline' OR {triggered("timeline")} THEN 'TIMELINE_QUERY'
    WHEN intent = 'obligation' OR {triggered("obligation")} THEN 'OBLIGATION_QUERY' WHEN {triggered("graph_party")} OR {triggered("graph_term")} THEN 'DIRECT_GRAPH'
    WHEN {has(U.OVERVIEWS)} OR ({has(U.DETAILS)} AND {has(U.DETAILED)}) THEN 'CONTRACT_DETAILS' ELSE 'DIRECT_RETRIEVAL' END AS route FROM k"""
    return {"question_cues": cues, "question_entities": entities, "question_documents": documents, "analysed_questions": analysed}
