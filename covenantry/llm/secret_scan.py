"""Secrets in whole texts: one combined automaton reads each byte once for all rules (see ``automaton``).

A rule has a ``lead`` and a ``body``; its expression is the one followed by the other, and a match counts if its
body has at least ``least`` characters. Matches of a rule are the leftmost ones and do not overlap; one
that is too short takes its characters with it. Rules are sought independently of one another.

Nothing is shuffled and no batch gathers more than its own rows. The automaton is built from the rules alone on the
driver and broadcast; for the rules below it has 1,894 states and less than a megabyte, whatever the corpus.

Defined cases: a null text is an empty one, which has no spans; a text of any length is scanned as a whole,
byte by byte, with memory for its matches alone; overlapping finds of different rules all stay; repeated rows and
rows of a null doc_id get a row each; an empty table gives no rows; other columns are ignored, whatever
their names. Offsets are code points, ends exclusive. Letters in either case are ASCII ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, Scanner, parse


class Rule(NamedTuple):
    kind: str
    lead: str
    body: str
    least: int = 1
    either_case: bool = False


# the three of the contract; a run of hexadecimal digits is always matched as a whole, so its least length is in its expression
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}", 24),
)
# well-known public formats of keys
ADDED = (
    Rule("forge", "", "gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("chat", "", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("maps", "", "AIza[A-Za-z0-9_-]+", 39),
    Rule("pay", "", "[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", "", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("login", "://", r"[A-Za-z0-9._~%-]+:[A-Za-z0-9._~!$&*+=%-]+@", 4),
)
RULES = BASE + ADDED


class SecretScanner:
    """All matches of ``rules`` in a text's UTF-8 bytes, as (begin, rule's number, end) in code points, by begin."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.scanner = Scanner([(r.lead + r.body, r.either_case) for r in rules])
        self.leads = [Automaton.of(parse(r.lead, r.either_case)) if r.lead else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        found = []
        for k, matches in self.scanner.matches(data).items():
            lead, least = self.leads[k], self.rules[k].least
            for begin, end in matches:
                body = lead.longest(data, begin) if lead else begin
                if end - body >= least:
                    found.append((begin, k, end))
        return self._in_code_points(data, sorted(found))

    @staticmethod
    def _in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not spans or data.isascii():
            return spans
        places, at, n = {}, 0, 0
        for place in sorted({x for begin, _, end in spans for x in (begin, end)}):
            n += len(data[at:place].decode("utf-8", "replace"))
            places[place], at = n, place
        return [(places[begin], k, places[end]) for begin, k, end in spans]


@functools.cache
def _scanner(rules: tuple[Rule, ...]) -> SecretScanner:
    return SecretScanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found``, an array of (kind, begin, end) by begin, then by the rules' order; a row for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    shared = docs.sparkSession.sparkContext.broadcast(_scanner(rules))  # its size depends on the rules alone

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            found = [[(rules[k].kind, begin, end) for begin, k, end in scanner.spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kinds)], names=["doc_id", "found"])

    return rows.mapInArrow(scan, "doc_id long, found array<struct<kind string, begin long, end long>>")


def _of_kinds(*kinds: str) -> Column:
    return F.filter("found", lambda x: x["kind"].isin(*kinds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base rule, the hash of the base spans and all spans as text."""
    base = [r.kind for r in BASE]
    counts = [F.size(_of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return find_secrets(docs).select("doc_id", *counts, F.sha2(_joined(_of_kinds(*base)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql_spans(rule: Rule, number: int) -> str:
    """Spans of one rule: matches are put between two marks that no rule contains, the pieces' lengths give the places."""
    quoted = lambda s: s.replace("'", "''")
    flag = "(?i)" if rule.either_case else ""
    marked = f"regexp_replace(t, '{flag}(?:{quoted(rule.lead)}){quoted(rule.body)}', chr(1) || '\\0' || chr(2), 'g')"
    body = f"regexp_replace(m, '^{flag}(?:{quoted(rule.lead)})', '')" if rule.lead else "m"
    return f"""SELECT n, {number} AS k, '{rule.kind}' AS kind, b, b + length(m) AS e FROM (
        SELECT n, split_part(p, chr(2), 1) AS m,
               coalesce(sum(length(replace(p, chr(2), ''))) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, i
        FROM (SELECT n, unnest(string_split({marked}, chr(1))) AS p, generate_subscripts(string_split({marked}, chr(1)), 1) AS i FROM plain)
      ) WHERE i > 1 AND length({body}) >= {rule.least}"""


def oracle_sql() -> str:
    spans = " UNION ALL ".join(_sql_spans(rule, k) for k, rule in enumerate(RULES))
    line = "kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH plain AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
    spans AS ({spans}),
    joined AS (SELECT n, {counts}, string_agg({line}, ',' ORDER BY b, k) FILTER (k < {len(BASE)}) AS base, string_agg({line}, ',' ORDER BY b, k) AS spans FROM spans GROUP BY n)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM plain LEFT JOIN joined USING (n)"""
