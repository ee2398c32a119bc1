"""Linking of amendments by groups of agreements: the same as by pairs, and no pairs are made."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from covenantry.operators import amendments
from tests.plans import most_rows

SCHEMA, PARTY = "document_id long, filename string, contract_type string, effective_date string, opening string, n_changes int", "document_id long, ord int, name string"
FILES = ("Alpha supply Agreement.pdf", "Beta-Master Services Agreement 7.pdf", "Lease.pdf", "Gamma MSA", "alpha alpha terms.pdf", "First Amendment (alpha).pdf", "a.pdf")
OPENINGS = ("This amends the Alpha supply terms.", "First Amendment to the Master  Services Agreement.", "Nothing said of it.", None)


def library(n, seed, most):
    draw = random.Random(seed)
    rows, parties = [], []
    for d in range(n):
        kind = draw.choice(("Amendment", "Supply Agreement", None))
        rows.append((d, draw.choice(FILES), kind, draw.choice((None, "2001-01-01", "2002-05-05", "2003-01-01", "2004-02-03")), draw.choice(OPENINGS), draw.choice((0, 0, 1))))
        names = draw.sample(("A", "b ", "C", "d", "E", "f, 1:g", "", "2:A"), draw.randint(0, most))
        parties += [(d, k, x) for k, x in enumerate(names)]
    return rows, parties


def by_pairs(spark, rows, parties):
    """Every amendment's candidates, best, least document of it, and second, from all scored pairs."""
    found = amendments._candidates(*amendments._sides(rows, parties)).collect()
    held = {}
    for r in found:
        held.setdefault(r.a_id, []).append((-r.score, r.c_id))
    out = {}
    for a, pairs in held.items():
        pairs.sort()
        top, second = -pairs[0][0], -pairs[1][0] if len(pairs) > 1 else 0.0
        margin = round(top - second, 3)
        clear = top >= amendments.LEAST_SCORE and (margin >= amendments.LEAST_MARGIN or len(pairs) == 1)
        out[a] = (pairs[0][1] if clear else None, top, margin, len(pairs))
    return out


def test_same_as_by_pairs(spark):
    resolved = 0
    # none, few and some documents of more parties than are listed; amendments that are agreements too
    for seed, (n, most) in enumerate(((12, 2), (25, 3), (60, 4), (80, 7))):
        rows, parties = library(n, seed, most)
        tables = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(parties or [(-1, 0, "z")], PARTY)
        want = by_pairs(spark, *tables)
        got = {r.amendment_id: r for r in amendments.link_amendments(*tables).collect()}
        assert len(got) == sum("amend" in (r[2] or "").lower() or "amend" in r[1].lower() or r[5] > 0 for r in rows)
        for a, r in got.items():
            assert (r.parent_id, r.top_score, r.margin, r.n_candidates) == want.get(a, (None, None, None, 0)), (seed, a)
            assert (r.status == "NO_PARENT_CANDIDATES") == (a not in want)
            resolved += r.status == "RESOLVED"
    assert resolved > 3


def test_a_party_of_all_contracts_makes_no_pairs(spark):
    n = 4000
    at = F.col("document_id")
    rows = spark.range(n).select(
        F.col("id").alias("document_id"), F.when(F.col("id") % 2 == 0, "First Amendment.pdf").otherwise("Supply Agreement.pdf").alias("filename"), F.when(F.col("id") % 2 == 0, "Amendment").otherwise("Supply Agreement").alias("contract_type"),
        F.concat(F.lit("2001-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("effective_date"), F.lit("Made.").alias("opening"), (1 - F.col("id") % 2).alias("n_changes"),
    )
    parties = rows.select(at, F.lit(0).alias("ord"), F.lit("Hot, Inc.").alias("name")).unionByName(rows.select(at, F.lit(1).alias("ord"), F.concat(F.lit("p"), (at % 500).cast("string")).alias("name")))
    df = amendments.link_amendments(rows, parties)
    got = df.collect()
    assert len(got) == n // 2 and all(r.n_candidates == n // 2 for r in got)
    assert most_rows(df) < 30 * n  # there are 1,000 pairs a document
