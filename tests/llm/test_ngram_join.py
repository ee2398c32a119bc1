from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from covenantry.llm import ngram_join
from covenantry.llm.components import components


def words_of(text):
    return tuple(re.findall(r"[^\W_]+", (text or "").lower()))


def brute(rows):
    """doc_id -> (class_id, n_links, n_copies) for rows with distinct ids."""
    texts = defaultdict(list)
    for i, t in rows:
        if words_of(t):
            texts[words_of(t)].append(i)
    keys = list(texts)
    sets = [{k[i : i + 5] for i in range(max(1, len(k) - 4))} for k in keys]
    parent, links = list(range(len(keys))), [0] * len(keys)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, k in enumerate(keys):
        least[root(i)] += texts[k]
    out = {i: (i, 0, 0) for i, t in rows if not words_of(t)}
    for i, k in enumerate(keys):
        for doc_id in texts[k]:
            out[doc_id] = (min(least[root(i)]), links[i], len(texts[k]) - 1)
    return out


def result(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_classes(df).collect()}


def made(seed, groups, size):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(3, 120))]
        for _ in range(draw.randint(1, size)):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append(", ".join(own) if draw.random() < 0.3 else " ".join(own).upper())
    return [(k, t) for k, t in zip(draw.sample(range(10**6), len(rows)), rows, strict=True)]


def test_against_brute_force(docs_of):
    rows = made(1, 150, 6) + [(-1, None), (-2, ""), (-3, "..."), (-4, "one two"), (-5, "One, two!"), (-6, "one two three")]
    assert result(docs_of(rows)) == brute(rows)


def test_large_group_in_several_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join.units_of_work, "__defaults__", (16,))
    rows = made(2, 3, 2) + [(10**7 + k, t) for k, (_, t) in enumerate(made(3, 1, 500) * 2)]
    draw = random.Random(4)
    base = [f"x{k}" for k in range(100)]
    for k in range(150):
        own = list(base)
        own[draw.randrange(100)] = f"y{k}"
        rows.append((2 * 10**7 + k, " ".join(own)))
    assert result(docs_of(rows)) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _, _ in want.values()})


def test_repeated_rows_and_null_ids(docs_of):
    text = " ".join(f"a{k}" for k in range(50))
    rows = [(1, text), (1, text), (2, text.upper()), (None, text), (None, None), (3, None), (4, "z " * 20_000)]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in ngram_join.similar_classes(docs_of(rows)).collect())
    assert got == [(-1, -1, 0, 0), (-1, -1, 0, 0), (1, 1, 0, 2), (1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 0, 0), (4, 4, 0, 0)]
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in ngram_join.keep_one_of_each(docs_of(rows)).collect())
    assert kept == [-1, -1, 1, 3, 4]
    assert ngram_join.similar_classes(docs_of([])).count() == 0


def test_classes_without_counts_are_the_same(docs_of, monkeypatch):
    """One row of each class stays, whether all pairs are verified or only those with the first of a home."""
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    rows = made(5, 40, 5)
    draw = random.Random(6)
    base = [f"x{k}" for k in range(100)]
    for k in range(120):  # a chain: neighbours are linked, the ends are not
        base[draw.randrange(100)] = f"y{k}"
        rows.append((2 * 10**7 + k, " ".join(base)))
    want = brute(rows)
    assert sorted(r.doc_id for r in ngram_join.keep_one_of_each(docs_of(rows)).collect()) == sorted({c for c, _, _ in want.values()})
    assert {r.doc_id: r.class_id for r in ngram_join._classed_rows(docs_of(rows), counts=False).collect()} == {i: c for i, (c, _, _) in want.items()}


def test_chunks_follow_the_words_of_long_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_WORDS", 20_000)
    draw = random.Random(8)
    base = [f"w{draw.randrange(5000)}" for _ in range(8000)]
    rows = []
    for k in range(12):
        own = list(base)
        own[draw.randrange(8000)] = f"z{k}"
        rows.append((k, " ".join(own)))
    texts = ngram_join.sketch(docs_of(rows)).selectExpr("node", "doc_id", "n_words", "bands")
    homes, _ = ngram_join.units_of_work(texts)
    assert max(r["sum(n_words)"] for r in homes.groupBy("chunk").sum("n_words").collect()) <= 8 * 8000 and homes.select("chunk").distinct().count() >= 3
    assert result(docs_of(rows)) == {k: (0, 11, 0) for k in range(12)}


def test_columns_of_any_name_stay(spark):
    clash = {x: f"own {x}" for x in ("id", "node", "check", "n_rows", "doc", "_kept", "_rows", "root", "raw", "class_id")}
    text = " ".join(f"a{k}" for k in range(50))
    df = spark.createDataFrame([(k, t, *clash.values()) for k, t in ((1, text), (2, text), (3, None), (3, None), (4, "b"), (4, "c"))], ["doc_id", "text", *clash])
    got = ngram_join.keep_one_of_each(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 4] and all(r[k] == v for r in got.collect() for k, v in clash.items())


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.choose_bands()
    assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL
    rng = np.random.default_rng(3)
    hits, chance = 0, 0
    for _ in range(300):
        common, a, b = rng.integers(0, 1 << 63, 400, np.uint64), rng.integers(0, 1 << 63, 50, np.uint64), rng.integers(0, 1 << 63, 50, np.uint64)
        x = ngram_join.band_hashes(np.concatenate([common, a, common, b]), np.array([450, 450]), bands, rows)
        hits += (x[0] == x[1]).any()
        chance += (x[0] == x[1]).mean()
    assert hits == 300 and abs(chance / 300 - 0.8**rows) < 0.03


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 299), (299, 298), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 150)} | {k: 298 for k in (298, 299, 300)}


def test_one_row_stays_where_a_doc_id_repeats(docs_of):
    one, two, three = (" ".join(f"{c}{k}" for k in range(50)) for c in "abc")
    near = two.replace("b25 ", "other ")
    rows = [(1, one), (5, one), (5, two), (6, three), (6, three.upper()), (6, three.replace(" ", ", ")), (7, two), (7, near), (8, ""), (8, ""), (8, None), (9, "...")]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one_of_each(docs_of(rows)).collect()]
    assert sorted(i for i, _ in kept) == [1, 5, 6, 8, 8, 9] and (5, two) in kept and (5, one) not in kept
    twice = [(3, two), (3, near), (4, two)]
    assert [r.doc_id for r in ngram_join.keep_one_of_each(docs_of(twice)).collect()] == [3]
