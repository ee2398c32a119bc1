from __future__ import annotations

import itertools
import random
import re

import pytest

from covenantry.llm import decontam

WORD = re.compile(r"[^\W_]+")


def brute(docs, items):
    """All alignments of all pairs by the definition; no seed is looked at."""
    found = {}
    for doc_id, text in docs:
        d = WORD.findall((text or "").lower())
        for item_id, passage in items:
            b = WORD.findall((passage or "").lower())
            n = min(len(b), decontam.WINDOW)
            if not b or (len(b) < decontam.LEAST and d != b):
                continue
            need = n if n < decontam.SPACED else -(-n * 8 // 10)
            for shift in range(-len(b), len(d) + 1):
                equal = [int(0 <= shift + j < len(d) and d[shift + j] == x) for j, x in enumerate(b)]
                best = max(sum(equal[k : k + n]) for k in range(len(b) - n + 1))
                if best >= need:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), best)
    return found


@pytest.mark.parametrize("broadcast_seeds", [0, decontam.BROADCAST_SEEDS])
def test_against_brute_force(spark, docs_of, broadcast_seeds):
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    words = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 14, 15, 17, 20, 22, 35])] + [(30, None), (None, " ".join(words(30))), (31, "...")]
    items.append((32, items[8][1]))
    docs = []
    for k in range(200):
        text = words(draw.randint(0, 60)) if k % 10 else []
        if k % 2 or not text:
            part = (draw.choice(items)[1] or "").split()
            part = [draw.choice(vocabulary) if draw.random() < 0.15 else x for x in part]
            at = draw.randint(0, len(text))
            text[at:at] = part[draw.choice([0, 0, 0, 3]) :]
        docs.append((k // 3 if k % 5 == 0 else 100 + k, ". ".join(text).title() if k % 4 else " ".join(text)))
    docs += [(500, None), (501, ""), (None, items[9][1]), (None, items[9][1]), (502, " ".join(words(20_000)))]
    docs += [(600 + k, items[k][1]) for k in range(4)]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, lang string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontam.find_overlaps(docs_of(docs), bench, broadcast_seeds).collect()}
    assert got == brute(docs, items) and len(got) > 40
    bad = {d for d, _ in got}
    kept = decontam.remove_contaminated(docs_of(docs), bench, broadcast_seeds)
    assert {r.doc_id for r in kept.collect()} >= {d for d, _ in docs} - bad and kept.columns == docs_of([]).columns


def test_masks_miss_no_overlap_at_the_limit():
    """Every way to place the allowed substitutions leaves some mask untouched at some position."""
    for n in range(decontam.LEAST, 21):
        allowed = n - -(-n * 8 // 10) if n >= decontam.SPACED else 0
        for changed in itertools.combinations(range(n), allowed):
            assert any(all(p + k not in changed for k, x in enumerate(m) if x == "1") for m in decontam.MASKS for p in range(n - len(m) + 1)), (n, changed)


def test_whole_table_finds_every_benchmark_passage(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(WORD.findall(t.lower()))
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(docs, bench).collect()}
    assert exact and exact <= got
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert decontam.find_overlaps(docs_of([]), bench).count() == 0
    assert decontam.find_overlaps(docs_of([(1, "a b c d e f g h i j k l")]), bench.limit(0)).count() == 0
    assert decontam.remove_contaminated(docs_of([(1, "x"), (None, None)]), bench).count() == 2


def test_only_rows_whose_own_text_overlaps_go(spark, docs_of):
    passage = " ".join(f"p{k}" for k in range(20))
    clean = " ".join(f"c{k}" for k in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(None, passage), (None, clean), (None, None), (7, f"x {passage} y"), (7, clean), (7, clean), (8, clean)]
    got = decontam.remove_contaminated(docs_of(rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows if passage not in (t or ""))


def test_long_items_are_verified_in_time_that_grows_with_their_length(spark, docs_of):
    import random
    import time

    draw = random.Random(6)
    words = [f"w{draw.randint(0, 10**9)}" for _ in range(20_000)]
    near = [x if k % 7 else "other" for k, x in enumerate(words)]  # a word in seven differs: many runs of equal words on one alignment
    docs = docs_of([(1, "before " + " ".join(words) + " after"), (2, " ".join(near[3:])), (3, " ".join(reversed(words))), (4, "plain")])
    items = spark.createDataFrame([(7, " ".join(words)), (8, "x " * 30)], "item_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontam.find_overlaps(docs, items).collect()}
    assert time.time() - began < 60
    assert got == {(1, 7): 20, (2, 7): 18} == {(r.doc_id, r.item_id): r.n_equal for r in decontam.find_overlaps(docs, items, broadcast_seeds=0).collect()}
