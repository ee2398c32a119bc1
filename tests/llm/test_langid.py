from __future__ import annotations

import numpy as np
import zlib

from covenantry.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify_table(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in tested]) > 0.97


def slow_bits(model_texts, text, order):
    """PPM with method C and exclusion, straight from the definition."""
    from collections import Counter, defaultdict

    counts = defaultdict(Counter)
    alphabet = {b for v in model_texts.values() for t in v for b in t.encode()}
    out = {}
    for lang, texts in model_texts.items():
        counts.clear()
        for t in texts:
            x = [None] * order + list(t.encode())
            for i in range(order, len(x)):
                for o in range(order + 1):
                    counts[tuple(x[i - o : i])][x[i]] += 1
        x, bits = [None] * order + [b if b in alphabet else -1 for b in text.encode()], 0.0
        size = len(alphabet) + 2

        def p(context, s, counts=counts, size=size):
            below = (lambda z: p(context[1:], z)) if context else (lambda z: 1 / size)
            c = counts.get(context)
            if not c:
                return below(s)
            total, kinds = sum(c.values()), len(c)
            if s in c:
                return c[s] / (total + kinds)
            return kinds / (total + kinds) * below(s) / (1 - sum(below(z) for z in c))

        for i in range(order, len(x)):
            bits -= np.log2(p(tuple(x[i - order : i]), x[i]))
        out[lang] = bits
    return out


def test_code_lengths_are_those_of_the_definition(monkeypatch):
    monkeypatch.setattr(langid, "MIN_CONTEXT", 1)
    texts = {"a": ["abab abba", "bab"], "b": ["ccad dca", "é d"]}
    model = langid.Model(texts)
    probes = ["abba", "", "dca é", "zzz", "a", "bab ccad"]
    got = model.code_lengths([t.encode() for t in probes])
    for t, row in zip(probes, got, strict=True):
        want = slow_bits(texts, t, langid.ORDER)
        assert np.allclose(row, [want[k] for k in model.languages], rtol=1e-4)


def test_edge_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "123 456 !!"), (4, "word " * 50_000), (None, "some words here"), (4, "again words"), (4, "again words")]
    got = langid.identify_table(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.doc_id for r in got if r.lang_pred == "und") == [1, 2, 3]
    assert langid.identify_table(docs_of([])).count() == 0
    blank = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify_table(blank).first().lang_pred == "und"


def test_slices_of_any_length_give_the_same_code_lengths(monkeypatch):
    import tracemalloc

    draw = np.random.default_rng(1)
    model = langid.Model({"a": ["abab abba"] * 300, "b": ["ccad dca"] * 300, "c": ["éa ü"] * 300})
    texts = ["".join(draw.choice(list("abcdé ü"), n)).encode() for n in (0, 1, 3, 9000, 0, 50_000, 2)]
    whole = model.code_lengths(texts)
    monkeypatch.setattr(langid, "SLICE_BYTES", 1)
    assert np.allclose(model.code_lengths(texts), whole) and (whole[[0, 4]] == 0).all()
    monkeypatch.undo()
    tracemalloc.start()
    model.code_lengths([b"abc " * 5_000_000])  # 20 MB
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
