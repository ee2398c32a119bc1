"""Token ids, token files and packing, against the tokenizers library on whole texts and round trips."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from covenantry.llm import packing, token_files
from covenantry.llm.storage import open_filesystem, shared_dir
from covenantry.llm.tokens import PieceEncoder

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  a", "a  b\n\n c ", "tab\tx\r\ny", "nbsp\xa0x  y", "\x1cq\x1f z", "I'll we've 'tis", "é ́x", "ΑΣ ΑΣΑ Σ", "<|endoftext|> x", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "日本語 テスト", "x" * 5000, "1234 5.6", "\n\nq", " \n x", "🙂 ok"]


def reference(path, texts):
    t = Tokenizer.from_file(path)
    return [np.array(x.ids, dtype="<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path, documents):
    texts = ODD + [r.text for r in documents.collect()]
    draw = random.Random(1)
    texts += ["".join(draw.choice("ab1 \n\t'.,é́\xa0Σ") for _ in range(draw.randint(1, 40))) for _ in range(2000)]
    assert PieceEncoder(path).encode(texts) == reference(path, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_as_text(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in t.encode_batch(ODD, add_special_tokens=False)]
    assert PieceEncoder(path, added_as_text=True).encode(ODD) == want != reference(path, ODD)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_forms_of_words_give_the_ids_of_whole_texts(path):
    draw = random.Random(7)
    signs = "aAbBhHsStTlLdIK''.,;:!?.., \u0331\u0301\u0307\u0338İẖ\u212aΣσÀßºªµÿŸ1²½\u00ad\u200d\u0915\u093c\u0958ﬁǅ"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    texts += [f"x{chr(c)}. H{chr(c)}, {chr(c)}A; A!{chr(c)}" for c in range(0x3000)]
    assert PieceEncoder(path).encode(texts) == reference(path, texts)


def test_the_library_gets_each_word_once_in_all_its_forms():
    words = ["".join(x) for x in itertools.product("bdfgk", "aeiou", "lmnr", "tz")]
    texts = [" ".join(f(w) for w in words) for f in (str, str.title, str.upper, "{}.".format, "{},".format, "\n{}?!".format)]
    encoder, given = PieceEncoder(WORDS), []
    encode = encoder._encode
    encoder._encode = lambda pieces: given.extend(pieces) or encode(pieces)
    assert encoder.encode(texts) == reference(WORDS, texts)
    assert len(given) <= len(words) + 4


def test_token_files_send_files_not_records_to_all_tasks(spark, docs_of):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # whatever Spark's estimates are
    try:
        plan = token_files.round_trip(docs_of([(k, "a b") for k in range(50)]), WORDS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    _, _, sent = plan.partition("BroadcastExchange")
    assert "Window" in sent and "MapInArrow" not in sent


def test_token_files_round_trip(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    start, want = 0, []
    for (doc_id, _), data in zip(rows, reference(WORDS, [t for _, t in rows]), strict=True):
        data += np.array([2], "<u4").tobytes()
        want.append((doc_id, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert sorted(map(tuple, token_files.round_trip(documents, WORDS).collect())) == want


def test_token_files_edge_cases_and_shuffled_reads(spark, docs_of):
    rows = [(5, "b a"), (5, "a"), (None, "null id"), (1, None), (2, ""), (3, "x " * 20_000), (-4, "neg")]
    manifest = token_files.write_token_files(docs_of(rows), shared_dir(spark, "t"), WORDS, shards=3)
    records = token_files.read_token_files(manifest, with_ids=True)
    got = token_files.positions(manifest, records).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -4, 1, 2, 3, 5, 5]
    assert [r.n_tokens for r in got][2:4] == [1, 1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    for m in manifest.collect():
        for r in records.filter(f"shard = {m.shard}").collect():
            doc_id, ids = token_files.read_record(m.path, m.index_path, r.nth)
            assert doc_id == r.doc_id and ids.tobytes() == bytes(r.ids)
    assert token_files.round_trip(docs_of([]), WORDS).count() == 0


def test_token_files_find_damage(spark, docs_of):
    manifest = token_files.write_token_files(docs_of([(1, "a b c")]), shared_dir(spark, "t"), WORDS, shards=1)
    system, name = open_filesystem(manifest.first().path)
    with system.open_input_stream(name, compression=None) as f:
        data = bytearray(f.read())
    import io

    for k in (3, 20, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(token_files.RecordError):
            list(token_files.iter_records(io.BytesIO(bytes(bad))))


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    draw = random.Random(3)
    for _ in range(200):
        capacity = draw.choice([10, 64, 100])
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 150))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan, used = packing.plan_bins(counts, capacity)
        assert used == brute_best_fit(lengths, capacity)
        filled = defaultdict(list)
        for r in plan.itertuples():
            for k in range(r.count):
                filled[r.sequence_id + k].append((r.offset, r.length))
        for parts in filled.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        assert plan["count"].sum() == len(lengths)


def check_packing(rows, got, capacity):
    ids = {}
    for (doc_id, _), data in zip(rows, reference(BYTES, [t or "" for _, t in rows]), strict=True):
        ids.setdefault(doc_id, []).append(np.frombuffer(data + np.array([2], "<u4").tobytes(), "<u4"))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    for doc_id, texts in ids.items():
        want = []
        for x in texts:
            first = len(x) % capacity or min(len(x), capacity)
            cuts = [0, *range(first, len(x) + 1, capacity)]
            want += [(k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(by_doc[doc_id]) == sorted(want)
    return len(by_sequence)


def test_packing_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = packing.pack(documents, BYTES).collect()
    assert check_packing(rows, got, 1024) == brute_best_fit([r.length for r in got], 1024)


def test_packing_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (3, "a b c d " * 700), (4, "x"), (4, "x"), (None, "no id"), (5, "y z " * 3)]
    placed = packing.pack(docs_of(rows), BYTES, capacity=16, with_ids=True)
    check_packing(rows, placed.collect(), 16)
    assert all(len(r.ids) // 4 <= 16 for r in packing.sequences(placed).collect())
    assert packing.pack(docs_of([]), BYTES).count() == 0
