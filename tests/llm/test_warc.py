from __future__ import annotations

import gzip
import io

import pytest

from covenantry.llm import warc
from covenantry.llm.storage import open_filesystem, shared_dir


def expected(rows):
    largest = {}
    for i, _, h in rows:
        h = h or ""
        if h not in largest or largest[h] is None or (i is not None and i > largest[h]):
            largest[h] = i
    return sorted((i, len((h or "").encode()), warc.sha1_base32((h or "").encode()), "response" if i == largest[h or ""] else "revisit", None if i == largest[h or ""] else largest[h or ""]) for i, _, h in rows)


def test_whole_table_round_trip(pages):
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_copies_nulls_long_and_clashing_columns(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (9, "http://x\r\ny", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "other")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, digest int")
    got = warc.archive_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_empty_table_gives_no_rows(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_null_ids_sort_below_all(spark):
    df = spark.createDataFrame([(None, "u", "a"), (2, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    assert got == {(None, "revisit", 2), (2, "response", None), (None, "response", None)}


def test_archives_are_gzip_members_with_payloads(spark, pages):
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write_warc(pages, folder)
    got = {r.page_id: bytes(r.payload) for r in warc.read_warc(manifest, with_payload=True).collect() if r.payload is not None}
    assert all(got[r.page_id] == r.html.encode() for r in pages.collect() if r.page_id in got)
    system, name = open_filesystem(manifest.first().path)
    with system.open_input_stream(name, compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: re")


def test_damage_is_found():
    good = warc.format_record(1, "u", b"payload", None, False)
    assert warc.read_record(next(warc.iter_members(io.BytesIO(good))))[-1] == b"payload"
    with pytest.raises(warc.WarcError):
        list(warc.iter_members(io.BytesIO(good[:-9])))
    with pytest.raises(warc.WarcError):
        warc.read_record(gzip.decompress(good).replace(b"payload", b"pAyload"))
    with pytest.raises(warc.WarcError):
        warc.read_record(gzip.decompress(good)[:-1])


def foreign(kind, head="", body=b"", http=True):
    block = (b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" if http else b"") + body
    kind = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1-2>\r\n{head}Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(kind.encode() + block + b"\r\n\r\n")


def test_archives_of_others():
    body = b"<p>x\r\n\r\ny</p>" * 50_000
    good = foreign("warcinfo", body=b"software: x\r\n", http=False) + foreign("request") + foreign("response", "WARC-Target-URI: http://x\r\n /folded\r\n", body) + foreign("response", "WARC-Block-Digest: md5:abc\r\n", b"z")
    rows = [warc.record_row(*x) for x in warc.iter_records(io.BytesIO(good))]
    assert rows[:2] == [None, None]
    assert rows[2] == (None, "http://x /folded", len(body), warc.sha1_base32(body), "response", None, "<urn:uuid:1-2>", body)
    assert rows[3][2:4] == (1, warc.sha1_base32(b"z"))
    assert [len(p.parts or ()) for _, p in warc.iter_records(io.BytesIO(good), keep=False)] == [0] * 4
    for bad in ("WARC-Block-Digest: sha1:" + "A" * 32, "WARC-Payload-Digest: sha1:" + "0" * 40):
        with pytest.raises(warc.WarcError):
            list(warc.iter_records(io.BytesIO(foreign("response", bad + "\r\n", b"z"))))


def test_a_large_record_is_framed_in_parts():
    """A record that inflates to 200 MB is read in steps; only what is asked for is held."""
    import tracemalloc

    data = foreign("response", body=b"0" * 200_000_000)
    tracemalloc.start()
    ((_, payload),) = warc.iter_records(io.BytesIO(data), keep=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert payload.size == 200_000_000 and peak < 5_000_000


def test_a_very_long_url_comes_back(spark):
    pages = spark.createDataFrame([(1, "http://x.org/" + "a" * 5_000_000, "<p>one</p>"), (2, None, "<p>one</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert got[2].record_type == "response" and (got[1].record_type, got[1].refers_to) == ("revisit", 2)
