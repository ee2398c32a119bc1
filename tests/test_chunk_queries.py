from __future__ import annotations

import random

import pytest

from covenantry.operators import chunking
from covenantry.plans import chunks
from tests.oracle import compare

SQL = chunks.oracle_sql()
QUERIES = chunks.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    from covenantry.plans import more

    compare(spark, "/root/testdata/sf0.001", (QUERIES | more.queries())[name], SQL[name])


def slow_chunks(blocks):
    """Block by block with a buffer, as a reader would do it: (kind, block ids)."""
    out, held, current = [], [], None

    def close(rows, table=False):
        if rows:
            number = next((b["section_number"] for b in rows if b["section_number"]), None)
            title = next((b["section_title"] for b in rows if b["section_title"]), None)
            marked = any(b["block_type"] == "exhibit_marker" for b in rows)
            kind = "TABLE" if table else "EXHIBIT" if marked else "SECTION" if number else "PARAGRAPH_GROUP"
            text = "\n\n".join(b["text"].strip() for b in rows if b["text"] and b["text"].strip())
            out.append((kind, number, title or ("Table" if table else None), ",".join(b["block_id"] for b in rows), text, min(b["page_number"] for b in rows), max(b["page_number"] for b in rows)))

    for b in blocks:
        if b["is_noise"] and b["block_type"] != "table":
            continue
        if b["block_type"] == "table":
            close(held)
            close([b], table=True)
            held, current = [], None
            continue
        key = (b["section_number"], b["section_title"])
        new = b["block_type"] in ("heading", "exhibit_marker") or (key != current and key[0] is not None)
        n = sum(len(x["text"] or "") for x in held)
        if held and ((new and n >= chunking.SHORTEST) or n + len(b["text"] or "") > chunking.LONGEST):
            close(held)
            held, current = [b], key
        else:
            held.append(b)
            current = key if key[0] or key[1] else current
    close(held)
    return out


def test_placed_chunks_against_a_reader_with_a_buffer(spark):
    draw, rows = random.Random(8), []
    for d in range(60):
        number = title = None
        page = 1
        for i in range(draw.randint(0, 60)):
            page += draw.random() < 0.1
            kind = draw.choices(["paragraph", "heading", "table", "exhibit_marker", "sec_noise", "list_item"], [60, 15, 8, 2, 8, 7])[0]
            if kind == "heading":
                number, title = draw.choice([None, "1", "2.1"]) or number, draw.choice(["Terms", "Fees", ""])
            text = draw.choice([None, "", "x" * draw.randint(1, 90), "word " * draw.randint(1, 300), "y" * 3000])
            rows.append((d, page, i, f"b{i}", kind, kind == "sec_noise" or (kind == "table" and draw.random() < 0.5) or None, number, title, text))
    names = ["document_id", "page_number", "reading_order", "block_id", "block_type", "is_noise", "section_number", "section_title", "text"]
    table = spark.createDataFrame(rows, "document_id long, page_number int, reading_order int, block_id string, block_type string, is_noise boolean, section_number string, section_title string, text string")
    got = {}
    for r in chunking.placed_chunks(table.repartition(5)).orderBy("document_id", "chunk").collect():
        got.setdefault(r.document_id, []).append((r.chunk_type, r.section_number, r.section_title, r.block_ids, r.text, r.page_start, r.page_end))
        assert r.chunk_id == f"chk_{'tbl' if r.chunk_type == 'TABLE' else 'sec'}_{r.document_id}_{r.chunk:03d}" and r.chunk == len(got[r.document_id])
        assert r.n_chars == len(r.text) and r.is_cross_page == (r.page_start != r.page_end)
    for d in range(60):
        assert got.get(d, []) == slow_chunks([dict(zip(names, r, strict=True)) for r in rows if r[0] == d]), d
