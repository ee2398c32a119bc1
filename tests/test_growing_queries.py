from __future__ import annotations

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from covenantry.operators.numbering import numbered
from covenantry.plans import growing
from covenantry.sources.collection import Collection, Committed, IngestError
from covenantry.streaming import rebuild
from tests.oracle import compare

SQL = growing.oracle_sql()

def fine():
    return F.lit(None).cast("string")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", growing.queries()[name], SQL[name])


def _files(spark, *names, text="some words"):
    return spark.createDataFrame([(n, text) for n in names], "filename string, text string")


def _seen(held, name="documents"):
    return sorted(tuple(r) for r in held.table(name).select("document_id", "filename").collect())


def _words(documents):
    return {"words": documents.select("document_id", "filename", F.explode(F.split("text", " ")).alias("word"))}


def test_a_batch_is_visible_as_a_whole_or_not_at_all(spark, tmp_path):
    held = Collection(spark, f"file://{tmp_path}/c")
    assert held.ingest("a", _files(spark, "b.pdf", "a.pdf"), fine(), _words) == Committed(1, True)
    assert _seen(held) == [("doc_01", "a.pdf"), ("doc_02", "b.pdf")] and len(_seen(held, "words")) == 4

    def broken(documents):
        """Fails in a task, after some tables have been written."""
        bad = documents.withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
        return _words(documents) | {"late": bad.select("document_id", "n")}

    with pytest.raises(IngestError, match="WRITING late") as failed:
        held.ingest("b", _files(spark, "d.pdf", "c.pdf"), fine(), broken)
    assert failed.value.stage == "WRITING late"
    assert len(_seen(held)) == 2 and len(held.history()) == 1
    assert len(os.listdir(tmp_path / "c/attempts")) == 1, "the attempt's folder is gone"
    refuse = F.when(F.col("filename") == "x.txt", "not_a_pdf_name")
    with pytest.raises(IngestError, match="not_a_pdf_name"):
        held.ingest("b", _files(spark, "d.pdf", "x.txt"), refuse, _words)
    # the retry adds each document once, with the numbers that the failed attempt had; repeated, it adds nothing
    for fresh in (True, False):
        assert held.ingest("b", _files(spark, "d.pdf", "c.pdf"), refuse, _words) == Committed(2, fresh)
    assert _seen(held) == [("doc_01", "a.pdf"), ("doc_02", "b.pdf"), ("doc_03", "c.pdf"), ("doc_04", "d.pdf")]
    assert len(held.table("words", version=1).collect()) == 4 and len(held.table("words").collect()) == 8
    assert held.table("absent", schema=held.table("words").schema).count() == 0


def test_two_drivers_never_take_the_same_numbers(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    held, other = Collection(spark, folder), Collection(spark, folder)
    first = []

    def meanwhile(documents):
        """While this batch is being written another driver commits its own."""
        if not first:
            first.append(other.ingest("theirs", _files(spark, "t.pdf"), fine(), _words))
        return _words(documents)

    assert held.ingest("mine", _files(spark, "m.pdf"), fine(), meanwhile) == Committed(2, True)
    assert first == [Committed(1, True)] and _seen(held) == [("doc_01", "t.pdf"), ("doc_02", "m.pdf")]
    assert len(os.listdir(tmp_path / "c/attempts")) == 2
    # and a batch that another driver commits first under the same key is theirs
    first.clear()

    def same(documents):
        if not first:
            first.append(other.ingest("shared", _files(spark, "s.pdf"), fine(), _words))
        return _words(documents)

    assert held.ingest("shared", _files(spark, "s.pdf"), fine(), same) == Committed(3, False)
    assert len(_seen(held)) == 3


def _rows(spark, rows):
    return spark.createDataFrame(rows, "document_id long, filename string, text string, seq int")


def test_replaced_and_deleted_documents(spark, tmp_path):
    held = Collection(spark, f"file://{tmp_path}/c")
    held.replace("a", _rows(spark, [(1, "a", "one two", 1), (2, "b", "three", 1), (3, "c", "four five six", 1)]), _words)
    held.replace("b", _rows(spark, [(2, "b2", "x y", 1), (2, "b3", "z", 2), (4, "d", "", 1)]), _words, "seq")
    assert _seen(held) == [(1, "a"), (2, "b3"), (3, "c"), (4, "d")]
    held.delete("c", spark.createDataFrame([(3,), (9,), (3,)], "document_id long"))
    assert _seen(held) == [(1, "a"), (2, "b3"), (4, "d")] and sorted(r.word for r in held.table("words").collect()) == ["", "one", "two", "z"]
    assert len(_seen(held)) == 3 and held.table("documents", version=1).count() == 3
    held.replace("d", _rows(spark, [(3, "c2", "again", 1)]), _words)  # a deleted document may come again
    assert [r.filename for r in held.table("documents").filter("document_id = 3").collect()] == ["c2"]
    for bad in ([(None, "n", "x", 1)], [(7, "n", "x", 1), (7, "m", "y", 1)]):
        with pytest.raises(IngestError, match="VALIDATING"):
            held.replace("e", _rows(spark, bad), _words)


def test_stream_rebuilds_only_what_comes_and_equals_the_batch_job(spark, tmp_path):
    held = Collection(spark, f"file://{tmp_path}/c")
    read = []

    def watched(documents):
        read.append({os.path.basename(os.path.dirname(os.path.dirname(x))) for x in documents.inputFiles()})
        return growing.derived(documents)

    last = {}
    for shift in growing.COMING:
        arriving = growing._arrival(spark, "/root/testdata/sf0.001", shift)
        arriving.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        last |= {r.document_id: r for r in arriving.collect()}
        rebuild.follow(spark, f"{tmp_path}/in", arriving.schema, held, watched, f"file://{tmp_path}/log", "contracts", "seq", files_per_batch=2)
    attempts = [m["attempt"] for m in held.history()]
    assert len(attempts) > 3 and read == [{a} for a in attempts], "a batch reads the documents it brings and no others"
    whole = growing.derived(spark.createDataFrame(list(last.values()), arriving.schema))
    for name, rows in whole.items():
        want = sorted(str(tuple(r)) for r in rows.collect())
        assert sorted(str(tuple(r)) for r in held.table(name).select(*rows.columns).collect()) == want
    # a crash after the collection took a batch, before the stream noted it: the batch is repeated and counts once
    noted = tmp_path / "log/commits"
    newest = max((x for x in os.listdir(noted) if x.isdigit()), key=int)
    for x in (newest, f".{newest}.crc"):
        if (noted / x).exists():
            os.remove(noted / x)
    rebuild.follow(spark, f"{tmp_path}/in", arriving.schema, held, watched, f"file://{tmp_path}/log", "contracts", "seq", files_per_batch=2)
    assert [m["attempt"] for m in held.history()] == attempts
    shutil.rmtree(tmp_path / "in")


def test_numbers_follow_the_order_over_many_tasks(spark):
    draw = random.Random(3)
    values = draw.sample(range(100_000), 5000)
    rows = spark.createDataFrame([(v, f"x{v}", None if v % 7 == 0 else v % 5) for v in values], "v int, n_ string, part int").repartition(9)
    got = numbered(rows, "part", "v", name="place").collect()
    want = sorted(values, key=lambda v: (v % 7 != 0, v % 5 if v % 7 else 0, v))
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 5001))
    assert numbered(rows.limit(0), "v").count() == 0
