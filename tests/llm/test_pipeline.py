from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_and_take_effect(stages):
    docs, named, single, clean, private, packed = stages
    assert all(x.columns == docs.columns for x in (named, single, clean, private))
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[2]) < len(ids[1]) and ids[4] == ids[3] == ids[5]
    assert all(r.n_chars == len(r.text) for r in private.collect())


def test_run_gives_the_rows_of_the_stages(spark, stages):
    assert sorted(map(tuple, (r[:5] for r in corpus_pipeline.run(spark, SF).collect()))) == sorted(map(tuple, (r[:5] for r in stages[-1].collect())))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_extra_columns_of_any_name_stay(spark):
    """Every name that a stage uses within, as a column of the documents."""
    names = (
        "doc", "found", "lang_pred", "score", "held_out", "_lang", "_found", "rows_of_lang", "id", "node", "check", "n_rows", "raw", "root", "class_id", "row", "row_text",
        "words", "p", "h", "item", "item_key", "item_id", "shift", "n_equal", "marked", "pieces", "size", "map", "new", "n_entities", "kind", "value", "bands", "_bad", "_kept", "_map",
    )
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.lit(f"own {x}").alias(x) for x in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[x] == f"own {x}" for r in rows for x in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 60
