"""A training corpus in five stages; each is an operator of ``covenantry.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows of its predecessor,
written as Parquet and read again. All but the last return the columns of ``documents``.

Defined cases: a document with null text, or without a letter, has no language and goes in the first stage;
rows that repeat a doc_id are told apart by their texts; rows with a null doc_id are compared with none in
the second stage and stay; ties (several copies with the least doc_id) leave one row; an empty table gives
an empty one of the same columns; extra columns stay as they are, whatever their names, up to the last
stage; the texts are whole in all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenantry.llm import decontam, langid, ngram_join, packing, pii
from covenantry.llm.columns import boxed, unboxed
from covenantry.llm.storage import shared_dir

MIN_SCORE = 0.5
ORACLE_SQL = None  # no stage but the decontamination has a form in SQL; the tests hold them against brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or whose best language is not the likelier one, go."""
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(boxed(docs, F.col("text").alias("text")), model)
    return unboxed(found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id."""
    return ngram_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text."""
    changed = pii.replace_entities(docs, count=None)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, "stage-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
