from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture
def docs_of(spark):
    """Rows of (doc_id, text) as documents with the columns that operators must not trip over."""

    def make(rows):
        extra = "doc_id long, text string, lang string, source string, n_chars long, n int, words string, score string, page_id long"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "w", "x", 7) for i, t in rows], extra)

    return make
