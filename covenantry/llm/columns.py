"""Column expressions that several operators share; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also within other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def normal_words(text: Column) -> Column:
    """Words in lower case: maximal runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(normal_words(text), lambda w: F.xxhash64(w))


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``doc``, so that no name of theirs can clash with those added."""
    return docs.select(F.struct("*").alias("doc"), *more)


def unboxed(rows: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``doc`` again, and what else is named."""
    return rows.select("doc.*", *more)
