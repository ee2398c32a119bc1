"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_IN_PART = 33  # bits of monotonically_increasing_id that count within a partition


def _ranges(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """row, part, at: the rows dealt by ranges of ``order``, sorted within them and stored with their place there (from 0)."""
    id_ = F.monotonically_increasing_id()
    sorted_ = df.select(F.struct("*").alias("row")).repartitionByRange(*(F.col(f"row.{c}") for c in order)).sortWithinPartitions(*(f"row.{c}" for c in order))
    return stored(sorted_.withColumn("id", id_).select("row", F.shiftright("id", _IN_PART).alias("part"), F.col("id").bitwiseAND((1 << _IN_PART) - 1).alias("at")), "numbered")


def _with_before(held: DataFrame, size: Column) -> DataFrame:
    """``held`` with ``before``: the sum of ``size`` over all earlier ranges."""
    sizes = held.groupBy("part").agg(size.alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")  # a row per range, of which there are as many as shuffle partitions


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of columns that tell its rows apart (rows equal in them are numbered anyhow).

    Rows are dealt by ranges of the order and shifted by how many rows lie in the ranges before: a window over one row per range."""
    return _with_before(_ranges(df, order), F.max("at") + 1).select("row.*", (F.col("before") + F.col("at") + 1).alias(name))


def running_sum(df: DataFrame, *order: str, of: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of the whole numbers ``of`` up to and with each row, in the order of columns that tell its rows apart."""
    within = F.sum(F.col(f"row.{of}")).over(Window.partitionBy("part").orderBy("at"))
    return _with_before(_ranges(df, order), F.sum(F.col(f"row.{of}"))).select("row.*", (F.col("before") + within).alias(name))
