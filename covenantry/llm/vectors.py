"""What the operators on vectors share: whole-number components, Arrow batches as matrices, exact sums over tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest(width: int) -> int:
    """The greatest component with which a squared distance of ``width`` components surely fits a signed 64-bit number."""
    return min((1 << 30) - 1, math.isqrt((1 << 63) // max(width, 1)) // 2 - 1)


def sound(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole(vector: str | Column, factor: int, width: int) -> Column:
    """floor(factor * x) of each component x as a double; an error beyond ``largest(width)``."""
    limit = largest(width)

    def one(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(factor))
        beyond = F.raise_error(F.lit(f"a component beyond {limit} / {factor}: a squared distance may not fit 64 bits")).cast("int")
        return F.when(F.abs(scaled) > float(limit), beyond).otherwise(F.floor(scaled).cast("int"))

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """An Arrow array of lists of ``width`` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow array of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def exact_distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of equally many rows, in whole numbers."""
    gap = rows - others
    return np.einsum("ij,ij->i", gap, gap)


def partial_sums(groups: np.ndarray, rows: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of the rows of each group."""
    sums = np.zeros((n_groups, rows.shape[1]), np.int64)
    np.add.at(sums, groups, rows)
    return np.bincount(groups, minlength=n_groups).astype(np.int64), sums


def sums_batch(n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """A task's partial sums: key, n, sums of the groups it has met."""
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), lists(sums[some])], names=["key", "n", "sums"])


SUMS = "key int, n long, sums array<long>"


def floored_means(partial: DataFrame, before: np.ndarray) -> np.ndarray:
    """``before`` (a row per key) with the floor of the mean where a key has rows.

    ``partial`` has a row per task and key; one row per key comes to the driver."""
    width = before.shape[1]
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    found = partial.groupBy("key").agg(F.sum("n").alias("n"), *total)
    after = before.copy()
    for row in found.select("key", "n", F.array(*(F.col(f"s{i}") for i in range(width))).alias("sums")).collect():
        after[row["key"]] = np.array(row["sums"], dtype=np.int64) // row["n"]  # floors go down
    return after
