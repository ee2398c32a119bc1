"""A latent space of texts: words and pairs of words weighed in sparse rows, and the space of their greatest variation by a randomized range finder.

The rows stay distributed and sparse. Each pass multiplies them with a basis of ``features`` x (``dimensions`` + ``MORE``) numbers, which is broadcast,
and adds up the products per task; the sums of all tasks are added block by block of terms, each block in one task, and the driver sees one matrix of
that size, whatever the number of texts. A few passes turn a random basis to the wanted space; no vector of a text is ever dense before it has ``dimensions`` numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MORE, PASSES, SEED = 32, 8, 42  # further dimensions that sharpen those wanted, passes over the rows
_BLOCK, _ENTRIES = 256, 1 << 16  # terms whose sums travel together; entries of rows multiplied at once


def terms(words: Column) -> Column:
    """Words of two characters or more that are no English stop words, and pairs of such words that follow each other."""
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords("english")
    one = F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(stop))
    two = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(one), lambda w: F.concat(w, two(w))), 1)


def vocabulary(rows: DataFrame, features: int) -> tuple[dict[str, tuple[int, float]], int]:
    """The ``features`` most frequent terms of rows (id, terms) with a number and their weight by rarity, and the number of rows."""
    n = rows.count()
    counted = rows.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("terms").alias("term")).groupBy("term", "row").agg(F.count(F.lit(1)).alias("times"))
    most = counted.groupBy("term").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("times"), "term").limit(features).collect()
    return {r["term"]: (k, np.log((1 + n) / (1 + r["df"])) + 1) for k, r in enumerate(sorted(most, key=lambda r: r["term"]))}, n


def sparse_rows(rows: DataFrame, known: dict[str, tuple[int, float]]) -> DataFrame:
    """id, ids, weights of rows (id, terms): log counts times rarity, at unit length; the vocabulary, ``features`` terms, is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            ids, weights = [], []
            for found in batch["terms"]:
                own, times = np.unique(np.array([known[x][0] for x in found if x in known], dtype=np.int32), return_counts=True)
                ids.append(own)
                weights.append((1 + np.log(times)) * rarity[own] if len(own) else np.zeros(0))
                length = np.linalg.norm(weights[-1])
                weights[-1] = weights[-1] / length if length else weights[-1]
            yield pd.DataFrame({"id": batch["id"], "ids": ids, "weights": weights})

    rarity = np.array([w for _, w in sorted(known.values())])
    return rows.select("id", "terms").mapInPandas(weigh, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, weights array<double>")


def _slices(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """(term, weight, row within the slice, rows) of some rows at a time, by their number of entries."""
    sizes = np.array([len(x) for x in batch["ids"]], dtype=np.int64)
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), _ENTRIES, side="right")) + begin)
        own = slice(begin, end)
        ids, weights = np.concatenate([*batch["ids"].iloc[own]]).astype(np.int64), np.concatenate([*batch["weights"].iloc[own]])
        yield ids, weights, np.repeat(np.arange(end - begin), sizes[own]), own
        begin = end


def _times(ids: np.ndarray, weights: np.ndarray, row: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Rows times a basis."""
    out = np.zeros((n, basis.shape[1]), basis.dtype)
    if len(ids):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(basis[ids] * weights[:, None].astype(basis.dtype), first, axis=0)
    return out


def _round_trip(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The rows' transpose times the rows times ``basis``; single precision within a slice of rows, whose sums are added up in double."""
    shared = rows.sparkSession.sparkContext.broadcast(basis.astype(np.float32))  # features x (dimensions + MORE)
    shape = basis.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, total = shared.value, np.zeros(shape)
        for batch in batches:
            for ids, weights, row, own in _slices(batch):
                if not len(ids):
                    continue
                there = _times(ids, weights, row, own.stop - own.start, basis)
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
                total[ids[order][first]] += np.add.reduceat(there[row[order]] * weights[order, None].astype(there.dtype), first, axis=0)
        for block in range(0, shape[0], _BLOCK):
            if total[block : block + _BLOCK].any():
                yield pd.DataFrame({"block": [block], "sums": [total[block : block + _BLOCK].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch["block"], batch["sums"], strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(sums)
        yield pd.DataFrame({"block": list(total), "sums": [x.tobytes() for x in total.values()]})

    schema, out = "block int, sums binary", np.zeros(shape)
    for r in rows.select("ids", "weights").mapInPandas(partial, schema).repartition("block").mapInPandas(add, schema).collect():
        block = np.frombuffer(r["sums"]).reshape(-1, shape[1])
        out[r["block"] : r["block"] + len(block)] = block
    return out


def space(rows: DataFrame, width: int, n: int, dimensions: int, passes: int = PASSES) -> np.ndarray:
    """A basis (``width`` x dimensions) of the space in which the stored rows (ids, weights) vary most: their first right singular vectors.

    Of few rows or terms there are fewer dimensions: one less than either, at least one."""
    size = min(dimensions, width - 1, n - 1)
    size = size if size >= 2 else max(1, min(width, n))
    basis, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, min(size + MORE, width))))
    for _ in range(passes - 1):
        basis, _ = np.linalg.qr(_round_trip(rows, basis))
    # within the space found, the directions themselves
    values, turns = np.linalg.eigh(basis.T @ _round_trip(rows, basis))
    return basis @ turns[:, np.argsort(-values)[:size]]


def project(rows: DataFrame, basis: np.ndarray) -> DataFrame:
    """id, v (array<double>) of sparse rows in the space."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, weights, row, own in _slices(batch):
                yield pd.DataFrame({"id": batch["id"].iloc[own], "v": list(_times(ids, weights, row, own.stop - own.start, shared.value))})

    return rows.mapInPandas(turn, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>")
