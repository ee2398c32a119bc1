"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Best-fit decreasing needs no more of the corpus than how many pieces have each length: pieces of
one length are interchangeable. The jobs are

1. tokenize and cut (one pass, stored as Parquet): every piece gets its place among the pieces of
   its length within its task;
2. count the pieces by length: ``capacity`` numbers at most, whatever the corpus;
3. plan: walk the lengths downward; a segment tree over the remaining capacities gives the tightest
   open bins in logarithmic time, and runs of equal pieces go into runs of equal bins;
4. place every piece by a lookup of its length and number in the plan, within its task.

The plan's size depends on ``capacity`` alone. No group of pieces meets in one task or on the driver.

Defined cases: null text = empty text, which gives one piece that holds only the end id; a longer
document is cut into full pieces, of which the first may be shorter; rows that repeat a doc_id, or
have none, are packed like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .tokens import PieceEncoder, batches_of

END_ID = 2
_PIECES = "task int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Runs of open bins by remaining capacity; a segment tree finds the tightest non-empty capacity >= a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, count)

    def add(self, remaining: int, first: int, count: int) -> None:
        runs = self.runs[remaining]
        if runs and sum(runs[-1]) == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + count)
        else:
            runs.append((first, count))
        self._mark(remaining)

    def take(self, remaining: int, at_most: int) -> tuple[int, int]:
        first, count = self.runs[remaining].pop()
        if count > at_most:
            self.runs[remaining].append((first, count - at_most))
            first, count = first + count - at_most, at_most
        self._mark(remaining)
        return first, count

    def _mark(self, remaining: int) -> None:
        node = self.leaves + remaining
        self.some[node] = bool(self.runs[remaining])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that an open bin has."""
        node = self.leaves + length
        if self.some[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Runs (length, nth, count, sequence_id, offset): pieces nth.. of a length, one into each of as many sequences.

    Also the number of sequences. It is best-fit decreasing; of a length that fits a bin several
    times, a new bin takes as many as it can before the next is opened."""
    bins, opened, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        nth, left = 0, counts[length]
        while left:
            remaining = bins.tightest(length)
            if remaining is None:
                # new bins for all that is left, each filled with as many pieces as fit
                fits = capacity // length
                full, rest = divmod(left, fits)
                for first, count, each in ((opened, full, fits), (opened + full, min(rest, 1), rest)):
                    for k in range(each if count else 0):
                        rows.append((length, nth, count, first, k * length))
                        nth += count
                    if count and capacity > each * length:
                        bins.add(capacity - each * length, first, count)
                opened, left = opened + full + min(rest, 1), 0
            else:
                first, count = bins.take(remaining, left)
                rows.append((length, nth, count, first, capacity - remaining))
                nth, left = nth + count, left - count
                if remaining > length:
                    bins.add(remaining - length, first, count)
    return pd.DataFrame(rows, columns=["length", "nth", "count", "sequence_id", "offset"], dtype="int64"), opened


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """A row per piece with its checksum and, on demand, its ids; ``nth`` numbers the pieces of a length in a task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, encoder, seen = TaskContext.get().partitionId(), PieceEncoder.of(vocabulary), np.zeros(capacity + 1, dtype="int64")
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].fillna("").tolist()
            for part in batches_of(texts):
                rows = []
                for doc_id, data in zip(ids[part], encoder.encode(texts[part]), strict=True):
                    data += end
                    n = len(data) // 4
                    stop = n % capacity or min(n, capacity)
                    start = piece = 0
                    while start < n:
                        own = data[4 * start : 4 * stop]
                        rows.append((task, doc_id, piece, start, stop - start, zlib.crc32(own), seen[stop - start], own)[: None if with_ids else -1])
                        seen[stop - start] += 1
                        piece, start, stop = piece + 1, stop, stop + capacity
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids)
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(cut, _PIECES + ", ids binary" * with_ids)


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to stored pieces; other columns (``ids``) go along."""
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = plan_bins(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # rows of (length, task), not of pieces; packed by task, a task's pieces find theirs by an equi-join
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    first = {k: (g["nth"].to_numpy(), g["sequence_id"].to_numpy(), g["offset"].to_numpy()) for k, g in plan.groupby("length")}
    shared = pieces.sparkSession.sparkContext.broadcast(first)  # its size depends on the capacity alone
    more = [x for x in pieces.columns if x not in [*(y.split()[0] for y in _PIECES.split(", ")), "base"]]

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nth, sequence, offset = (batch["base"] + batch["nth"]).to_numpy(), np.zeros(len(batch), "int64"), np.zeros(len(batch), "int64")
            lengths = batch["length"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
                begins, sequences, offsets = shared.value[int(lengths[rows[0]])]
                run = np.searchsorted(begins, nth[rows], side="right") - 1
                sequence[rows], offset[rows] = sequences[run] + nth[rows] - begins[run], offsets[run]
            yield batch.assign(sequence_id=sequence, offset=offset)[[x.split()[0] for x in _PLACED.split(", ")] + more]

    kinds = "".join(f", {x} {pieces.schema[x].dataType.simpleString()}" for x in more)
    return pieces.join(offsets, ["task", "length"]).drop("task").mapInPandas(locate, _PLACED + kinds)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pack all ``docs``; a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return place(materialise(cut_pieces(docs, vocabulary, capacity, with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences (sequence_id, ids binary) of pieces placed ``with_ids``; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
