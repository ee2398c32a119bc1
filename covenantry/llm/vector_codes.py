"""Vector compression by a codebook per part, trained by Elkan's form of Lloyd's rounds in whole numbers.

Each vector is cut into equal parts; a part's code is the nearest entry of that part position's codebook. With each part are
stored from round to round: its entry, an upper bound of its distance to that entry, and a lower bound of its
distance to every entry. When entries move, upper bounds grow and lower bounds shrink by the
way moved. A part whose upper bound is less than half the way from its entry to the next one keeps its entry unread; else
only entries j are compared exactly whose lower bound and half distance to the part's entry do not exceed the
upper bound. Bounds are rounded outward by more than floating point can be off, and screening is strict, so
an entry that might be as near is always compared, in whole numbers, where the lower index wins.

A lower bound takes one byte: the number of steps, rounded down, of 1/255 of the part's greatest first
distance. So the stored state is 256 bytes a part, and 4 doubles. Each round is a pass that reads the state and writes
the next (Parquet in the shared folder; the one before is removed), then a pass that sums components per
task and entry, which Spark adds up by entry. The driver holds the codebooks: parts * entries * width / parts numbers, whatever the
table's size. No vector is shuffled.

Defined cases: rows whose vector is null or has null or non-finite components are left out; a vector shorter than the longest
kept one (rounded up to a multiple of the parts, at least one component each) counts as if it went on with zeros;
the first codebooks are the parts of the vectors of the least vec_id (null last; of equal ones those of the lesser
components); with fewer vectors than entries there are fewer entries; copies of an entry leave the lower index in use;
repeated rows get a row each; an empty table gives no rows; other columns are ignored, whatever their names. Labels may
be null and of any type that can be grouped. Components so large that a squared distance might not fit 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, store
from .vectors import SUMS, exact_distances, floored_means, lists, matrix, partial_sums, sound, sums_batch, whole

_OUT = 1 + 1e-9  # bounds are widened by this factor; square roots and products of doubles are off by less than 1e-15
_LEVELS = 255
_BOUNDS = "x array<int>, entry array<int>, upper array<double>, step array<double>, lower binary"


def all_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) ** 2 * x.shape[1] < 1 << 52:
        product = (x.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)  # every partial sum is a whole number below 2^53
    else:
        product = x @ entries.T
    return (x * x).sum(1)[:, None] - 2 * product + (entries * entries).sum(1)[None, :]


class PartBook:
    """The codebook of one part position, and how far its entries have moved since the bounds were written."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.half = np.sqrt(all_distances(entries, entries).astype(np.float64)) / 2 / _OUT
        np.fill_diagonal(self.half, np.inf)
        self.next = self.half.min(1)
        self.moved = np.sqrt(exact_distances(entries, before).astype(np.float64)) * _OUT if before is not None else None
        self.n_exact = 0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entry, upper bound, step and lower bounds of parts that have none yet."""
        squares = all_distances(x, self.entries)
        self.n_exact += squares.size
        best = squares.argmin(1)  # the first of equal ones
        far = np.sqrt(squares.astype(np.float64))
        step = far.max(1) / _LEVELS
        step[step == 0] = 1.0
        upper = far[np.arange(len(x)), best] * _OUT
        return best, upper, step, self._steps(far, step[:, None])

    @staticmethod
    def _steps(distance: np.ndarray, step: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(distance / _OUT / step), 0, _LEVELS).astype(np.uint8)

    def again(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, step: np.ndarray, lower: np.ndarray):
        """The same after the entries have moved."""
        upper = upper + self.moved[entry]
        lost = np.ceil(self.moved[None, :] * _OUT / step[:, None])
        lower = np.maximum(lower - lost, 0).astype(np.uint8)
        open_ = np.flatnonzero(upper >= self.next[entry])
        if not len(open_):
            return entry, upper, step, lower
        own, rows = entry[open_], np.arange(len(open_))
        squares = np.full((len(open_), len(self.entries)), np.iinfo(np.int64).max)
        squares[rows, own] = exact_distances(x[open_], self.entries[own])
        near = np.sqrt(squares[rows, own].astype(np.float64))
        bound = np.minimum(upper[open_], near * _OUT)
        candidate = (bound[:, None] >= lower[open_] * (step[open_] / _OUT)[:, None]) & (bound[:, None] >= self.half[own])
        candidate[rows, own] = False
        r, j = np.nonzero(candidate)
        squares[r, j] = exact_distances(x[open_[r]], self.entries[j])
        self.n_exact += len(rows) + len(r)
        best = squares.argmin(1)  # the first of equal ones
        lower[open_[r], j] = self._steps(np.sqrt(squares[r, j].astype(np.float64)), step[open_[r]])
        lower[open_, own] = self._steps(near, step[open_])
        entry, upper = entry.copy(), upper.copy()
        entry[open_], upper[open_] = best, np.sqrt(squares[rows, best].astype(np.float64)) * _OUT
        return entry, upper, step, lower


def whole_vectors(table: DataFrame, parts: int, factor: int) -> tuple[DataFrame, int]:
    """vec_id, label, x (whole numbers, all of one length) of the kept rows, stored; the length of x."""
    kept = table.filter(sound("embedding"))
    most = kept.agg(F.max(F.size("embedding")).alias("n")).collect()[0]["n"] or 0
    width = max(-(-most // parts), 1) * parts
    x = whole("embedding", factor, width)
    padded = F.concat(x, F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding")))
    return materialise(kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", padded.alias("x")), "vectors"), width


def first_books(vectors: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(part, entry, component) of the vectors of the least vec_id; the driver sees ``entries`` rows."""
    rows = vectors.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), parts, width // parts).transpose(1, 0, 2)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def bound_pass(rows: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """Every part's entry and bounds, from those under the entries ``before`` or, without them, from nothing."""
    shared = rows.sparkSession.sparkContext.broadcast((books, before))  # the codebooks alone
    parts, entries, width = books.shape
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, {_BOUNDS}"
    names = ["vec_id", "label", *(x.split()[0] for x in _BOUNDS.split(", "))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, before = shared.value
        own = [PartBook(books[p], None if before is None else before[p]) for p in range(parts)]
        for batch in batches:
            x = matrix(batch.column(2), parts * width).reshape(-1, parts, width)
            if before is None:
                found = [own[p].first(x[:, p]) for p in range(parts)]
            else:
                entry, (upper, step) = matrix(batch.column(3), parts), (matrix(batch.column(i), parts, np.float64) for i in (4, 5))
                lower = _bytes(batch.column(6), parts * entries).reshape(-1, parts, entries)
                found = [own[p].again(x[:, p], entry[:, p], upper[:, p], step[:, p], lower[:, p]) for p in range(parts)]
            entry, upper, step, lower = (np.stack(z, axis=1) for z in zip(*found, strict=True))
            packed = pa.array([row.tobytes() for row in lower.reshape(len(lower), -1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists(entry.astype(np.int32)), lists(upper), lists(step), packed], names=names)

    return rows.select(names[:3] if before is None else names).mapInArrow(assign, schema)


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries that parts have go to the floor of their mean."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width).reshape(-1, width)
            groups = (matrix(batch.column(1), parts) + np.arange(parts) * entries).ravel()
            more = partial_sums(groups, x, parts * entries)
            n, sums = n + more[0], sums + more[1]
        yield sums_batch(n, sums)

    return floored_means(state.select("x", "entry").mapInArrow(add, SUMS), books.reshape(-1, width)).reshape(books.shape)


def train(vectors: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after ``rounds`` rounds, and the state of all vectors under them (entry: the codes), stored."""
    books, before = first_books(vectors, parts, entries, width), None
    state, path = store(bound_pass(vectors, books, None), "codes")
    for _ in range(rounds):
        books, before = moved_books(state, books), books
        state, old = bound_pass(state, books, before), path
        state, path = store(state, "codes")
        discard(old)  # what has been read is written again: the next round reads the new state only
    return books, state


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error (exact, of all parts) of every row of a state."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape
    kind = state.schema["label"].dataType.simpleString()

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x, entry = matrix(batch.column(2), parts * width).reshape(-1, parts, width), matrix(batch.column(3), parts)
            error = sum(exact_distances(x[:, p], books[p, entry[:, p]]) for p in range(parts))
            code = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "x", "entry").mapInArrow(digits, f"vec_id long, label {kind}, code string, error long")


def encode(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector.

    Errors are added up by label before anything is joined; their table has a row per label and is stored, so
    that Spark broadcasts it only where its size allows, and else splits a label with many rows over several tasks."""
    vectors, width = whole_vectors(table, parts, factor)
    if not vectors.take(1):
        return vectors.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")  # no vector, no row
    books, state = train(vectors, width, parts, entries, rounds)
    found = materialise(coded(state, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    by_label = materialise(found.groupBy(F.col("label").alias("own_label")).agg(total), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("own_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024, width: int = 64) -> str:
    own = width // parts

    # whole numbers of this size are exact as doubles
    def product(a: str, b: str) -> str:
        return f"list_inner_product({a}, {b})"

    def assigned(books: str) -> str:
        distance = f"{product('v', 'v')} - 2 * {product('v', 'w')} + {product('w', 'w')}"
        return f"SELECT n, p, any_value(v) AS v, min(struct_pack(d := {distance}, e := e)) AS near FROM cut JOIN {books} USING (p) GROUP BY n, p"

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assigned(f'b{r}')})")
        steps.append(
            f"""m{r} AS MATERIALIZED (SELECT p, e, list(floor(s / k) ORDER BY i) AS w FROM (
                SELECT p, near.e AS e, i, sum(v[i]) AS s, count(*) AS k FROM a{r}, (SELECT unnest(generate_series(1, {own})) AS i) GROUP BY 1, 2, 3) GROUP BY p, e)"""
        )
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.w, b{r}.w) AS w FROM b{r} LEFT JOIN m{r} USING (p, e))")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS n, * FROM (
        SELECT vec_id, label, list_transform(embedding, lambda v: floor({factor} * CAST(v AS DOUBLE))) AS x FROM embeddings
        WHERE len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding))),
    cut AS MATERIALIZED (SELECT n, p, x[p * {own} + 1 : (p + 1) * {own}] AS v FROM kept, (SELECT unnest(generate_series(0, {parts - 1})) AS p)),
    b0 AS MATERIALIZED (SELECT p, n AS e, v AS w FROM cut WHERE n < {entries}),
    {", ".join(steps)},
    final AS MATERIALIZED ({assigned(f"b{rounds}")}),
    coded AS (SELECT n, string_agg(format('{{:02x}}', near.e), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM final GROUP BY n),
    book AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda z: CAST(z AS BIGINT)), ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (n), book"""
