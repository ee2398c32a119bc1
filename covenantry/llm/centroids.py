"""Clusters around centroids in whole numbers, with block-norm screening.

A vector x and a centroid c are cut into blocks; by Cauchy and Schwarz, block by block,
|x - c|^2 >= sum over blocks (|x_b| - |c_b|)^2. So the norms of the blocks, which are stored with each vector once,
bound its distance to every centroid from below. A vector first gets the exact distance to
the centroid of the least bound; then only centroids whose bound does not exceed the least exact distance so far
are compared with it exactly. Bounds are floating-point numbers and are lowered by more than they can
be off, and a bound equal to the distance screens nothing, so ties are decided on whole numbers.

The jobs: vectors as whole numbers with their norms are stored once; each round is one pass over them that sums
per task and centroid, of which Spark adds up ``k`` rows per task by centroid, and the driver sees ``k`` rows. No
vector is shuffled; no group of vectors meets anywhere, however large a cluster is.

Defined cases: rows whose vector is null, has another number of components than ``width`` or a null or non-finite one
are left out; repeated rows and rows of a null vec_id are vectors like any other; the starts are ordered by their
hash, then by vec_id (null: no hash, last), then by components, so copies can start several centroids, of which the
smaller number takes all; with fewer vectors than ``k`` there are fewer centroids; an empty table gives no rows;
other columns are ignored. A component beyond some 1.8 * 10^8 is an error, since squared distances might
not fit the 64-bit numbers they are returned in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .vectors import SUMS, exact_distances, floored_means, lists, matrix, partial_sums, sound, sums_batch, whole

BLOCKS = 8
_SLACK = 1e-9  # of the norms' magnitude; sums of some hundred doubles are off by less than 1e-13 of it


class Screen:
    """Nearest centroids of many vectors; counts the exact distances it needed."""

    def __init__(self, centroids: np.ndarray, blocks: int = BLOCKS):
        self.centroids, self.blocks = centroids, blocks
        squares = block_squares(centroids, blocks)
        self.norms, self.total = np.sqrt(squares.astype(np.float64)), squares.sum(1)
        self.n_exact = 0

    def bounds(self, squares: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of vectors (by their blocks' squared norms) to all centroids."""
        size = squares.sum(1)[:, None] + self.total[None, :]
        return size * (1 - _SLACK) - 2 * (np.sqrt(squares.astype(np.float64)) @ self.norms.T) - 1e-9

    def nearest(self, x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of ``x`` (ties: the smaller number) and its exact squared distance."""
        rows, low = np.arange(len(x)), self.bounds(squares)
        best = low.argmin(1)
        distance = exact_distances(x, self.centroids[best])
        self.n_exact += len(x)
        low[rows, best] = np.inf
        order = np.argsort(low, axis=1, kind="stable")
        # the centroids of a vector by rising bound: once one is screened, all that follow are
        open_ = rows
        for rank in range(low.shape[1] - 1):
            candidate = order[open_, rank]
            kept = low[open_, candidate] <= distance[open_]
            open_, candidate = open_[kept], candidate[kept]
            if not len(open_):
                break
            found = exact_distances(x[open_], self.centroids[candidate])
            self.n_exact += len(open_)
            nearer = (found < distance[open_]) | ((found == distance[open_]) & (candidate < best[open_]))
            best[open_[nearer]], distance[open_[nearer]] = candidate[nearer], found[nearer]
        return best, distance


def block_squares(x: np.ndarray, blocks: int) -> np.ndarray:
    """Squared norms of the blocks of each row, in whole numbers."""
    starts = np.linspace(0, x.shape[1], blocks, endpoint=False).astype(int)
    return np.add.reduceat(x * x, starts, axis=1) if len(x) else np.zeros((0, blocks), np.int64)


def prepare(table: DataFrame, width: int = 64, factor: int = 64, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, x (whole numbers) and the squared norms of x's blocks, stored."""
    kept = table.filter(sound("embedding") & (F.size("embedding") == width))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", factor, width).alias("x"))

    def add_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = lists(block_squares(matrix(batch.column(1), width), blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), squares], names=["vec_id", "x", "squares"])

    return materialise(rows.mapInArrow(add_norms, "vec_id long, x array<int>, squares array<long>"), "vectors")


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors of the least hash; the driver sees ``k`` rows."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "vec_id", "x").orderBy(F.asc_nulls_last("key"), "vec_id", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k vectors
    width, blocks = centroids.shape[1], BLOCKS

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value)
        for batch in batches:
            best, distance = screen.nearest(matrix(batch.column(1), width), matrix(batch.column(2), blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x", "squares").mapInArrow(near, "vec_id long, cluster int, distance long")


def move(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that has vectors goes to the floor of their mean."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    (k, width), blocks = centroids.shape, BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, n, sums = Screen(shared.value), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            best, _ = screen.nearest(x, matrix(batch.column(1), blocks))
            more = partial_sums(best, x, k)
            n, sums = n + more[0], sums + more[1]
        yield sums_batch(n, sums)

    return floored_means(vectors.select("x", "squares").mapInArrow(add, SUMS), centroids)


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, factor: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    vectors = prepare(table, width, factor)
    centroids = starts(vectors, k)
    if not len(centroids):
        return vectors.selectExpr(
            "vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
        )  # no vector, no row
    for _ in range(rounds):
        centroids = move(vectors, centroids)
    found = materialise(assign(vectors, centroids), "clusters")
    spread = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # k rows at most: a lookup, no join
    rows = [F.struct(F.lit(spread.get(c, 0)).cast("long").alias("inertia"), F.lit(h).alias("sha256")) for c, h in enumerate(hashes)]
    own = F.element_at(F.array(*rows), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", own["inertia"].alias("cluster_inertia"), F.lit(sum(spread.values())).cast("long").alias("inertia"), own["sha256"].alias("centroid_sha256")
    )


def oracle_sql(k: int = 16, rounds: int = 3, width: int = 64, factor: int = 64) -> str:
    # whole numbers of this size are exact as doubles
    def product(a: str, b: str) -> str:
        return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def assigned(name: str) -> str:
        distance = f"{product('x', 'x')} - 2 * {product('x', 'y')} + {product('y', 'y')}"
        return f"""SELECT n, vec_id, any_value(x) AS x, min(struct_pack(d := {distance}, c := c)) AS near FROM kept, {name} GROUP BY n, vec_id"""

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assigned(f'c{r}')})")
        steps.append(
            f"""m{r} AS MATERIALIZED (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS y FROM (
                SELECT near.c AS c, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM a{r}, (SELECT unnest(generate_series(1, {width})) AS i) GROUP BY 1, 2) GROUP BY c)"""
        )
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"""WITH sound AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {width}
        AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {width}),
    kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda v: CAST(floor({factor} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM sound),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec_id, x) - 1 AS c, x AS y FROM kept QUALIFY c < {k}),
    {", ".join(steps)},
    final AS MATERIALIZED ({assigned(f"c{rounds}")})
    SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance,
           CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(y, ',')) AS centroid_sha256
    FROM final JOIN c{rounds} ON c{rounds}.c = near.c"""
