"""N-gram Jaccard join: MinHash banding, then exact verification on full shingle sets.

Texts are compared as sets of shingles of five words (lower case, punctuation dropped); two texts are
linked if the Jaccard similarity of their sets is 0.8 or more. Number and width of the bands follow
from the wanted recall at that similarity.

1. One pass gives each row the key of its normalised text and its band hashes. Rows with one key are
   copies; only one of them, the representative, goes on.
2. Band hashes are shuffled. Each representative makes its home in the largest bucket it shares, and
   homes are cut into chunks of some ``CHUNK`` texts and some ``CHUNK_WORDS`` words. A bucket nominates
   the pairs of chunks that meet in it, never the pairs of texts.
3. A pair of chunks is one unit of work: its texts' full shingle sets are intersected all against
   all, in blocks. A unit returns a count of links per text and a spanning forest of its links, so
   the rows it makes are as many as its texts, not the square of them. A pair of texts belongs to
   one unit, hence every link counts once.
4. Components of the forests are the classes.

Where only the classes are wanted, each home's texts are first verified against one of them. What is
linked to it is of one class, so chunks of such texts are not compared with each other any more: a group
of near copies takes one comparison per text, and only texts that differ from it meet all others.

Buckets and homes of more than a thousandth of the rows are under a thousand; joins take them apart and
broadcast their side of one row each, so that no large key lands in one task.

Defined cases: null text = text without words; such texts, of no shingle, have no links and no
copies; a text of one to four words is one shingle; rows with a null doc_id are compared with none
and get a null class_id; rows that repeat a doc_id are compared by their texts; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import boxed, text_of, unboxed, word_hashes
from .components import components
from .storage import materialise

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 200
CHUNK = 512
CHUNK_WORDS = 1 << 20
SLICE_WORDS = 200_000
_ODD = np.random.default_rng(20240101).integers(1, 1 << 63, size=(8, MAX_HASHES), dtype=np.uint64) | np.uint64(1)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The widest rows (fewest chance candidates) whose bands reach the recall within so many hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-max(threshold**rows, 1e-9))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within so many hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts whose word hashes lie end to end, and how many each text has (repeats included)."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    counts = np.where(sizes == 0, 0, np.maximum(sizes - WORDS + 1, 1))
    padded = np.concatenate([words.astype(np.uint64), np.zeros(WORDS, np.uint64)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    out = np.zeros(len(owner), dtype=np.uint64)
    for k in range(WORDS):
        inside = at + k < ends[owner]
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, _mix(padded[at + k] + np.uint64(1)), np.uint64(k))
    return _mix(out), counts


def band_hashes(hashes: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of ``bands`` signed 64-bit hashes per text; texts must have a shingle."""
    out = np.zeros((len(counts), bands), dtype=np.uint64)
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):  # so many texts at a time that their hashes stay in the cache
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 60_000, side="right")))
        begin, end = (ends[first - 1] if first else 0), ends[last - 1]
        x = (hashes[begin:end] >> np.uint64(32)).astype(np.uint32)
        starts = ends[first:last] - counts[first:last] - begin
        for band in range(bands):
            key = np.full(last - first, band, dtype=np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                value = (x ^ np.uint32(_ODD[0, k] >> np.uint64(32))) * np.uint32(_ODD[1, k] >> np.uint64(32) | np.uint64(1))
                value ^= value >> np.uint32(15)
                value *= np.uint32(_ODD[2, k] >> np.uint64(32) | np.uint64(1))
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, starts).astype(np.uint64))
            out[first:last, band] = key
        first = last
    return out.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, node and check (two hashes of the normalised text), n_words and bands (none without words) of every row."""
    bands, rows = choose_bands()
    words = word_hashes(text_of())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    source = source.select("doc_id", F.xxhash64("words").alias("node"), F.xxhash64(F.lit(WORDS), "words").alias("check"), F.size("words").cast("long").alias("n_words"), "words")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            begin = held = 0
            for i, size in enumerate(sizes.tolist()):  # so many words at a time, so that memory follows them alone
                held += size
                if held >= SLICE_WORDS or i + 1 == len(sizes):
                    yield bands_of(batch.slice(begin, i + 1 - begin))
                    begin, held = i + 1, 0

    def bands_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("words")
        offsets = lists.offsets.to_numpy()
        sizes, flat = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        hashes, counts = shingles(flat, sizes)
        some = np.flatnonzero(counts)
        values = band_hashes(hashes, counts[some], bands, rows)
        column = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], np.where(counts > 0, bands, 0)])), pa.int32()), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns[:4], column], names=["doc_id", "node", "check", "n_words", "bands"])

    return source.mapInArrow(work, "doc_id long, node long, check long, n_words long, bands array<long>")


def _join_by(rows: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``info`` has of their key: it has one row per key, and in ``n`` how many rows have that."""
    total = info.agg(F.sum("n")).first()[0] or 0
    many = info.filter(F.col("n") > total / 1000)  # under a thousand keys
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(info.filter(F.col("n") <= total / 1000), key)
    return rows.join(F.broadcast(many), key).unionByName(rest)


def _homes(representatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of node, doc_id, n_words, bands: (node, bucket) of texts that share one, and node, doc_id, n_words, home, home_n, home_words, joined."""
    placed = representatives.select("node", "doc_id", "n_words", F.posexplode("bands").alias("band", "hash"))
    placed = placed.select("node", "doc_id", "n_words", F.xxhash64("band", "hash").alias("bucket"))
    buckets = materialise(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = materialise(_join_by(placed, buckets, "bucket"), "shared-buckets")
    homes = shared.groupBy("node", "doc_id", "n_words").agg(F.max(F.struct("n", "bucket")).alias("home"))
    homes = materialise(homes.select("node", "doc_id", "n_words", F.col("home.bucket").alias("home")), "homes")
    # a home joins the most crowded one that it meets in a bucket, so that one group of near copies
    # fills few chunks; which texts share a chunk decides the traffic, never the result
    crowd = materialise(homes.groupBy("home").agg(F.count(F.lit(1)).alias("crowd"), F.sum("n_words").alias("home_words")), "crowds")
    seats = materialise(shared.join(homes.select("node", "home"), "node").select("bucket", "home").distinct(), "seats")
    sized = seats.groupBy("home").agg(F.count(F.lit(1)).alias("n")).join(crowd, "home")
    seats = _join_by(seats, materialise(sized, "sized-seats"), "home").select("bucket", "home", F.struct("crowd", "home").alias("seat"))
    seats = materialise(seats, "seats-by-crowd")
    tops = seats.groupBy("bucket").agg(F.max("seat").alias("top"))
    joined = seats.join(tops, "bucket").groupBy("home").agg(F.max("top").alias("top")).select("home", F.col("top.home").alias("joined"))
    info = materialise(joined.join(crowd, "home").withColumn("n", F.col("crowd")), "joined-homes")
    homes = _join_by(homes, info, "home").select("node", "doc_id", "n_words", "home", F.col("crowd").alias("home_n"), "home_words", "joined")
    return shared.select("node", "bucket"), materialise(homes, "homes-joined")


def _chunks(homes: DataFrame, chunk: int) -> DataFrame:
    """``homes`` with their chunk; small homes stay together, and texts linked to their home's first (if ``linked`` is there) apart."""
    crowds = materialise(homes.groupBy("joined").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")), "sizes")
    small = (F.col("home_n") <= chunk // 4) & (F.col("home_words") <= CHUNK_WORDS // 4)
    part = F.pmod(F.when(small, F.xxhash64("home")).otherwise(F.xxhash64("node")), F.ceil(F.greatest(F.col("n") / F.lit(chunk), F.col("words") / F.lit(CHUNK_WORDS))))
    apart = ["linked"] if "linked" in homes.columns else []
    return materialise(_join_by(homes, crowds, "joined").withColumn("chunk", F.xxhash64("joined", part, *apart)).drop("n", "words"), "chunks")


def _units(shared: DataFrame, homes: DataFrame) -> DataFrame:
    """node, unit, side (0: both chunks are its own; 1 and 2: first and second) of ``homes`` in their chunks."""
    of = F.when(F.col("linked"), F.col("joined")) if "linked" in homes.columns else F.lit(None).cast("long")  # known to be of one class
    met = shared.join(homes.select("node", "chunk", of.alias("known")), "node").groupBy("bucket", "chunk").agg(F.count(F.lit(1)).alias("n"), F.first("known").alias("known"))
    met = materialise(met, "chunks-of-buckets")
    alone = met.filter("n > 1 AND known IS NULL").select(F.col("chunk").alias("one"), F.col("chunk").alias("two"))
    other = met.select("bucket", F.col("chunk").alias("two"), F.col("known").alias("too"))
    two = met.select("bucket", F.col("chunk").alias("one"), "known").join(other, "bucket").filter("one < two AND (known IS NULL OR too IS NULL OR known != too)").select("one", "two")
    units = materialise(alone.union(two).distinct().select("one", "two", F.xxhash64("one", "two").alias("unit")), "units")
    sides = units.filter("one = two").select(F.col("one").alias("chunk"), "unit", F.lit(0).alias("side")).unionByName(
        units.filter("one < two").select("unit", F.inline(F.array(F.struct(F.col("one").alias("chunk"), F.lit(1).alias("side")), F.struct(F.col("two").alias("chunk"), F.lit(2).alias("side")))))
    )
    return materialise(homes.select("node", "chunk").join(sides, "chunk").select("node", "unit", "side"), "unit-texts")


def units_of_work(representatives: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The texts that share a bucket, in chunks, and the units of work of all their pairs."""
    shared, homes = _homes(representatives)
    homes = _chunks(homes, chunk)
    return homes, _units(shared, homes)


def _stars(homes: DataFrame) -> DataFrame:
    """node, unit, side: the texts of each chunk against the first text of their joined home."""
    firsts = homes.groupBy("joined").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = materialise(firsts, "first-texts")
    unit = F.xxhash64("chunk").alias("unit")
    others = _join_by(homes.select("node", "joined", "chunk"), firsts, "joined").filter("node != first").select("node", unit, F.lit(2).alias("side"))
    chunks = homes.select("joined", "chunk").distinct().join(firsts, "joined").select(F.col("first").alias("node"), unit, F.lit(1).alias("side"))
    return materialise(others.unionByName(chunks), "stars")


def _links(sets: list[np.ndarray], sides: np.ndarray, threshold: float) -> np.ndarray:
    """The linked pairs (i, j) of a unit: all against all, or first chunk against second."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], column[several]
    rows = np.flatnonzero(sides != 2), np.flatnonzero(sides != 1)
    both = np.zeros((len(rows[0]), len(rows[1])), dtype=np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for begin in range(0, int(column[-1]) + 1, 4096):  # so many shingles at a time bound the memory
            a, b = np.searchsorted(column, (begin, begin + 4096))
            block = np.zeros((len(sets), 4096), dtype=np.float32)
            block[owner[a:b], column[a:b] - begin] = 1
            both += block[rows[0]] @ block[rows[1]].T
    union = sizes[rows[0]][:, None] + sizes[rows[1]][None, :] - both
    i, j = np.nonzero(both >= threshold * union - 1e-6)
    pairs = np.stack([rows[0][i], rows[1][j]], axis=1)
    return pairs[pairs[:, 0] < pairs[:, 1]] if (sides == 0).all() else pairs


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in range(n) if root(x) != x]


def words_of(docs: DataFrame, homes: DataFrame) -> DataFrame:
    """node, words (hashes) of the texts in ``homes``, stored."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # a merge join at every size: what is broadcast for a small corpus would be another plan for a large one
    held = texts.join(homes.select("node", "doc_id").hint("merge"), "doc_id").select("doc_id", "node", word_hashes(F.col("text")).alias("words"))
    held = held.filter(F.xxhash64("words") == F.col("node")).dropDuplicates(["doc_id", "node"])
    return materialise(held.select("node", "words"), "words")


def verify_units(words: DataFrame, units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, n_links, other: per unit a row for each text with links (n_links) and for each edge of its forest (other)."""
    held = words.join(units.hint("merge"), "node").repartition("unit").sortWithinPartitions("unit").select("unit", "node", "side", "words")

    def solve(nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> tuple[list, list, list]:
        nodes, first = np.unique(np.array(nodes, dtype=np.int64), return_index=True)  # rows may repeat
        if len(nodes) < 2:
            return [], [], []
        pairs = _links([sets[i] for i in first], np.array(sides)[first], threshold)
        number = np.bincount(pairs.ravel(), minlength=len(nodes))
        linked = np.flatnonzero(number)
        edges = _forest(len(nodes), pairs)
        return (
            [*nodes[linked].tolist(), *(int(nodes[a]) for a, _ in edges)],
            [*number[linked].tolist(), *[0] * len(edges)],
            [*[None] * len(linked), *(int(nodes[b]) for _, b in edges)],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sides, sets = None, [], [], []
        out = ([], [], [])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "n_links", "other"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            lists = batch.column("words")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (u, node, side) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if u != unit:
                    for x, y in zip(out, solve(nodes, sides, sets), strict=True):
                        x.extend(y)
                    unit, nodes, sides, sets = u, [], [], []
                words = flat[offsets[i] : offsets[i + 1]]
                nodes.append(node)
                sides.append(side)
                sets.append(np.unique(shingles(words, np.array([len(words)]))[0]))
            if len(out[0]) > 10_000:
                yield flush()
        for x, y in zip(out, solve(nodes, sides, sets), strict=True):
            x.extend(y)
        yield flush()

    return held.mapInArrow(work, "node long, n_links long, other long")


def _verified(docs: DataFrame, texts: DataFrame, counts: bool) -> tuple[DataFrame | None, DataFrame]:
    """(node, n_links) of texts with links, if ``counts``, and edges (a, b) whose components are the classes."""
    edges = lambda found: found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if counts:
        homes, units = units_of_work(texts)
        found = materialise(verify_units(words_of(docs, homes), units), "links")
        return found.filter("other IS NULL").groupBy("node").agg(F.sum("n_links").alias("n_links")), edges(found)
    shared, homes = _homes(texts)
    homes = _chunks(homes, CHUNK)
    words = words_of(docs, homes)
    stars = materialise(verify_units(words, _stars(homes)), "star-links")
    linked = stars.filter("other IS NULL").select("node").distinct().withColumn("linked", F.lit(True))
    homes = homes.drop("chunk").join(linked, "node", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    found = materialise(verify_units(words, _units(shared, _chunks(homes, CHUNK))), "links")
    return None, edges(stars).union(edges(found))


def _classed_rows(docs: DataFrame, counts: bool = True) -> DataFrame:
    """doc_id, node, check, root (of the class), class_id, n_links (null without ``counts``), n_copies of every row of ``docs``; rows that are compared with none have no root."""
    rows = materialise(sketch(docs), "sketches")
    usable = rows.filter("doc_id IS NOT NULL AND size(bands) > 0")
    texts = usable.groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    texts = materialise(texts, "texts")
    links, edges = _verified(docs, texts.select("node", "doc_id", "n_words", "bands"), counts)
    joined = texts.select("node", "check", "doc_id", "n").join(components(edges), "node", "left")
    # the class's least doc_id; texts of no other class keep their own
    least = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = joined.join(least, "root", "left").withColumn("root", F.coalesce("root", "node"))
    joined = joined.join(links, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")) if counts else joined.withColumn("n_links", F.lit(None).cast("long"))
    classes = materialise(joined.select("node", "check", "root", F.coalesce("least", "doc_id").alias("class_id"), "n_links", (F.col("n") - 1).alias("n_copies")), "classes")
    classed = usable.select("doc_id", "node", "check").join(classes, ["node", "check"]).select("doc_id", "node", "check", "root", "class_id", "n_links", "n_copies")
    alone = rows.filter("doc_id IS NULL OR size(bands) = 0")
    none = F.lit(0).cast("long")
    return classed.union(alone.select("doc_id", "node", "check", F.lit(None).cast("long"), F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies")))


def similar_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links, n_copies of every row of ``docs``.

    n_links: different texts of similarity 0.8 or more; n_copies: other rows with the same normalised text."""
    return _classed_rows(docs).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, that of the least doc_id; rows without a doc_id all stay. All columns stay.

    If several rows of the class have that doc_id, one of them stays: of the text whose hashes are least.
    Of texts without words, equal rows (doc_id and text) count as one."""
    rows = materialise(_classed_rows(docs, counts=False).filter("doc_id IS NOT NULL"), "classed-rows")
    times = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    named = rows.filter("root IS NOT NULL AND doc_id = class_id").groupBy("root", "doc_id").agg(F.min(F.struct("node", "check")).alias("text"))
    wordless = rows.filter("root IS NULL").select("doc_id", "node", "check").distinct()
    kept = named.select("doc_id", "text.node", "text.check").unionByName(wordless).join(times, "doc_id")
    kept = materialise(kept.select(F.col("doc_id").alias("id"), "node", "check", "n_rows"), "kept")
    held = boxed(docs, F.col("doc_id").cast("long").alias("id"))
    out = unboxed(held.join(kept.filter("n_rows = 1").hint("merge"), "id"))  # one plan at every size
    several = kept.filter("n_rows > 1")
    if not several.isEmpty():  # a doc_id that repeats does not tell rows apart, so their texts do
        words = word_hashes(F.coalesce(F.col("doc.text").cast("string"), F.lit("")))
        again = held.join(several.select("id").distinct().hint("merge"), "id", "left_semi")
        again = again.select("doc", "id", F.xxhash64(words).alias("node"), F.xxhash64(F.lit(WORDS), words).alias("check"), F.when(F.size(words) == 0, F.col("doc.text")).alias("raw"))
        found = again.dropDuplicates(["id", "node", "check", "raw"]).join(several.select("id", "node", "check"), ["id", "node", "check"], "left_semi")
        out = out.unionByName(unboxed(found))
    return out.unionByName(docs.filter("doc_id IS NULL"))


def oracle_sql() -> str:
    """The rows of ``similar_classes`` over ``documents`` in DuckDB SQL: all pairs of different texts that share a shingle, without banding."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, w, array_to_string(w, ' ') AS key FROM d WHERE len(w) > 0), t AS (SELECT key, min(doc_id) AS rep, count(*) AS n, any_value(w) AS w FROM k GROUP BY 1),
s AS (SELECT DISTINCT rep, unnest(CASE WHEN len(w) < {WORDS} THEN [key] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM t),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY 1), j AS (SELECT a.rep AS a, b.rep AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b FROM j JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE both_n >= {THRESHOLD} * (x.n + y.n - both_n) - 1e-6),
c(node, root) AS (SELECT rep, rep FROM t UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
r AS (SELECT node, min(root) AS class_id FROM c GROUP BY 1), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT k.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, t.n - 1 AS n_copies FROM k JOIN t USING (key) JOIN r ON r.node = t.rep LEFT JOIN l ON l.a = t.rep
UNION ALL SELECT doc_id, doc_id, 0, 0 FROM d WHERE len(w) = 0 UNION ALL SELECT NULL, NULL, 0, 0 FROM documents WHERE doc_id IS NULL
"""
