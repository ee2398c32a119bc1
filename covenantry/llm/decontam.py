"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over successive words that ignores some positions, so two passages share a hash
though the words there differ. All seeds of the training texts are joined with those of the benchmark.
A hit fixes an alignment (the difference of the two positions); an alignment is verified by counting
equal words around it: some ``WINDOW`` successive words of the item (the whole item, if it is shorter)
must agree in at least ``MIN_EQUAL`` of their positions. Items of under ``SPACED`` words must agree in
all positions.

The three masks miss nothing: by enumeration, every way to place the substitutions that this limit
allows in 10 to 20 words leaves some mask at some position untouched. Fewer words, all equal, contain
the first mask.

The seeds of the benchmark are counted. Up to ``BROADCAST_SEEDS`` of them they are broadcast, and texts
are verified where they are read: nothing but verified overlaps is shuffled. Beyond, seeds are shuffled
by hash and texts by row, and each alignment takes along only the words it covers.

Defined cases: null texts have no words; an item of under ``LEAST`` words is found only where it is the
whole text; items without a word match nothing; rows that repeat a doc_id are compared one by one and
reported once per item; a null doc_id is reported as null; null or repeated item_ids are items of
their own text; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import boxed, let, text_of, unboxed, word_hashes
from .storage import materialise

# The seeds; 1 marks a position that counts.
MASKS = ("11111", "110111", "11001011")
LEAST = 5  # words of the shortest mask
SPACED = 10  # items of fewer words match exactly
WINDOW = 20
MIN_EQUAL = 0.8
BROADCAST_SEEDS = 1_000_000  # some 100 MB with the words of their items


def _seed_rows(rows: DataFrame, words: str) -> DataFrame:
    """``rows`` with h and p: the hashes of every mask at every position where it fits in ``words``.

    A text of under ``LEAST`` words has one: that of the whole text."""
    n = F.size(words)
    last = F.when(n >= LEAST, n - LEAST).when(n > 0, F.lit(0))
    placed = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("p"))  # null: no row
    hashes = []
    for mask, shape in enumerate(MASKS):
        at = [k for k, x in enumerate(shape) if x == "1"]
        value = F.xxhash64(F.lit(mask), *(F.get(words, F.col("p") + k) for k in at))
        hashes.append(F.when(F.col("p") + len(shape) <= n, value))
    whole = F.xxhash64(F.lit(-1), F.col(words))
    hashes[0] = F.when(n < LEAST, whole).otherwise(hashes[0])
    return placed.select("*", F.explode(F.array(*hashes)).alias("h")).filter("h IS NOT NULL")


def _row_key(text: Column) -> list[Column]:
    """Two hashes that name a row of doc_id and text; rows that are equal share them."""
    return [F.xxhash64("doc_id", F.length(text)).alias("row"), F.xxhash64(text).alias("row_text")]


def _windows_at(size: Column, seed: Column) -> tuple[Column, Column]:
    """The first and the last window (by where it begins in an item of ``size`` words) that hold the seed at position ``seed``."""
    n = F.least(size, F.lit(WINDOW))
    return F.greatest(F.lit(0), F.least(seed + LEAST, size) - n), F.least(seed, size - n)


def _verified(words: Column, item: Column, begin: Column, first: Column, last: Column) -> Column:
    """Equal words of the best of the item's windows ``first`` to ``last``, if they are enough; else null. Where ``first`` begins stands in ``words`` at ``begin``."""
    n = F.least(F.size(item), F.lit(WINDOW))
    need = F.when(n < SPACED, n).otherwise(F.ceil(n * F.lit(MIN_EQUAL)).cast("int"))
    near = F.slice(item, first + 1, last - first + n)
    equal = F.transform(near, lambda x, j: F.when(F.coalesce(x == F.get(words, begin + j), F.lit(False)), 1).otherwise(0))
    total = lambda e: F.aggregate(e, F.lit(0), lambda a, x: a + x)
    windows = lambda e: F.transform(F.sequence(F.lit(1), last - first + 1), lambda k: total(F.slice(e, k, n)))
    best = let(equal, lambda e: F.when(total(e) >= need, F.array_max(windows(e))))
    return F.when(best >= need, best)


def _items(benchmark: DataFrame) -> DataFrame:
    words = benchmark.select(F.col("item_id").alias("item_id"), word_hashes(text_of()).alias("item"))
    return materialise(words.filter(F.size("item") > 0).withColumn("item_key", F.xxhash64("item")), "benchmark-items")


def _overlaps(docs: DataFrame, items: DataFrame, broadcast_seeds: int) -> DataFrame:
    """row, row_text, doc_id, item_key, n_equal of the verified alignments of every row."""
    texts = items.dropDuplicates(["item_key"]).select("item_key", "item")
    seeds = _seed_rows(texts, "item").select("h", F.col("p").alias("item_at"), "item_key", F.size("item").alias("item_size"))
    bench = materialise(seeds, "benchmark-seeds")
    few = bench.count() <= broadcast_seeds
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_of().alias("text"))
    rows = rows.select(*_row_key(F.col("text")), "doc_id", word_hashes(F.col("text")).alias("words"))
    shift = (F.col("p") - F.col("item_at")).alias("shift")
    if few:
        # a hit takes along the words of the windows that hold it, at most 35: every window with enough equal words
        # holds a seed, so the best of all seeds' windows is the best of all windows
        n = F.least("item_size", F.lit(WINDOW))
        first, last = _windows_at(F.col("item_size"), F.col("item_at"))
        there = F.col("p") - F.col("item_at") + first
        found = _seed_rows(rows, "words").join(F.broadcast(bench), "h")
        found = found.select(
            "row", "row_text", "doc_id", "item_key", first.alias("first"), last.alias("last"), F.least(there, F.lit(0)).alias("begin"), F.size("words").alias("n"),
            F.slice("words", F.greatest(there, F.lit(0)) + 1, F.greatest(last - first + n + F.least(there, F.lit(0)), F.lit(0))).alias("words"),
        )
        found = found.join(F.broadcast(texts), "item_key")
    else:
        seeds = _seed_rows(rows.select("row", "row_text", "words"), "words").select("row", "row_text", "h", "p")
        hits = seeds.join(bench, "h").select("row", "row_text", "item_key", shift, "item_size").distinct()
        near = F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("item_size") + F.least(F.col("shift"), F.lit(0)))
        held = rows.join(materialise(hits, "alignments"), ["row", "row_text"])
        held = held.select("row", "row_text", "doc_id", "item_key", F.least(F.col("shift"), F.lit(0)).alias("begin"), F.size("words").alias("n"), near.alias("words"))
        size = F.size("item")
        found = held.join(texts, "item_key").withColumns({"first": F.lit(0), "last": size - F.least(size, F.lit(WINDOW))})
    found = found.filter((F.size("item") >= LEAST) | (F.col("n") == F.size("item")))
    best = _verified(F.col("words"), F.col("item"), F.col("begin"), F.col("first"), F.col("last"))
    found = found.select("row", "row_text", "doc_id", "item_key", best.alias("n_equal"))
    return found.filter("n_equal IS NOT NULL")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, n_equal (equal words of the best window): a row per contaminated document and item."""
    items = _items(benchmark)
    best = _overlaps(docs, items, broadcast_seeds).groupBy("doc_id", "item_key").agg(F.max("n_equal").alias("n_equal"))
    return best.join(items.select("item_key", "item_id"), "item_key").groupBy("doc_id", "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows of ``docs`` whose own text has no verified overlap with any item, whatever other rows of their doc_id have; all columns stay."""
    bad = materialise(_overlaps(docs, _items(benchmark), broadcast_seeds).select("row", "row_text").distinct(), "contaminated")
    return unboxed(boxed(docs, *_row_key(text_of())).join(bad, ["row", "row_text"], "left_anti"))


def oracle_sql() -> str:
    """The rows of ``find_overlaps`` in DuckDB SQL, without seeds: an overlap has three equal words in a row, since
    no fewer can be left of 10 words with 2 substitutions or 20 with 4 (items of under 10 words: all are equal)."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')"
    n = f"least(len(b.w), {WINDOW})"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS k, {words} AS w FROM benchmark),
dg AS (SELECT r, unnest(range(0, len(w) - 2)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 2),
bg AS (SELECT k, unnest(range(0, len(w) - 2)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM b WHERE len(w) >= {LEAST}),
a AS (SELECT DISTINCT r, k, dg.p - bg.p AS shift FROM dg JOIN bg USING (g)),
e AS (SELECT d.doc_id, b.item_id, {n} AS n, list_transform(range(1, len(b.w) + 1), lambda j: CASE WHEN shift + j >= 1 AND d.w[shift + j] = b.w[j] THEN 1 ELSE 0 END) AS same
      FROM a JOIN d USING (r) JOIN b USING (k)),
v AS (SELECT doc_id, item_id, CASE WHEN n < {SPACED} THEN n ELSE ceil(n * {MIN_EQUAL}) END AS need,
        list_max(list_transform(range(1, len(same) - n + 2), lambda i: list_sum(same[i:i + n - 1]))) AS best FROM e),
s AS (SELECT doc_id, item_id, len(b.w) AS best FROM d JOIN b ON d.w = b.w WHERE len(b.w) BETWEEN 1 AND {LEAST - 1})
SELECT doc_id, item_id, max(best)::BIGINT AS n_equal FROM (SELECT doc_id, item_id, best FROM v WHERE best >= need UNION ALL SELECT * FROM s) GROUP BY ALL
"""
