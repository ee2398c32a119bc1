from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from covenantry.llm import centroids, vector_codes, vectors

TABLE = "vec_id long, embedding array<float>, label int, x string, squares int, cluster string, entry int, n int, key string"


def table_of(spark, rows):
    """Rows of (vec_id, vector, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "x", 1, "c", 2, 3, "k") for i, v, label in rows], TABLE)


def drawn(n, width, seed, levels=9):
    """Few different values, so that distances tie often."""
    draw = np.random.default_rng(seed)
    return (draw.integers(-levels, levels + 1, (n, width)) / 64).astype(np.float32)


def slow_clusters(rows, k, rounds, width, factor):
    kept = [(i, [math.floor(factor * float(x)) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, g in groups.items():
            middle[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [(i, *nearest(x)) for i, x in kept]
    total = {}
    for _, d, j in found:
        total[j] = total.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, j, d, total[j], sum(total.values()), digest[j]) for i, d, j in found), key=str)


@pytest.mark.parametrize("n", [0, 3, 400])
def test_clusters_against_brute_force(spark, n):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(drawn(n, 64, 1))]
    nan, inf = float("nan"), float("inf")
    rows += [(500 + k, v, None) for k, v in enumerate([None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [nan] * 64, [inf] + [0.0] * 63])]
    if n:
        rows += rows[:2] + [(None, rows[0][1], 1), (None, rows[2][1], 1)]  # repeated rows and rows of no vec_id
    got = sorted((tuple(r) for r in centroids.cluster(table_of(spark, rows)).collect()), key=str)
    assert got == slow_clusters(rows, 16, 3, 64, 64)


def test_screen_spares_distances_and_changes_nothing():
    draw = np.random.default_rng(3)
    # vectors whose norm lies in few blocks, so that norms of blocks tell them apart
    x = np.zeros((2000, 64), np.int64)
    for i, own in enumerate(draw.integers(0, 8, 2000)):
        x[i, 8 * own : 8 * own + 8] = draw.integers(-300, 300, 8)
    middle = x[:16].copy()
    middle[5] = middle[2]
    screen = centroids.Screen(middle)
    best, distance = screen.nearest(x, centroids.block_squares(x, 8))
    every = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert screen.n_exact < 0.5 * every.size
    assert (screen.bounds(centroids.block_squares(x, 8)) <= every).all()


def slow_codes(rows, parts, entries, rounds, factor):
    kept = [(i, label, [math.floor(factor * float(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(-(-max(len(x) for _, _, x in kept) // parts), 1) * parts
    kept = [(i, label, x + [0] * (width - len(x))) for i, label, x in kept]
    own = width // parts
    cut = [np.array([x[p * own : p * own + own] for _, _, x in kept], dtype=np.int64) for p in range(parts)]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books, codes, errors = [], [], np.zeros(len(kept), np.int64)
    for v in cut:
        book = v[order].copy()
        for r in range(rounds + 1):
            every = ((v[:, None] - book[None]) ** 2).sum(2)
            code = every.argmin(1)
            for e in range(len(book)) if r < rounds else ():
                if (code == e).any():
                    book[e] = v[code == e].sum(0) // (code == e).sum()
        books.append(book)
        codes.append(code)
        errors += every.min(1)
    by_label = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(str(z) for b in books for z in b.ravel()).encode()).hexdigest()
    return sorted(((kept[r][0], "".join(f"{c[r]:02x}" for c in codes), int(errors[r]), by_label[kept[r][1]], digest) for r in range(len(kept))), key=str)


@pytest.mark.parametrize("n", [0, 5, 700])
def test_codes_against_brute_force(spark, n):
    rows = [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(drawn(n, 64, 2))]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("-inf")], None)]
    if n:
        rows += rows[:2] + [(None, rows[0][1], 1), (None, rows[2][1], None), (903, [], 2), (904, [0.5] * 7, 2)]  # repeated, of no vec_id, short
    got = sorted((tuple(r) for r in vector_codes.encode(table_of(spark, rows)).collect()), key=str)
    assert got == slow_codes(rows, 4, 256, 4, 1024)


def test_bounds_spare_distances_and_change_nothing():
    draw = np.random.default_rng(4)
    middle = draw.integers(-4000, 4000, (40, 16))
    x = middle[draw.integers(0, 40, 3000)] + draw.integers(-150, 150, (3000, 16))
    book = vector_codes.PartBook(x[:64].copy())
    entry, upper, step, lower = book.first(x)
    for _ in range(4):
        moved = book.entries.copy()
        for e in np.unique(entry):
            moved[e] = x[entry == e].sum(0) // (entry == e).sum()
        book = vector_codes.PartBook(moved, book.entries)
        entry, upper, step, lower = book.again(x, entry, upper, step, lower)
        every = ((x[:, None] - moved[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all()
        assert (upper >= np.sqrt(every.min(1))).all() and (lower * step[:, None] <= np.sqrt(every) * (1 + 1e-8)).all()
        assert book.n_exact < 0.2 * every.size


def test_components_too_large_for_the_result_are_an_error(spark):
    rows = [(1, [1e12] * 64, 1)]
    for make in (centroids.cluster, vector_codes.encode):
        with pytest.raises(Exception, match="may not fit 64 bits"):
            make(table_of(spark, rows)).collect()
    most = vectors.largest(64)
    assert 64 * (2 * most) ** 2 < 1 << 63
    x = np.array([[most] * 64, [-most] * 64], dtype=np.int64)
    assert vector_codes.all_distances(x, x).tolist() == [[0, 64 * (2 * most) ** 2], [64 * (2 * most) ** 2, 0]]
