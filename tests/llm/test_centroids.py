"""Operator 11 against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np

from mnemograph.llm import centroids


def brute(rows, k=3, rounds=4, dims=4):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)
    at = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(at)), key=lambda j: (far(v, at[j]), j))
    for _ in range(rounds):
        groups = [[] for _ in at]
        for _, v in good:
            groups[near(v)].append(v)
        at = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, at)]
    if not at:
        return []
    placed = [(i, near(v), far(v, at[near(v)])) for i, v in good]
    own = [sum(d for _, c, d in placed if c == j) for j in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, own[c], sum(own), digest[c]) for i, c, d in placed), key=str)


def run(spark, rows, k=3, rounds=4, dims=4, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, cluster int")
    return sorted(map(tuple, centroids.clusters(centroids.usable(df, dims), k, rounds, dims=dims, **more).collect()), key=str)


def test_random(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.5) for _ in range(4)]) for i in range(300)]
    for bits in (2, 8):
        assert run(spark, rows, bits=bits, fit_rows=50) == brute(rows)


def test_ties_and_repeats(spark):
    rows = [(i, [float(x) / 1024 for x in ((i % 3) * 2, 0, (i % 2) * 2, 0)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, [0.5, 0.5, 0.5, 0.5]), (7, [-0.5, 0.5, 0.5, 0.5])] + [(1000 + i, rows[3][1]) for i in range(200)]
    for k in (1, 4, 9):
        assert run(spark, rows, k=k, bits=1) == brute(rows, k=k)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.0, -0.0001]), (2, None), (3, [1.0, None, 0.0, 0.0]), (4, [float("nan"), 0.0, 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (8, []), (None, [5.0, 5.0, 5.0, 5.0]), (9, [-3.0, 1.0, 0.0, 0.0])]
    assert run(spark, rows, k=8) == brute(rows, k=8)
    assert run(spark, []) == []
    assert run(spark, [(None, [1.0, 1.0, 1.0, 1.0])]) == []  # without an id there is no first centroid


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e5, 123456.7, -4e5, 2.5e5]) + rng.random() for _ in range(4)]) for i in range(40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows + [(99, [1e300, 0.0, 0.0, 0.0])])[-1][2] >= 0


def test_intervals_save_fetches(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 32)) * 3
    rows = [(i, (middle[i % 6] + rng.normal(size=32)).tolist()) for i in range(2000)]
    df = centroids.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 32)
    made = centroids.Clustering(df, 32, 1024.0, 6, 1000)
    made.rounds(made.first(df, 6, "3:"), 10)
    assert made.scanned >= 2000 and made.fetched < made.scanned / 3


def test_cells_cover_and_intervals_hold():
    rng = np.random.default_rng(4)
    y = np.floor(rng.standard_t(2, size=(500, 5)) * 1000)
    borders = centroids.cell_borders(y[:100], y.min(0), y.max(0), 16)
    cells = centroids.cell_numbers(y, borders)
    for d in range(5):
        assert (borders[d][cells[:, d]] <= y[:, d]).all() and (y[:, d] <= borders[d][cells[:, d] + 1]).all()
    c = [[int(x) for x in y[i]] for i in range(4)]
    fit = centroids.Tables(borders, c).candidates(cells)
    far = ((y[:, None] - np.array(c)[None]) ** 2).sum(2)
    assert fit[np.arange(500), far.argmin(1)].all()
