"""Operator 2 against brute force."""

import math
import random

import numpy as np

from mnemograph.llm import top_k


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 100 == 0:
            scored = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b)})[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = top_k.usable(df)
    return sorted(map(tuple, top_k.top_k(v, v.filter("vec_id % 100 = 0"), **more).collect()))


def test_random_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    assert run(spark, rows, block=64, query_block=2) == brute(rows)


def test_odd_rows(spark):
    rows = [(100, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-1.0, 3.0]), (6, [1.0]), (7, []), (200, []), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_large_components_are_exact(spark):
    rows = [(0, [2e6, 1.0, -1e6]), (1, [1.9e6, 5.0, 1e5]), (2, [1.9e6, 6.0, 1e5]), (3, [-1.0, 0.0, 0.25])]
    assert run(spark, rows) == brute(rows)


def test_bounds_save_work(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 50
    v = np.floor((centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16))) * 10)
    s = top_k.Searcher(v[:32], 10, 1.0)
    ids = np.arange(4000)
    got = list(s.meet(ids[:5], v[:5], ids, v))
    for q in range(5):
        score = v @ v[q]
        score[q] = -1e18
        want = sorted(zip(-score, ids))[:10]
        assert [(n, int(x)) for i, n, x in got if i == q] == [(int(i), int(-x)) for x, i in want]
    assert s.evaluated < s.met / 2
