"""Operator 9 and its FM-index against brute force."""

import random

import duckdb
import numpy as np
import pytest

from mnemograph.llm import substring_dedup as s


def brute(docs, n=20):
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            window = tuple(w[k : k + n])
            if window in seen:
                gone |= set(range(k, k + n))
            seen.add(window)
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def run(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as starts", "3 as kept").repartition(3)
    return sorted(map(tuple, s.remove_repeated(df, **more).collect()), key=lambda r: (r[0] is None, r))


def texts(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [fresh(k) for k in (19, 20, 21, 34, 55, 120)]
    docs = []
    for i in range(60):
        w = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            w += p + fresh(rng.randrange(0, 15))
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    docs = texts(seed)
    assert run(spark, docs) == brute(docs)


def test_odd_rows(spark):
    line = " ".join(f"a{i}" for i in range(25))
    docs = [(1, None), (2, ""), (3, "a " * 70), (4, "a b " * 40), (5, line), (7, line + "\n" + line), (8, "\x1c " + line.upper()), (9, "é " * 3 + line)]
    assert run(spark, docs) == brute(docs)
    # A null doc_id keeps all; rows that repeat are one document.
    got = run(spark, [(None, line), (5, line), (5, line), (6, line)])
    assert [(r[0], r[2]) for r in got] == [(5, 0), (5, 0), (6, 25), (None, 0)]
    assert run(spark, []) == []


def test_small_index_gives_the_same(spark):
    docs = texts(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda n: sorted((r.doc_id, r.h, sorted(zip(r.starts, r.sizes))) for r in s.repeated_passages(df, index_words=n).collect())
    assert rows(1) == rows(1_000_000)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    step, sizes = 3, (40, 7, 3, 25, 1)
    text = rng.integers(0, 4, sum(sizes))
    end = np.repeat(np.cumsum(sizes), sizes)
    following = np.arange(len(text)) + step < end
    index = s.FmIndex(text, following, step)
    patterns = rng.integers(0, 4, (300, 4))
    low, high = index.intervals([patterns[:, k] for k in range(4)])
    for p, a, b in zip(patterns, low, high):
        want = {i for i in range(len(text)) if i + 3 * step < end[i] and all(text[i + k * step] == p[k] for k in range(4))}
        assert {int(x) for x in index.positions[a:b]} == want


def test_sql(spark):
    d = duckdb.connect()
    d.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(d.execute(s.OP9_SQL).fetchall())
    assert sorted(map(tuple, s.op9_substring_dedup(spark, "/root/testdata/sf0.001").collect())) == want


def test_popular_passage_with_different_borders_stays_within_an_index(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(30)
    docs = [(i, f"{fresh(18)} {passage} {fresh(18)}") for i in range(150)] + [(150 + i, "again " * (100 + i)) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sizes: dict[int, dict[bytes, int]] = {}
    for r in s.routed(df, 20, 1000).filter("words is not null").collect():
        sizes.setdefault(r.route, {})[bytes(r.words)] = r["size"]
    assert max(sum(x.values()) for x in sizes.values()) <= 1000
    rows = {r.doc_id: r for r in s.repeated_passages(df, index_words=1000).collect()}
    want = {i: n for i, _, n, _ in brute(docs) if n}
    assert {i: len({k for a, n in zip(r.starts, r.sizes) for k in range(a, a + n)}) for i, r in rows.items()} == want
