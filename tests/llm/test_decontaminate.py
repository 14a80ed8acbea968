"""Operator 6 against brute force and on planted leaks."""

import random
from collections import Counter

import numpy as np
import pytest

from mnemograph.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def test_planted(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(40)]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, filler(300) + " " + items[i][1].upper() + "\n" + filler(100)) for i in range(40)]
    docs += [(100 + i, filler(400)) for i in range(40)]
    docs += [(200 + i, filler(50) + " " + items[i][1].split(". ")[0] + " " + filler(90)) for i in range(10)]  # the question alone
    docs += [(300, None), (301, ""), (None, items[0][1]), (302, "x " * 60000 + items[3][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.leaks(df.selectExpr("*", "1 as item_id", "2 as score"), bench).collect()}
    assert got == {(i, i) for i in range(40)} | {(None, 0), (302, 3)}
    assert d.leaks(df.limit(0), bench).count() == 0 and d.leaks(df, bench.limit(0)).count() == 0
    # An item without an id is found as such.
    assert {(r.doc_id, r.item_id) for r in d.leaks(df, bench.limit(1).selectExpr("cast(null as long) as item_id", "text")).collect()} == {(0, None), (None, None)}
    # An index of few items at a time finds the same.
    assert {(r.doc_id, r.item_id) for r in d.leaks(df, bench, index_items=7).collect()} == got


@pytest.mark.parametrize("least, at_once", [(3.0, 500_000), (0.4, 60), (1.5, 7), (9.0, 500)])
def test_search_is_exact(least, at_once):
    rng = np.random.default_rng(6)
    n_items, vocabulary = 90, 60
    pairs = sorted({(int(t), int(i)) for t, i in zip(rng.integers(0, vocabulary, 1500) ** 2 // vocabulary, rng.integers(0, n_items, 1500))})
    term, item = (np.array(x) for x in zip(*pairs))
    impact = rng.random(len(pairs)) ** 3
    index = d.Index.build(list(range(n_items)), d.Lists.of([]), d.Lists.of([]), term.astype(np.uint64), item, impact, 8)
    windows = np.sort(rng.choice(50 * vocabulary, 900, replace=False))
    at = {t: k for k, t in enumerate(index.terms.tolist())}
    asked = [(w, t) for w, t in zip((windows // vocabulary).tolist(), (windows % vocabulary).tolist()) if t in at]
    want = Counter()
    for w, t in asked:
        for i, x in zip(item[term == t].tolist(), impact[term == t].tolist()):
            want[w, i] += x
    got = {(w, i): s for w, i, s in index.search(np.array([w for w, _ in asked]), np.array([at[t] for _, t in asked]), least, at_once)}
    assert got.keys() == {k for k, s in want.items() if s >= least}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_tables(spark):
    items = {r.item_id: f" {' '.join(r.text.lower().encode().translate(d._TO_SPACE).decode().split())} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: f" {' '.join(r.text.lower().encode().translate(d._TO_SPACE).decode().split())} " for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, j) for i, t in docs.items() for j, x in items.items() if x in t}
    assert {(r.doc_id, r.item_id) for r in d.op6_decontaminate(spark, SF).collect()} == want
