"""Operator 1 against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemograph.llm import near_dup


def brute(docs, words=3, share=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = (t or "").translate(low).encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * (both := len(sets[a] & sets[b])) >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_random_groups(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.choice((2, 9, 60, 150)))]
        for _ in range(rng.choice((1, 3, 8))):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(999))
            rows.append((n, " ".join(w)))
            n += 1
    got = near_dup.near_duplicates(docs_of(spark, rows), words=3, share=85)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_chain_whose_hub_is_far(spark):
    """Neighbours in a chain are similar, its ends are not: one component all the same."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(6):
        w = list(words)
        for k in range(step * 4):
            w[k * 3] = f"y{k}"
        rows.append((10 - step, " ".join(w)))
    got = near_dup.near_duplicates(docs_of(spark, rows), words=3, share=85)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_group_of_edited_copies(spark):
    """Replaced, dropped and doubled words, many at the same places: most pairs are near the threshold."""
    rng = random.Random(11)
    base = [f"{rng.choice('abcdef')}{rng.randrange(60)}" for _ in range(90)]
    rows = []
    for i in range(1000):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 5, 6))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + 1] = [[], [w[at], w[at]], [f"x{rng.randrange(9)}"]][kind]
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(docs_of(spark, rows), words=3, share=85, rows=8)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_open_pairs_find_every_link_between_components(spark):
    """Every pair that is linked and lies in different components is returned, with any labels of components."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(160):
        w = list(base)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [w[at], w[at]], [f"x{rng.randrange(3)}"]))
        texts.append(" ".join(w))
    sets = [near_dup.shingle_hashes(t, 3) for t in dict.fromkeys(texts)]
    similar = lambda p, q: 100 * len(set(p) & set(q)) >= 85 * len(set(p) | set(q))
    hub = 0
    part = [0 if similar(s, sets[hub]) else i for i, s in enumerate(sets)]
    rows = [(hub, i, i, len(s), part[i], near_dup._class(sets[hub].tobytes()), near_dup._class(s.tobytes())) for i, s in enumerate(sets)]
    left = spark.createDataFrame(rows, "hub long, node long, doc_id long, n int, part long, class_h binary, class binary")
    known = spark.createDataFrame([(near_dup._class(s.tobytes()), bytearray(s.tobytes())) for s in sets], "class binary, hashes binary")
    got = {tuple(sorted((r.a, r.b))) for r in near_dup._open_pairs(left, known, 85).collect()}
    want = {(j, i) for i, p in enumerate(sets) for j, q in enumerate(sets[:i]) if part[i] != part[j] and similar(p, q)}
    assert want and want <= got
    assert len(got) < len(sets) * (len(sets) - 1) / 4


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (2, "One two"), (1, "one TWO"), (None, "one two"), (7, "É a b"), (8, "é a b")]
    df = docs_of(spark, rows).withColumn("n_shingles", F.lit("clash")).withColumn("kept", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, words=3, share=85).collect()}
    assert got == {5: (0, 5, True), 4: (0, 4, True), 3: (0, 3, True), 2: (1, 1, False), 1: (1, 1, True), None: (1, None, True), 7: (1, 7, True), 8: (1, 8, True)}


def test_repeated_rows_and_empty_table(spark):
    rows = [(2, "a b c d"), (2, "a b c d"), (9, "a b c d"), (2, "e f g h"), (1, "e f g h")]
    got = near_dup.near_duplicates(docs_of(spark, rows), words=3, share=85)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (2, 1), (2, 1), (9, 1)]
    assert near_dup.near_duplicates(docs_of(spark, []), words=3, share=85).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    d = duckdb.connect()
    d.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    want = sorted(d.execute(near_dup.OP1_SQL).fetchall())
    assert sorted(map(tuple, near_dup.op1_near_dup(spark, f"/root/testdata/{sf}").select("doc_id", "n_shingles", "component_id", "kept").collect())) == want
