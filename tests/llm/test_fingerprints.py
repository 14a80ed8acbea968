"""Operator 13 against plain comparison of texts."""

import hashlib
import random

import numpy as np

from mnemograph.llm import fingerprints as fp


def some(rng, n):
    return "".join(rng.choice("abcdefgh ijklm nopq 日本é𝄞") for _ in range(n))


def brute(rows):
    """Sorted (doc_id, n_chars, edited_sha256) of rows (doc_id, text) with distinct ids."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for n, (i, text) in enumerate(order):
        part = len(text) // 4
        new = text[: len(text) - part] + order[(n + 1) % len(order)][1][:part]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, h string")
    return fp.fingerprints(df).collect()


def test_spans_and_extensions():
    rng = random.Random(1)
    a, b = some(rng, 400), some(rng, 300)
    b = b[:50] + a[120:260] + b[50:]
    p, q = fp.Prefixes(a), fp.Prefixes(b)
    for _ in range(300):
        i, j, n = rng.randrange(350), rng.randrange(350), rng.randrange(1, 40)
        assert (p.span(i, i + n) == q.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert p.extension(i, q, j) == want
    assert p.extension(120, q, 50) >= 140


def test_query_rows(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 501, some(rng, rng.choice([0, 1, 3, 7, 8, 40, 300, 3000]))) for i in range(300)]
    rows += [(9000, None), (9001, ""), (9002, "x" * 500_000), (9003, rows[5][1]), (None, "no id, but a text of some length")]
    got = run(spark, rows)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    texts = dict(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.fingerprint == fp.fingerprint(texts[r.doc_id] or "").text()
    assert len({(r.fingerprint) for r in got}) == len({t or "" for _, t in rows})


def test_repeated_ids_and_small_tables(spark):
    rows = [(1, "one text"), (1, "another text"), (1, "one text"), (2, "last of all")]
    got = run(spark, rows)
    assert len(got) == 4 and sorted(r.n_chars for r in got) == [8, 8, 11, 12]
    assert {r.fingerprint for r in got} == {fp.fingerprint(t).text() for _, t in rows}
    alone = run(spark, [(5, "abcdefgh")])
    assert [(r.edited_sha256, r.near_next) for r in alone] == [(hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    assert run(spark, []) == []


def test_every_row_meets_its_next_across_ranges(spark):
    rows = [(i, f"text number {i} of many") for i in range(997)]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in run(spark, rows)), key=str) == brute(rows)


def test_likeness():
    rng = random.Random(3)
    near = lambda x, y: fp.likeness(fp.parsed(fp.fingerprint(x).text()), fp.parsed(fp.fingerprint(y).text()))
    for n in (40, 400, 4000, 60_000):
        a, b = some(rng, n), some(rng, n)
        assert near(a, a) == 1 and near(a, b) < 0.3 and near(b, a) < 0.3
        assert 0.4 < near(a, fp.edited(a, b)) < 0.85  # three quarters of the text: 0.6 by length
        assert near(a, "some words before " + a) > 0.5
        assert near(a, a[: n // 3] + "#" + a[n // 3 :]) > 0.75
    assert near("", "") == 1 and near("", "a") == near("a", "") == 0 and near("a", "b") == 0
    assert near("a" * 1000, "a" * 1001) < 1 and near("abc" * 1000, "abc" * 1000) == 1


def test_cuts_are_bounded_and_nested():
    rng = random.Random(4)
    for text in (some(rng, 5000), "ab" * 4000, "a" * 3000, " ".join(["word"] * 900) + some(rng, 200)):
        f = fp.fingerprint(text)
        assert len(f.places) <= fp.CUTS + 1 and f.places[-1] == len(text)
        fine = fp.fingerprint(text, 5000)
        assert set(f.places.tolist()) == set(fine.places[fine.levels >= f.level].tolist())
        assert (fp.parsed(f.text()).hashes == f.hashes).all() and np.all(np.diff(f.places) > 0)
