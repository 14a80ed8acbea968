"""Operator 12 against plain counting with Python integers."""

import random
import re
from collections import Counter, defaultdict

from mnemograph.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, item string, value double"


def brute(rows, least=3, top=200):
    """Sorted (lang, source, part, item, value, rank) of rows (text, lang, source)."""
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        peers = [s for g, s in groups if g == lang]
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (total(c) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        own = share(counts[lang, source])
        pairs = [(s, sum(f(own[t], q) for t, q in share(counts[lang, s]).items())) for s in peers if s != source]
        whole = share(sum((counts[lang, s] for s in peers), Counter()))
        terms = [(t, f(own[t], whole[t])) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, n) for n, (item, value) in enumerate(order, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, *r, "x", 0.5) for i, r in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, divergence.audit(df, **more).collect()))


def words(rng, n):
    return " ".join(rng.choice("The the quick Brown fox über ÜBER naïve 日本 a1b x-y z_z Ω ω dog".split()) for _ in range(n))


def test_random(spark):
    rng = random.Random(1)
    rows = [(words(rng, rng.randrange(40)), rng.choice(["en", "de", "EN"]), rng.choice(["s1", "s2", "s3", "ü"])) for _ in range(300)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, top=2) == brute(rows, top=2)


def test_runs_are_merged(spark):
    rng = random.Random(2)
    rows = [(words(rng, 12), "en", f"s{i % 3}") for i in range(200)]
    terms, groups = divergence.kept_terms(spark.createDataFrame([(i, *r, "x", 0.5) for i, r in enumerate(rows)], SCHEMA), most_bytes=1500)
    counts = Counter(w for t, _, _ in rows for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    assert {r.term: sum(r.counts) for r in terms.collect()} == {t: n for t, n in counts.items()}
    assert groups.count() == 3


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "s1"), ("123 --", "en", None), ("alpha beta", None, "s2"), ("alpha", None, "s2"), ("alpha", None, "s2"), ("once", "fr", "alone"), ("w " * 200_000, "en", "s1"), ("w", "en", "s2"), ("w", "en", "s2"), ("é" * 100_000, "en", "s3")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, None, None)] * 3) == []
    assert run(spark, []) == []


def test_many_sources(spark):
    rng = random.Random(5)
    rows = [(words(rng, 6), "en", f"s{rng.randrange(90)}") for _ in range(400)]
    assert run(spark, rows) == brute(rows)


def test_sources_alike_differ_by_nothing(spark):
    rows = [("one two three two", "en", s) for s in "ab" for _ in range(5)]
    assert [r for r in run(spark, rows) if r[2] == "pair"] == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
