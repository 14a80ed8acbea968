"""Operator 7 on planted notices and against a plain search."""

import random
import textwrap
import time

from mnemograph.llm import licences

SF = "/root/testdata/sf0.001"


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as licences")
    return {r.doc_id: (r.licences, r.sentences) for r in licences.licence_scan(df).collect()}


def test_notices(spark):
    s = licences.SENTENCES
    cut = s["mit-grant"].index(" ", 90)
    mit = f"# {s['mit-grant'][:cut]}\n# {s['mit-grant'][cut:]}\n\n{s['mit-notice']}"
    got = found(
        spark,
        f"words before\n{mit}\nwords behind",
        f"{s['mit-notice']}\n{s['mit-grant']}",  # the wrong order
        "\n".join(s[x] for x in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
        "\n".join(s[x] for x in ("bsd-redistribution", "bsd-source", "bsd-binary")),
        "RELEASED   under the mit licence. Released under the\nMIT License. All rights reserved.",
        "no licence here",
        None,
        "",
        s["apache2-header"] + "\n" + "a b c.\n" * 9 + s["apache2-use"] + "\n" + s["apache2-copy"],  # too far apart
        "word. " * 50000 + s["gpl3-work"],
    )
    assert {k: v[0] for k, v in got.items()} == {0: "MIT", 1: "", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "MIT,Proprietary", 8: "", 9: "GPL-3.0"}
    assert got[1][1] == "mit-notice,mit-grant"


def test_tables(spark):
    singles = {licences.normal(licences.SENTENCES[rule[0]]): name for name, rule in licences.RULES if len(rule) == 1}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        names = sorted({singles[u] for u in map(licences.normal, licences._CUT.split(r.text)) if u in singles})
        if names:
            want[r.doc_id] = ",".join(names)
    got = {r.doc_id: r.licences for r in licences.op7_licences(spark, SF).collect()}
    assert got == want and want
    assert licences.licence_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_notice_in_narrow_columns(spark):
    s = licences.SENTENCES
    wrapped = lambda n: "\n".join(f"# {line}" for x in ("mit-grant", "mit-notice") for line in textwrap.wrap(s[x], n))
    assert {k: v[0] for k, v in found(spark, *(wrapped(n) for n in (80, 38, 34, 20))).items()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT"}


def test_common_licences(spark):
    """Every rule's own sentences, wrapped, are read as its licence."""
    s = licences.SENTENCES
    texts = ["words\n" + "\n".join(textwrap.fill(s[x], 70) for x in rule) + "\nwords" for _, rule in licences.RULES]
    got = found(spark, *texts)
    assert [(name, rule) for i, (name, rule) in enumerate(licences.RULES) if name not in got[i][0].split(",")] == []
    assert {"LGPL-2.1", "AGPL-3.0", "GPL-2.0", "ISC", "Unlicense", "BSL-1.0", "EPL-2.0", "Zlib"} <= {n for n, _ in licences.RULES}


def test_rules_by_brute_force():
    """Licences of random sequences against every rule at every place and every pair of spans."""
    rng = random.Random(9)
    rules = (("A", ("a",)), ("B", ("a", "b")), ("C", ("b", "c", "b")), ("D", ("c",)), ("E", ("a", "b", "c")), ("F", ("c", "c")))
    known = licences.Recogniser({k: f"{k} word" for k in "abc"}, rules, gap=2)
    for _ in range(500):
        sequence, at = [], 0
        for _ in range(rng.randrange(12)):
            at += rng.choice((1, 1, 2, 4))
            end = at + rng.randrange(2)
            sequence.append((at, end, rng.choice("abc")))
            at = end
        met = set()
        for name, rule in rules:
            for i, (first, end, x) in enumerate(sequence):
                if x != rule[0]:
                    continue
                k = i
                for step in rule[1:]:
                    later = [m for m in range(k + 1, len(sequence)) if sequence[m][2] == step]
                    if not later or sequence[later[0]][0] - end > 3:
                        break
                    k, end = later[0], sequence[later[0]][1]
                else:
                    met.add((name, first, end))
        want = {m for m in met if not any(o[1] <= m[1] and m[2] <= o[2] and o[2] - o[1] > m[2] - m[1] for o in met)}
        got = known.licences(sequence)
        assert set(got) == want and len(got) == len(want)


def test_repeated_notices_take_linear_time():
    s = licences.SENTENCES
    text = "\n".join(s[x] for x in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")) + "\n"
    known, start = licences.Recogniser(), time.monotonic()
    found = known.licences(known.sequence(text * 12_500))
    assert len(found) == 12_500 and time.monotonic() - start < 30


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License."), (1, "All rights reserved."), (1, "All rights reserved.")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.licences) for r in licences.licence_scan(df).collect()) == [("1", "Proprietary"), ("1", "Proprietary"), ("None", "MIT")]
