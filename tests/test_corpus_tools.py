"""JSON leaves, stable orders, held-out groups, cross-tabs and bundle differences against plain loops."""

import json
import random

from pyspark.sql import functions as F

from mnemograph.operators import evaluate, leaves, splits


def plain_leaves(value):
    out = []

    def walk(v):
        if isinstance(v, str):
            t = v.strip(" ").strip('"').strip(" ")
            while t.startswith("Answer:"):
                t = t[7:]
            t = t.strip(" ").rstrip(".").strip(" ")
            t = t.split("Confidence:")[0].strip(" ") if "Confidence:" in t else t
            if t not in ("", "-", "N/A"):
                out.append(t)
        elif isinstance(v, bool) or v is None:
            pass
        elif isinstance(v, (int, float)):
            out.append(json.dumps(v))
        elif isinstance(v, list):
            [walk(x) for x in v]
        else:
            [walk(v[k]) for k in sorted(v)]

    walk(value)
    return list(dict.fromkeys(out))


def test_leaves_of_any_json(spark):
    rng = random.Random(6)

    def some(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 2:
            return rng.choice(["a", " b ", "", "-", "N/A", 'Answer: "c".', "d Confidence: 3", "é"])
        if kind == 2:
            return rng.choice([1, -5, 2.5, 100])
        if kind < 5:
            return rng.choice([None, True, False, "x"])
        if kind == 5:
            return [some(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcdefgh"): some(depth - 1) for _ in range(rng.randrange(4))}

    values = [some(5) for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "no json"), (901, None), (902, "{}")], "id long, json string")
    got = {}
    for r in sorted(leaves.meaningful(df).collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.leaf)
    assert got == {i: x for i, v in enumerate(values) if (x := plain_leaves(v))}


def test_property_text(spark):
    df = spark.createDataFrame([("null",), ('"a b"',), ("1.5",), ("true",), ('{"b": [1], "a": null}',)], "j string")
    assert [r.t for r in df.select(leaves.property_text(F.parse_json("j")).alias("t")).collect()] == ["", "a b", "1.5", "true", '{"a":null,"b":[1]}']


def fnv(text, seed):
    state = (0xCBF29CE484222325 ^ seed) % 2**64
    for byte in text.encode():
        state = (state ^ byte) * 0x100000001B3 % 2**64
    return state


def test_stable_order(spark):
    rng = random.Random(7)
    data = [(rng.choice("xy"), json.dumps("w" * rng.randrange(30) + rng.choice("éab"))) for _ in range(200)] + [("x", '""'), ("x", "")]
    assert splits.fnv1a([t.encode() for _, t in data], 99).tolist() == [fnv(t, 99) for _, t in data]
    got = splits.shuffled(spark.createDataFrame(data, "g string, t string"), F.col("t"), 99, ["g"]).collect()
    for g in "xy":
        assert [r.t for r in sorted(got, key=lambda r: r.place) if r.g == g] == sorted((t for h, t in data if h == g), key=lambda t: (fnv(t, 99), t))


def test_covering_groups(spark):
    rng = random.Random(8)
    for n in (3, 40):
        rows = [(f"g{rng.randrange(n)}", rng.choice(["a", "b", "c", "rare" if rng.random() < 0.2 else "a"])) for _ in range(n * 6)]
        need, least, train = ["a", "rare", "c"], 5, 2
        count = lambda gs, c: sum(1 for g, k in rows if k == c and g in gs)
        every, chosen = sorted({g for g, _ in rows}), []
        while any(count(chosen, c) < least for c in need):
            options = []
            for g in every:
                if g not in chosen and all(count(every, c) - count([*chosen, g], c) >= train for c in need):
                    gain = {c: min(count([g], c), least - count(chosen, c)) for c in need if count(chosen, c) < least}
                    if sum(gain.values()) > 0:
                        options.append((-sum(gain.values()), -sum(v > 0 for v in gain.values()), sum(1 for h, _ in rows if h == g), fnv(json.dumps(g), 3), g))
            if not options:
                break
            chosen.append(min(options)[-1])
        got, held = splits.covering_groups(spark.createDataFrame(rows, "group string, capability string"), need, least, train, 3)
        assert [r.group for r in got.orderBy("round").collect()] == chosen
        assert held == {c: count(chosen, c) for c in need}


def test_differences(spark):
    a = [("n", 1), ("n", 1), ("m", None), ("k", 2)]
    b = [("n", 1), ("m", None), ("k", 3)]
    df = lambda rows: spark.createDataFrame(rows, "k string, v long")
    assert sorted(map(tuple, evaluate.differences(df(a), df(b)).collect())) == [("k", 2, 1), ("k", 3, -1), ("n", 1, 1)]
    assert evaluate.differences(df(a), df(a[::-1])).isEmpty()


def test_cross_tabs_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("x", "p", True), (None, "p", False), (None, "q", True)], "a string, b string, hit boolean")
    got = sorted(map(str, map(tuple, evaluate.cross_tabs(rows, [["a"], ["a", "b"], []], ["hit"]).collect())))
    assert got == sorted(map(str, [("a", None, None, 2, 1), ("a", "x", None, 1, 1), ("a,b", None, "p", 1, 0), ("a,b", None, "q", 1, 1), ("a,b", "x", "p", 1, 1), ("", None, None, 3, 2)]))
