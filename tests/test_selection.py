"""Selections, bundles cut down to them, and what is known at a step, against plain loops."""

import random

from mnemograph.operators import selection, temporal

REQUEST = "request_id string, root string, mode string, include array<string>, exclude array<string>, scope_mode string, abouts array<string>, scope_ids array<string>"


def passes(rule, dimension, scope_id):
    _, root, mode, include, exclude, scope_mode, abouts, scope_ids = rule
    parts = (scope_id or "").split(":dimension:", 1)
    about, own = (parts[0][6:], parts[1]) if len(parts) == 2 and parts[0].startswith("about:") else (None, None)
    if mode == "only" and dimension not in include or mode == "except" and dimension in exclude:
        return False
    if scope_mode != "all" and about not in ([root] if scope_mode in (None, "current") else abouts or []):
        return False
    return not scope_ids or scope_id in scope_ids or own in scope_ids


def test_bundles(spark):
    rng = random.Random(3)
    rules, nodes, edges = [], [], []
    for i in range(40):
        r, kinds = f"r{i}", ["x", "y", "z"]
        mode = rng.choice(["all", "only", "except", None])
        rules.append((r, r, mode, rng.sample(kinds, 2) if mode == "only" else [], rng.sample(kinds, 1) if mode == "except" else None, rng.choice(["current", "all", "abouts", None]), ["other", r][: rng.randrange(3)], rng.choice([None, [], ["x"], [f"about:{r}:dimension:y"]])))
        nodes.append((r, r, "memory_anchor"))
        for e in range(8):
            d = rng.choice(kinds)
            scope = rng.choice([f"about:{r}:dimension:{d}", f"about:other:dimension:{d}", "loose"])
            nodes += [(r, f"e{e}", "entry"), (r, f"p{e}", rng.choice(["evidence", "memory_evidence", "note"])), (r, scope, "memory_dimension")]
            edges += [(r, scope, f"e{e}", "contains_entry", d, scope), (r, f"p{e}", f"e{e}", "supports", None, None), (r, r, f"e{e}", "records", None, None)]
    details = [(r, n) for r, n, _ in nodes]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = selection.selected(df(nodes, "request_id string, node_id string, node_kind string"), df(edges, "request_id string, source string, target string, relation_type string, dimension string, scope_id string"), df(details, "request_id string, node_id string"), df(rules, REQUEST))
    want_nodes, want_edges = [], []
    for rule in rules:
        mine = [e for e in edges if e[0] == rule[0]]
        coordinates = [e for e in mine if e[3] == "contains_entry" and passes(rule, e[4], e[5])]
        entries, kept = {e[2] for e in coordinates}, {rule[1]} | {x for e in coordinates for x in e[1:3]}
        kinds = {n: k for r, n, k in nodes if r == rule[0]}
        kept |= {e[1] for e in mine if e[3] == "supports" and e[2] in entries and kinds[e[1]] != "note"}
        want_nodes += [n for n in nodes if n[0] == rule[0] and n[1] in kept]
        want_edges += coordinates + [e for e in mine if e[3] != "contains_entry" and {e[1], e[2]} <= kept]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got["nodes"].collect()) == order(want_nodes)
    assert order(got["edges"].select("request_id", "source", "target", "relation_type", "dimension", "scope_id").collect()) == order(want_edges)
    assert order(got["details"].collect()) == order((r, n) for r, n, _ in want_nodes)


def test_faults(spark):
    rows = [("a", "a", None, None, None, None, None, None), ("b", "b", "only", ["x"], ["y"], "abouts", [" "], []), ("c", "c", "odd", [], [], "odd", [], [])]
    got = {r.request_id: r.faults for r in selection.faults(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got == {"a": [], "b": ["only must not set exclude", "abouts requires abouts"], "c": ["unknown mode", "unknown scope mode"]}


def test_known_and_leaks(spark):
    rng = random.Random(4)
    steps = [(rng.choice("ab"), rng.randrange(12), rng.randrange(15)) for _ in range(60)]
    seen = [(rng.choice("abc"), rng.randrange(14), rng.randrange(18)) for _ in range(80)]
    gold = [(rng.choice("ab"), rng.randrange(12), rng.randrange(15)) for _ in range(30)]
    df = lambda rows: spark.createDataFrame(rows, "task string, step long, ref_id long")
    known = lambda t, s: {r for a, b, r in steps if a == t and b < s}
    assert sorted(map(tuple, temporal.known_at(df(steps)).collect())) == sorted({(t, s, len(known(t, s))) for t, s, _ in steps})
    want = []
    for t, s in {(t, s) for t, s, _ in steps + seen}:
        ok, got = known(t, s), {r for a, b, r in seen if (a, b) == (t, s)}
        if ok or got:
            want.append((t, s, len(got - ok), len(ok - got), bool(got & {r for a, b, r in gold if (a, b) == (t, s)}), not got - ok))
    assert sorted(map(tuple, temporal.leak_check(df(steps), df(seen), df(gold)).collect())) == sorted(want)


def test_facts_as_of(spark):
    rng = random.Random(5)
    facts = [(rng.choice("ab"), rng.randrange(10), i) for i in range(25)]
    asks = [(f"q{i}", rng.choice("abc"), rng.randrange(12)) for i in range(20)]
    got = temporal.as_of(spark.createDataFrame(facts, "key string, at long, ref long"), spark.createDataFrame(asks, "request_id string, key string, at long"))
    want = [(q, k, t, max(((at, r) for key, at, r in facts if key == k and at < t), default=(0, None))[1]) for q, k, t in asks]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
