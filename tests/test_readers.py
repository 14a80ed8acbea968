"""Fragments, snippets, relations, prompts, exact answers, labelled answers, limits and coverage, against plain loops."""

import json
import random
import re

from pyspark.sql import functions as F

from mnemograph.operators import interpret, readers

TURN = "^turn:[0-9]+$"


def some_content(rng):
    ref = lambda: rng.choice(["turn:1", "turn:2", "x", "a b", None])
    text = lambda: rng.choice(["one", " one ", "two", "", "  ", None])
    evidence = [{"id": ref(), "text": text(), "source": rng.choice([None, "s1", "s2"]), "supports": rng.choice([None, [], ["x", "turn:2"], ["turn:1", "turn:2", "turn:1"]])} for _ in range(rng.randrange(5))]
    path = [{"from": ref(), "to": ref(), "rel": rng.choice(["supports", "supports_answer", "Records", "total-of", "follows", None]), "class": rng.choice(["structural", "evidential", None]), "why": rng.choice([None, "w", "long " * 90]), "evidence": text(), "confidence": rng.choice([None, "high"]), "sequence": rng.choice([None, 3])} for _ in range(rng.randrange(6))]
    because = [{"claim": rng.choice([None, "c"]), "ref": ref(), "evidence": text()} for _ in range(rng.randrange(4))]
    whole = {"proof": {"evidence": evidence, "path": path}, "because": because}
    if rng.random() < 0.2:
        del whole["proof"]["path"]
    if rng.random() < 0.1:
        del whole["because"]
    return whole


def answers(spark, contents):
    rows = [(f"r{i}", f"q{i}", "what?", json.dumps(c) if c is not None else None) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "request_id string, question_ref string, question string, json string").withColumn("content", readers.content(F.col("json"))).drop("json")


def first(*xs):
    return next((x for x in xs if x is not None), None)


def is_turn(x):
    return x is not None and re.match(TURN, x) is not None


def plain_fragments(i, c, turns):
    out = [(f"q{i}", "what?", None)]
    for e in c["proof"]["evidence"]:
        refs = [s for s in e["supports"] or [] if is_turn(s)] if turns else []
        for r in refs or [first(e["id"], e["source"], "proof:evidence")]:
            out.append((r, e["text"], e["source"]))
    if turns:
        out += [(p["from"], p["evidence"], None) for p in c["proof"].get("path", []) if p["rel"] in ("supports", "supports_answer") and is_turn(p["from"])]
    for b in c.get("because", []):
        if not turns or is_turn(b["ref"]):
            out.append((first(b["ref"], "because:evidence"), b["evidence"], None))
    kept = {}
    for r, t, s in out:
        t = t.strip() if turns and t is not None else t
        if t is not None and (t or not turns):
            kept.setdefault((r, t), s)
    return [(f"r{i}", r, t, s) for (r, t), s in kept.items()]


def test_fragments(spark):
    rng = random.Random(1)
    contents = [some_content(rng) for _ in range(60)]
    df = answers(spark, contents)
    for turn in (None, TURN):
        got = {}
        for r in sorted(readers.fragments(df, turn).collect(), key=lambda r: r.ord):
            got.setdefault(r.request_id, []).append((r.request_id, r.ref_id, r.text, r.source))
        assert got == {f"r{i}": plain_fragments(i, c, turn is not None) for i, c in enumerate(contents)}
    none = readers.fragments(answers(spark, [None, {}])).collect()
    assert sorted((r.request_id, r.ref_id) for r in none) == [("r0", "q0"), ("r1", "q1")]
    assert readers.fragments(df.limit(0)).count() == 0


def plain_snippets(i, c):
    real = lambda x: x is not None and x.startswith("turn:") and " " not in x
    out = []
    for e in c["proof"]["evidence"]:
        out.append((first(next((s for s in e["supports"] or [] if real(s)), None), e["id"], "proof:evidence"), e["text"], e["source"], None, "proof_evidence", None))
    for p in c["proof"].get("path", []):
        out.append((first(p["from"] if real(p["from"]) else None, p["to"] if real(p["to"]) else None, "proof:path"), p["evidence"], None, p["sequence"], p["rel"], p["why"]))
    for b in c.get("because", []):
        out.append((first(b["ref"], b["claim"], "because:evidence"), b["evidence"], None, None, "because", b["claim"]))
    kept = {}
    for r, t, *rest in out:
        if t is not None and t.strip():
            old = kept.setdefault((r, t.strip()), rest)
            kept[r, t.strip()] = [first(a, b) for a, b in zip(old, rest)]
    return {(f"r{i}", r, t, *rest) for (r, t), rest in kept.items()}


def test_snippets(spark):
    rng = random.Random(2)
    contents = [some_content(rng) for _ in range(60)]
    got = {tuple(r) for r in readers.snippets(answers(spark, contents), "^turn:").collect()}
    assert got == set().union(*(plain_snippets(i, c) for i, c in enumerate(contents)))


def test_relation_context(spark):
    rng = random.Random(3)
    contents = [some_content(rng) for _ in range(60)] + [{"proof": {"evidence": [], "path": [{"from": f"turn:{k}", "to": "x", "rel": "corrects"} for k in range(100)]}}]
    focus = [(f"r{i}", "turn:1") for i in range(0, 60, 2)] + [("r1", "nowhere"), ("other", "x")]
    near = {f"r{i}": {f for r, f in focus if r == f"r{i}"} for i in range(61)}
    got = {r.request_id: r for r in readers.relation_context(answers(spark, contents), spark.createDataFrame(focus, "request_id string, ref_id string"), 5).collect()}
    assert len(got) == 61
    for i, c in enumerate(contents):
        path, r = c["proof"].get("path"), got[f"r{i}"]
        if path is None:
            assert r.total is None and r.summary is None
            continue
        structural = [p for p in path if p.get("class") == "structural" or p["rel"] == "Records"]
        rest = [p for p in path if p not in structural]
        rich = [p for p in rest if p["rel"] in ("total-of", "corrects")]
        assert (r.total, r.structural, r.support_only, r.rich) == (len(path), len(structural), sum(p["rel"] in ("supports", "supports_answer") for p in rest), len(rich))
        shown = [p for p in rich if not near[f"r{i}"] or {p["from"], p["to"]} & near[f"r{i}"]][:5]
        lines = [x for x in r.summary.split("\n") if x.startswith("- rel=")]
        assert [re.search("rel=(.*?) class", x)[1] for x in lines] == [p["rel"] for p in shown]
        assert [re.search(" from=(.*?) to=", x)[1] for x in lines] == [p["from"] or "unknown" for p in shown]
        assert all(len(x.split(" why=")[1]) <= 323 for x in lines)
        assert ("No rich operand" in r.summary) == (not rich) and ("none directly touch" in r.summary) == bool(rich and not shown)


def test_prompts(spark):
    rows = [("a", 1, "How many dollars did I spend?", "no", "user"), ("a", 2, "How many dollars did I spend?", "It COST $5", "assistant"), ("a", 3, "How many dollars did I spend?", "3 cats", "User"), ("b", 1, "Who?", "none", "user"), ("b", 2, "Who?", " spent 1", None), ("c", 1, None, None, None)]
    got = {(r.request_id, r.rank): (r.priority, r.place) for r in readers.prompt_order(spark.createDataFrame(rows, "request_id string, rank int, question string, text string, role string")).collect()}
    assert got == {("a", 1): (50, 3), ("a", 2): (90, 1), ("a", 3): (80, 2), ("b", 1): (0, 2), ("b", 2): (40, 1), ("c", 1): (0, 1)}


def plain_exact(text):
    def tidy(x):
        x = re.sub('^"+|"+$', "", x.strip()).strip()
        x = re.sub(r"\.+$", "", re.sub("^(Answer:)+", "", x).strip()).strip()
        return x.split("Confidence:")[0].strip() if "Confidence:" in x else x

    out, waiting = [], False
    for line in text.split("\n"):
        line = re.sub("[*`]", "", line.strip().lstrip("-* ")).strip()
        if waiting:
            if line:
                out.append(tidy(line))
                waiting = False
            continue
        at = line.lower().find("exact answer:")
        if at >= 0:
            said = line[at + 13 :].strip()
            if said:
                out.append(tidy(said))
            else:
                waiting = True
    return list(dict.fromkeys(x for x in out if x))


def test_exact_answers(spark):
    rng = random.Random(4)
    lines = ["Exact answer:", "- **Exact Answer:** `x y`.", "", "   ", "text", "* Exact answer: \"z\" Confidence: 90%", "so exact answer: .", "Exact answer: z"]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(200)] + [(900, None), (901, ""), (902, "\n".join(["Exact answer:"] * 7))]
    got = {}
    for r in sorted(readers.exact_answers(spark.createDataFrame(texts, "id long, text string")).collect(), key=lambda r: r.place):
        got.setdefault(r.id, []).append(r.answer)
    assert got == {i: a for i, t in texts if t is not None and (a := plain_exact(t))}


def test_labelled_answers(spark):
    q = [("sum", "how much?", " SUM ", "USD"), ("count", "How many different shops?", "count", None), ("all", "how many shops?", "count", "shops"), ("avg", "", "average", "km"), ("days", "how long?", "difference", "days"), ("diff", "how much less?", "difference", "USD"), ("max", "", "argmax", None), ("list", "", "list", None), ("odd", "", "median", None), ("none", "", "sum", None), ("zero", "", "count", None), ("idk", "", "unknown", None), ("bad", "", "sum", None), ("blank", "", "average", None), ("two", "", "difference", None), ("noname", "", "max_by", None)]
    o = [("sum", 1, "include", None, None, 2.5), ("sum", 2, " Include", None, None, 1.25), ("sum", 3, "exclude", None, None, None), ("sum", 4, "context", None, None, None)]
    for r in ("count", "all"):
        o += [(r, 1, "include", None, "The Shop", 1.0), (r, 2, "include", None, "shop", None), (r, 3, "include", None, "Bar", 3.0), (r, 4, "include", None, "bar", 3.0), (r, 5, "include", None, " ", None)]
    o += [("avg", 1, "include", None, None, 1.0), ("avg", 2, "include", None, None, 2.0), ("avg", 3, "include", None, None, 2.0)]
    for r in ("days", "diff"):
        o += [(r, 1, "include", "Minuend", None, 3.0), (r, 2, "include", "subtrahend", None, 10.0), (r, 3, "include", None, None, 1.0)]
    o += [("max", 1, "include", None, "a", 5.0), ("max", 2, "include", None, " b ", 5.0), ("max", 3, "include", None, "c", None), ("list", 2, "include", None, "y", None), ("list", 1, "include", None, "x", None), ("list", 3, "exclude", None, "z", None)]
    o += [("bad", 1, "maybe", None, None, 1.0), ("blank", 1, "include", None, None, None), ("two", 1, "include", "minuend", None, 1.0), ("noname", 1, "include", None, None, 1.0)]
    got = {r.request_id: (r.answer, r.error) for r in readers.labelled_answers(spark.createDataFrame(q, "request_id string, question string, operation string, unit string"), spark.createDataFrame(o, "request_id string, ord long, label string, role string, entity string, value double")).collect()}
    assert got == {
        "sum": ("$3.75", None), "count": ("8: The Shop, Bar", None), "all": ("9 shops: The Shop, Bar", None), "avg": ("1.6667 km", None), "days": ("7 days", None), "diff": ("$-7", None), "max": ("b", None), "list": ("x, y", None),
        "odd": (None, "unsupported operation"), "none": (None, "no included operand"), "zero": ("0", None), "idk": ("UNKNOWN", None), "bad": (None, "unsupported label"), "blank": (None, "an included operand has no value"), "two": (None, "not one minuend and one subtrahend"), "noname": (None, "the largest has no name"),
    }


NEAR = {"around": {"ref": "x"}, "limit": {"entries": 64, "tokens": 16000}}
CALLS = [
    ("kernel_wake", {"about": "a"}, True), ("kernel_wake", {"about": ""}, False), ("kernel_wake", {"about": "a", "depth": 9}, False), ("kernel_wake", {"about": "a", "depth": "9"}, True),
    ("kernel_near", NEAR, True), ("kernel_near", NEAR | {"around": {"ref": "x", "time": None}}, False), ("kernel_near", NEAR | {"around": {"sequence": 2}}, True), ("kernel_near", NEAR | {"around": {"sequence": 0}}, False), ("kernel_near", NEAR | {"limit": {"entries": 65, "tokens": 1}}, False), ("kernel_near", NEAR | {"limit": {"tokens": 1}}, False), ("kernel_near", NEAR | {"around": "x"}, False),
    ("kernel_trace", {"from": "", "to": "b", "budget": {"tokens": 1}}, True), ("kernel_trace", {"from": "a", "to": "b"}, False), ("kernel_trace", {"from": "a", "to": "b", "budget": {"tokens": 1}, "page": {"entries": 257}}, False),
    ("kernel_inspect", {"ref": "a", "include": {"raw": False}}, True), ("kernel_inspect", {"ref": "a"}, False), ("kernel_inspect", {"ref": "a", "include": {"raw": True}}, False),
    ("kernel_goto", {"at": {"time": "t"}}, True), ("kernel_goto", {"from": {"time": "t"}}, False), ("kernel_rewind", {"from": {"ref": "t"}, "limit": {"tokens": 16001}}, False), ("kernel_forward", {"from": {"ref": "t"}}, True),
    ("kernel_ask", {}, True), ("kernel_ask", {"budget": {"tokens": 16001}}, False), ("kernel_ask", [], False), ("other", {}, False), (None, {}, False),
    ("kernel_write_memory", {"options": {"strict": True, "dry_run": False}, "connect_to": [1]}, True), ("kernel_write_memory", {"options": {"strict": True, "dry_run": False}, "connect_to": []}, False), ("kernel_write_memory", {"options": {"strict": True}, "connect_to": [1]}, False), ("kernel_write_memory", {"options": {"strict": True, "dry_run": False}, "connect_to": [1] * 33}, False),
    ("kernel_ingest", {"dry_run": True, "memory": {"dimensions": [1], "entries": [1], "relations": [], "evidence": []}}, True), ("kernel_ingest", {"dry_run": True, "memory": {"dimensions": [1], "entries": [], "relations": [], "evidence": []}}, False), ("kernel_ingest", {"dry_run": True, "memory": {"dimensions": [1], "entries": [1], "relations": []}}, False),
]


def test_bounded_calls(spark):
    rows = [(i, t, json.dumps(a), w) for i, (t, a, w) in enumerate(CALLS)] + [(98, "kernel_ask", "{", False), (99, "kernel_ask", None, False)]
    got = spark.createDataFrame(rows, "i int, tool string, arguments string, want boolean").withColumn("got", readers.bounded_call(F.col("tool"), F.col("arguments"))).collect()
    assert [r.asDict() for r in got if r.got is not r.want] == []


def test_capabilities(spark):
    call = lambda tool, **arguments: json.dumps({"type": "tool_call", "tool": tool, "arguments": arguments})
    rows = [call("kernel_near", around={"ref": "x", "time": "t"}, limit={"entries": 13}, window={"before_entries": 2}, dimensions={"mode": "only", "scope": "odd"}), call("kernel_goto", at={"sequence": 1}, around={"ref": "x"}), call("kernel_trace", page={"entries": 1}), call("kernel_trace", page={"cursor": "c"}), call("kernel_trace"), call("kernel_inspect", include={"raw": False}), call("kernel_inspect", include={"raw": True}), call("other"), json.dumps({"type": "stop"}), json.dumps({"type": "talk", "tool": "kernel_ask"}), "{", None]
    seen = readers.observed_capabilities(spark.createDataFrame([(r,) for r in rows], "action string"))
    assert {r.capability: r.times for r in seen.collect()} == {"tool:kernel_near": 1, "cursor:ref": 1, "window:expand": 1, "window:shrink": 1, "dimensions.mode:only": 1, "tool:kernel_goto": 1, "cursor:sequence": 1, "tool:kernel_trace": 3, "trace.page:first": 1, "trace.page:continue": 1, "tool:kernel_inspect": 2, "inspect.raw:false": 1, "tool:stop": 1, "window:stop_sufficient": 1}
    required = spark.createDataFrame([(g, c) for g, cs in readers.CAPABILITIES.items() for c in cs], "grp string, capability string")
    got = {r.grp: (r.covered, r.total, r.missing) for r in readers.coverage(required, seen).collect()}
    assert got["cursor"] == (2, 3, ["cursor:time"]) and got["pagination"] == (2, 2, []) and got[None][:2] == (5 + 2 + 1 + 2 + 3 + 1, 24)
    assert [tuple(r) for r in readers.coverage(required.limit(0), seen).collect()] == [(None, 0, 0, 100.0, [])]


def test_metadata_and_checks(spark):
    maps = [{"metadata": '{"a": "1"}'}, {"payload_metadata": '{"b": "2"}', "metadata": '{"a": "1"}'}, {"payload_metadata": "{", "metadata": '{"a": "1"}'}, {"metadata": '{"a": 1}'}, {}, {"source": " ", "payload_source": "p"}, {"payload_source": "p"}, {"source": "s", "payload_source": "p"}, None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    got = df.select("i", readers.memory_metadata(F.col("m")).alias("d"), readers.memory_source(F.col("m")).alias("s")).orderBy("i").collect()
    assert [r.d for r in got] == [{"a": "1"}, {"b": "2"}, {}, {}, {}, {}, {}, {}, {}]
    assert [r.s for r in got] == [None, None, None, None, None, None, "p", "s", None]
    cases = readers.check_scores(df.select("i"), {"low": [F.col("i") < 2, F.col("i") == 0, F.lit(None).cast("boolean")], "none": []})
    assert [round(r.low * 3) for r in cases.orderBy("i").collect()] == [2, 1] + [0] * 7 and cases.columns == ["i", "low"]


def test_questions(spark):
    questions = [("a", "TOTAL cost and how long?"), ("b:1", "the most expensive, the latest"), ("c", "who?"), ("d", "how much more?"), ("e", None), ("f", "sum")]
    texts = [(r, 1, "$5 on 2024-01-03") for r, _ in questions[:4]] + [(r, 2, "$7.50 and $7.50, 2024-02-30, 2024-01-01") for r, _ in questions[:3]] + [("d", 3, "EUR 4"), ("f", 1, "$1")]
    df = interpret.answers_of(spark.createDataFrame(questions, "request_id string, question string"), spark.createDataFrame(texts, "request_id string, ord long, text string"))
    got = {(r.request_id, r.reader): (r.operation, r.operands, r.number, r.answer, r.status) for r in df.collect()}
    assert got[("a", "currency")] == ("sum", 3, 20.0, None, "derived") and got[("a", "date")] == ("difference", 2, 2.0, None, "derived")
    assert got[("b:1", "currency")][2:] == (7.5, "$7.50", "derived") and got[("b:1", "date")][3:] == ("2024-01-03", "derived")
    assert got[("d", "currency")] == ("difference", 2, None, None, "mixed kinds") and got[("f", "currency")] == ("sum", 1, None, None, "too few operands")
    assert {got[(r, k)][4] for r in "ce" for k in ("currency", "date")} == {"not asked"} and len(got) == 12
