"""Writers' plans, their provenance and their writes, and ranked candidates, against plain rules."""

import random
import re

from pyspark.sql import functions as F

from mnemograph.kernel import Consumer, Memory
from mnemograph.operators import ingest, writing
from mnemograph.sources import logs

QUALITY = {r: "anemic" if r in ("follows", "answers", "uses_background") else "structural" if r in ("contains", "member_of", "scoped_to") else "rich" for r in writing.CLASSES}


def request(seq, strict=None, dry=None, links=(), reads=(), delta=None, ref=None, **over):
    row = {
        "seq": seq, "about": "a", "intent": "record_turn", "actor": "me", "observed_at": "2024-01-01", "idempotency_key": None, "source_kind": None, "scope": {"process": "p", "task": "t"}, "options": None if strict is None and dry is None else {"strict": strict, "dry_run": dry, "sequence": 4},
        "current": {"ref": ref, "kind": "turn", "summary": "Said so!", "evidence": "heard"}, "read_context": {"inspected_refs": list(reads)}, "connect_to": [dict(zip(("ref", "rel", "class", "why", "evidence", "confidence"), x)) for x in links], "semantic_delta": delta,
    }
    return row | over


def frame(spark, rows):
    return spark.createDataFrame(rows, writing.REQUEST)


def plain_link(x, source, strict, reads, local):
    """(quality, error) of a link."""
    rel = x["rel"].strip().replace("-", "_").replace(" ", "_").lower() if x["rel"] else ""
    rel = {"conflicts": "contradicts"}.get(rel, rel)
    blank = lambda v: not (v or "").strip()
    base, confidence = QUALITY.get(rel, "suspect"), x["confidence"] or "high"
    seen = x["ref"] in local or x["ref"] in reads
    faults = [
        (blank(x["ref"]), "a relation has no target"), (blank(rel), "a relation has no type"), (x["class"] not in ("structural", "causal", "motivational", "procedural", "evidential", "constraint"), "a relation has an unknown class"),
        (x["class"] != "structural" and (blank(x["why"]) or blank(x["evidence"])), "a relation is not structural and has no reason or evidence"), (confidence not in ("high", "medium", "low", "unknown"), "a relation has an unknown confidence"),
        (strict and rel not in writing.CLASSES, "a relation's type is not a writer's"), (x["class"] not in writing.CLASSES[rel] if rel in writing.CLASSES else x["class"] == "structural", "a relation's type can not have its class"),
        (x["ref"] == source, "a relation points to where it comes from"), (strict and base == "rich" and not seen, "a rich relation's target has not been read"),
    ]
    doubted = not strict and base == "rich" and (not seen or confidence in ("low", "unknown"))
    return "suspect" if doubted else base, next((m for c, m in faults if c), None)


def test_relations(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        links = [(rng.choice(["x", "y", "x", "me", None]), rng.choice(["depends-on", "Follows", "conflicts", "contains", "odd one", "supports", " "]), rng.choice(["causal", "procedural", "evidential", "structural", "wrong"]), rng.choice(["w", "w", "w", " "]), "e", rng.choice([None, "low", "medium", "sure"])) for _ in range(rng.randrange(4))]
        rows.append(request(i, rng.choice([True, False, None]), True, links, rng.choice([["x"], ["x", "y"], []]), ref="me"))
    got = {r.seq: r for r in writing.plans(frame(spark, rows)).collect()}
    for row in rows:
        strict = row["options"]["strict"] is not False
        want = [plain_link(x, "me", strict, row["read_context"]["inspected_refs"], ["me"]) for x in row["connect_to"]]
        r = got[row["seq"]]
        assert [(x.quality, x.error) for x in r.relations] == want
        assert set(r.errors) == {e for _, e in want if e} | ({"a strict request has no relation"} if strict and not want else set())
        m = r.metrics
        assert (m.total, m.rich, m.anemic, m.structural, m.suspect) == (len(want), *(sum(q == k for q, _ in want) for k in ("rich", "anemic", "structural", "suspect")))
        assert (r.memory is None) == bool(r.errors) and len(r.suggested_reads) == bool(want)


def test_plan_of_a_delta(spark):
    delta = {"from": "old", "to": "New Plan", "why": "because", "evidence": "seen"}
    links = [("x", "depends_on", "causal", "w", "e", None)]
    rows = [request(1, True, False, links, ["x"], delta), request(2, None, None, links, ["x"]), request(3, False, True), request(4, True, True, links, [], delta), request(5, True, True, links, ["x"], delta | {"ref": "me"}, ref="me"), request(6, True, True, links, ["x"], delta | {"why": None})]
    got = {r.seq: r for r in writing.plans(frame(spark, rows)).collect()}
    r, new = got[1], "a:entry:semantic_delta:new-plan"
    assert r.errors == [] and not r.dry_run and got[2].dry_run and r.generated_refs == ["a:entry:turn:said-so", new]
    assert [(e.id, e.kind, [(c.dimension, c.sequence) for c in e.coordinates]) for e in r.memory.entries] == [("a:entry:turn:said-so", "turn", [("t", 4), ("p", 4)]), (new, "semantic_delta", [("t", 5), ("p", 5)])]
    assert [(x.source, x.target, x.rel) for x in r.memory.relations] == [("a:entry:turn:said-so", "x", "depends_on"), ("a:entry:turn:said-so", new, "updates_state"), (new, "x", "semantic_delta_from")]
    assert [(v.id.rsplit(":", 2)[-1], v.supports) for v in r.memory.evidence] == [("current", [r.generated_refs[0]]), ("1", [r.generated_refs[0], "x"]), ("semantic_delta", [new, r.generated_refs[0]])]
    assert (r.metrics.needed, r.metrics.read, r.metrics.read_share, r.metrics.proven_share) == (2, 2, 1.0, 1.0) and r.relations[1].read_by == ["current_request"]
    assert got[3].errors == [] and got[3].metrics.rich_share == 0.0 and got[4].errors == ["a rich relation's target has not been read"]
    assert "a generated reference repeats" in got[5].errors and "the semantic delta is incomplete" in got[6].errors
    assert len({got[i].idempotency_key for i in got}) == 6


def test_faults_and_nulls(spark):
    rows = [request(1, True, True, about=" ", intent="x", actor=None, observed_at="", scope=None, current={"kind": "odd"}, read_context={"ask_refs": [" "]}), {n: None for n in writing.REQUEST.names} | {"seq": 2}]
    got = {r.seq: r for r in writing.plans(frame(spark, rows)).collect()}
    assert got[1].errors == ["about is blank", "the intent is unknown", "the actor is blank", "observed_at is blank", "a reference that was read is blank", "the process is blank", "the kind is unknown", "the summary is blank", "a strict request has no evidence", "a strict request has no relation"]
    assert got[2].memory is None and len(got[2].errors) == 9
    assert writing.plans(frame(spark, [])).count() == 0


def test_read_index(spark):
    context = {"inspected_refs": ["x", " ", "x"], "ask_refs": ["x", "y"], "wake_refs": None, "trace_paths": [{"from": "x", "to": "z", "refs": ["w"]}, {"from": "y", "to": "z", "refs": None}]}
    got = {(r.seq, r.ref_id): r.tools for r in writing.read_index(frame(spark, [request(1, read_context=context), request(2, read_context=None)])).collect()}
    assert got == {(1, "x"): ["kernel_ask", "kernel_inspect", "kernel_trace"], (1, "y"): ["kernel_ask", "kernel_trace"], (1, "z"): ["kernel_trace"], (1, "w"): ["kernel_trace"]}


def test_write_memory(spark, tmp_path):
    ledger = logs.Ledger(spark, f"file://{tmp_path}/log")
    links = [("x", "depends_on", "causal", "w", "e", None)]
    rows = [request(1, True, False, links, ["x"]), request(2, None, None, links, ["x"]), request(3, True, False, links), request(4, False, False, about="b")]
    out, made = writing.write_memory(ledger, frame(spark, rows))
    assert {r.seq: (r.outcome, r.revision, bool(r.errors)) for r in out.collect()} == {1: ("accepted", 1, False), 2: ("dry run", None, False), 3: ("invalid", None, True), 4: ("accepted", 1, False)}
    assert {(r.source, r.target) for r in made.filter("relation_type = 'depends_on'").collect()} == {("a:entry:turn:said-so", "x")}
    assert ledger.version() == 1 and writing.write_memory(ledger, frame(spark, rows[:1]))[0].first().outcome == "replayed"
    assert all(not r.errors for r in ingest.faults(writing.plans(frame(spark, rows)).filter("memory is not null").select("seq", "about", "memory.*")).collect())


def test_candidates(spark):
    rng = random.Random(2)
    refs = [f"m:subtask:{i}:{k}" for i in range(4) for k in ("question", "answer", "note", "answer:2")] + ["m:subtask:x:answer", "m:subtask:1:question:subtask:9:answer", "about:m:dimension:d", "plain", "q:subtask:2"]
    rows = [(i, rng.choice(refs), rng.choice(["subtask_question", "subtask_answer_feedback", "other", None]), rng.choice(refs)) for i in range(30) for _ in range(8)]
    rows = [(i, rows[i * 8][1], rows[i * 8][2], r) for i, _, _, r in rows]

    def plain(ref):
        if ":subtask:" not in ref:
            return None
        m = re.match(r"([+-]?\d+):(question|answer)(:|$)", ref.rsplit(":subtask:", 1)[1])
        return (int(m[1]), m[2]) if m else None

    got = {}
    for r in sorted(writing.ranked_candidates(spark.createDataFrame(rows, "seq long, entry_ref string, entry_kind string, ref string")).collect(), key=lambda r: (r.seq, r.place)):
        own, other = plain(r.entry_ref), plain(r.ref)
        gap = own[0] - other[0] if own and other else None
        where = "unknown" if gap is None else "same_subtask" if gap == 0 else "previous_subtask" if gap == 1 else "older_subtask" if gap > 1 else "future_subtask"
        role = "dimension_scope" if ":dimension:" in r.ref else f"{where}_{other[1]}" if gap is not None else "unknown"
        find = lambda t, d: t.get((r.entry_kind, role), t.get((None, role), d))
        assert (r.temporal_distance, r.relative_position, r.role, r.priority, r.relation_hint) == (gap, where, role, find(writing.PRIORITIES, 80), find(writing.HINTS, "context_candidate"))
        got.setdefault(r.seq, []).append((r.priority, r.ref))
    assert all(x == sorted(set(x)) for x in got.values()) and {(i, r) for i, x in got.items() for _, r in x} == {(i, r) for i, _, _, r in rows}
    named = frame(spark, [request(1, links=[("me", "x", "y", "", "", None), ("l", "x", "y", "", "", None)], reads=["r", "me"], ref="me")])
    calls = spark.createDataFrame([(1, '{"from": "f", "around": {"ref": "r2"}}'), (1, "{"), (9, '{"ref": "no"}')], "seq long, arguments string")
    assert sorted(r.ref for r in writing.candidate_refs(named, calls).collect()) == ["f", "l", "r", "r2"]


def test_consumer(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "k", "A", "s", "ACTIVE"), ("b", "evidence", "B", "", "ACTIVE")], "node_id string, node_kind string, title string, summary string, status string")
    edges = spark.createDataFrame([("a", "b", "supports", "evidential", 1)], "source string, target string, relation_type string, semantic_class string, sequence long")
    details = spark.createDataFrame([("b", "so it is")], "node_id string, detail string")
    asked = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", "nowhere")], "request_id string, root string")
    reader = Consumer(Memory(nodes, edges, details))
    assert reader.capabilities()["capabilities"] == ["wake", "ask"]
    got = {r.request_id: r for r in reader.ask(asked).collect()}
    assert [(got[i].nodes, got[i].relationships, got[i].details, got[i].revision, got[i].answer) for i in ("r1", "r2", "r3")] == [(2, 1, 1, 0, "so it is"), (1, 0, 1, 0, "so it is"), (0, 0, 0, 0, "UNKNOWN")]
    assert "so it is" in got["r1"].content and got["r3"].content is None
    writer = Consumer(Memory(nodes, edges.withColumn("sequence", F.lit(2).cast("long")), details), logs.Ledger(spark, f"file://{tmp_path}/log"))
    plan = writing.plans(frame(spark, [request(1, False, False)])).select("seq", "about", "memory.*")
    assert [(r.outcome, r.entries, r.ready) for r in writer.record(plan).collect()] == [("accepted", 1, True)] and writer.capabilities()["capabilities"][-1] == "record"
    again = {r.request_id: r for r in writer.wake(asked).collect()}
    assert (again["r1"].revision, again["r2"].revision) == (1, 0) and again["r1"].snapshot != got["r1"].snapshot and again["r2"].snapshot == got["r2"].snapshot
