"""Literal cases of temporal moves, traversal, folding and packing."""

import pytest
from pyspark.sql import functions as F

from mnemograph.functions import scalars
from mnemograph.kernel import Memory
from mnemograph.operators import graph, projection, render, temporal


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def entries(spark):
    data = [("a", "conversation", "conversation:main", f"claim:{n}", i) for i, n in enumerate(("one", "two", "three"), 1)]
    return spark.createDataFrame(data, "about string, dimension string, scope_id string, ref_id string, sequence long")


def cursor(spark, *keys):
    return spark.createDataFrame([(f"r{i}", "a", temporal.SEQUENCE, str(k).zfill(10)) for i, k in enumerate(keys)], "request_id string, about string, axis int, key string")


def test_moves(spark, entries):
    found = temporal.positions(entries)
    near = temporal.refs(temporal.near(found, cursor(spark, 2), 1, 1))
    assert rows(near) == [("r0", 1, "claim:one"), ("r0", 2, "claim:two"), ("r0", 3, "claim:three")]
    page = temporal.page(found, cursor(spark, 1, 3), "forward", 1)
    assert rows(page) == [("r0", 1, 2, True, "claim:two")]
    assert rows(temporal.refs(temporal.move(found, cursor(spark, 2), "goto"))) == [("r0", 1, "claim:one"), ("r0", 2, "claim:two")]
    assert rows(temporal.refs(temporal.move(found, cursor(spark, 2), "rewind"))) == [("r0", 1, "claim:one")]
    assert temporal.move(found, cursor(spark, 3), "forward").isEmpty()


def test_cursor_of_unknown_ref(spark, entries):
    asked = spark.createDataFrame([("r", "a", "claim:two"), ("s", "a", "claim:none")], "request_id string, about string, ref_id string")
    assert rows(temporal.cursor_of_refs(asked, temporal.positions(entries)).select("request_id", F.coalesce("key", F.lit("-")))) == [("r", "0000000002"), ("s", "-")]


def test_entry_without_axes_is_found_by_reference(spark):
    e = spark.createDataFrame([("a", "d", "s", "x"), ("a", " ", "s", "y")], "about string, dimension string, scope_id string, ref_id string")
    assert rows(temporal.positions(e).select("axis", "key")) == [(temporal.REF, "x")]


@pytest.fixture
def edges(spark):
    data = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "x"), ("x", "d"), ("c", "d"), ("z", "z")]
    return spark.createDataFrame([(s, t, "leads_to", "causal", None) for s, t in data], "source string, target string, relation_type string, semantic_class string, sequence long")


def test_traversal(spark, edges):
    asked = spark.createDataFrame([("r", "a"), ("s", "d"), ("t", "z")], "request_id string, root string")
    reached = graph.reach(edges, asked, 2)
    assert rows(reached) == [("r", "b", 1), ("r", "c", 2), ("r", "d", 2), ("r", "x", 1)]
    # A root that reaches nothing else has no edges, not even one to itself.
    assert {r.request_id for r in graph.induced(edges, reached, asked).collect()} == {"r"}


def test_paths(spark, edges):
    asked = spark.createDataFrame([("r", "a", "d"), ("s", "d", "a"), ("t", "a", "a")], "request_id string, root string, target string")
    assert rows(graph.shortest_paths(edges, asked).select("request_id", F.array_join("path", ">"))) == [("r", "a>x>d")]
    nodes = graph.context_paths(edges, asked, 0)
    assert {r.node for r in nodes.filter("request_id = 's'").collect()} == {"a", "b", "c", "d", "x"}


def test_fold(spark):
    node = '{"node_id": "n", "node_kind": "k", "title": "%s", "status": "S", "related_nodes": [{"node_id": "m", "relation_type": "t"}]}'
    events = spark.createDataFrame([(1, "graph.node.materialized", node % "old"), (2, "graph.node.materialized", node % "new"), (3, "node.detail.materialized", '{"node_id": "n", "detail": "d", "revision": 5}'), (4, "node.detail.materialized", '{"node_id": "n", "detail": "e", "revision": 1}'), (5, "other", "{}"), (6, "graph.node.materialized", "broken")], "seq long, subject string, data string")
    model = projection.fold(projection.mutations(events))
    assert rows(model["nodes"].select("node_id", "title", "status")) == [("m", "[unmaterialized node]", "UNMATERIALIZED"), ("n", "new", "S")]
    assert rows(model["details"].select("node_id", "detail", "revision")) == [("n", "e", 1)]  # the last to arrive wins, whatever its revision
    assert projection.routed(events)["refused"].count() == 2


def test_packing(spark):
    s = spark.createDataFrame([("r", i, t, 10) for i, t in enumerate((4, 5, 9, 8, 1), 1)] + [("q", 1, 50, 10), ("q", 2, 1, 10)], "request_id string, ord int, tokens long, budget long")
    assert rows(render.packed(s).select("request_id", "ord")) == [("q", 1), ("r", 1), ("r", 2), ("r", 5)]
    t = s.withColumn("tier", F.lit(0))
    assert rows(render.tiered(t).select("request_id", "ord")) == [("q", 1), ("r", 1), ("r", 2)]


def test_scalars(spark):
    df = spark.createDataFrame([("about:a:dimension:b:dimension:c",), ("about::dimension:b",), ("x",), (None,)], "s string")
    assert rows(df.select(F.coalesce(scalars.scope_about(F.col("s")), F.lit("-")), F.coalesce(scalars.scope_dimension(F.col("s")), F.lit("-")))) == [("-", "-"), ("-", "-"), ("-", "-"), ("a", "b:dimension:c")]
    one = spark.range(1)
    assert one.select(scalars.answers_match(F.lit("the red car"), F.lit("Red car!"))).first()[0]
    assert one.select(scalars.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))).first()[0] == 1.0


def test_verbs(spark, edges):
    nodes = spark.createDataFrame([(n, "evidence" if n == "b" else "claim", n.upper(), "", "ACTIVE") for n in "abcdxz"], "node_id string, node_kind string, title string, summary string, status string")
    details = spark.createDataFrame([("b", "because")], "node_id string, detail string")
    m = Memory(nodes, edges, details)
    asked = spark.createDataFrame([("r", "a"), ("t", "z")], "request_id string, root string")
    assert rows(m.ask(asked)) == [("r", "because"), ("t", "UNKNOWN")]
    assert m.wake(asked).count() == 6
    got = m.context(asked, 1000).orderBy("request_id").collect()
    assert got[0].content.startswith("Node A (claim)\n\nRelationship a") and got[1].content == "Node Z (claim)"
    assert rows(m.inspect(asked).select("request_id", "incoming", "outgoing")) == [("r", 1, 2), ("t", 1, 1)]


def test_days_that_do_not_exist(spark):
    from mnemograph.functions import scalars

    found = spark.range(1).select(scalars.civil_day(F.lit(2023), F.lit(2), F.lit(30)), scalars.civil_day(F.lit(1970), F.lit(1), F.lit(2)), scalars.civil_day(F.lit(1969), F.lit(12), F.lit(31)))
    assert tuple(found.first()) == (None, 1, -1)


def test_every_role_of_a_session(spark):
    memory = Memory(spark.createDataFrame([("a", "k", "t", "s", "ACTIVE")], "node_id string, node_kind string, title string, summary string, status string"), spark.createDataFrame([], "source string, target string, relation_type string, semantic_class string, sequence long"), spark.createDataFrame([], "node_id string, detail string"))
    requests = spark.createDataFrame([("r", "a")], "request_id string, root string")
    roles = spark.createDataFrame([(f"role{i}",) for i in range(150)], "role string")
    assert memory.session(requests, roles, 100).select("role").distinct().count() == 150


def test_paths_from_several_roots(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "c", "r"), ("b", "d", "r"), ("c", "d", "r"), ("d", "e", "r"), ("x", "e", "r"), ("e", "a", "r")], "source string, target string, relation_type string")
    asked = [("1", "a", "e"), ("2", "x", "e"), ("3", "x", "b"), ("4", "a", "a"), ("5", "e", "none"), ("6", "a", "e")]
    got = graph.shortest_paths(edges, spark.createDataFrame(asked, "request_id string, root string, target string"))
    assert sorted((r.request_id, ">".join(r.path)) for r in got.collect()) == [("1", "a>b>d>e"), ("2", "x>e"), ("3", "x>e>a>b"), ("6", "a>b>d>e")]


def test_verbs_under_budgets(spark):
    """Contexts with budgets, focus and roles of their own, paths, tiers and single nodes."""
    nodes = [(n, "claim", f"title {n}", "one two three", "ACTIVE") for n in "abcd"]
    edges = [("a", "b", "leads_to", "causal", 1), ("b", "c", "has", "structural", 2), ("a", "d", "has", "structural", None)]
    m = Memory(spark.createDataFrame(nodes, "node_id string, node_kind string, title string, summary string, status string"), spark.createDataFrame(edges, "source string, target string, relation_type string, semantic_class string, sequence long"), spark.createDataFrame([("b", "because of it")], "node_id string, detail string"))
    asked = spark.createDataFrame([("r", "a", 12), ("s", "a", None)], "request_id string, root string, budget long")
    got = {r.request_id: r for r in m.context(asked).collect()}
    assert got["s"].sections == 8 and got["s"].budget_requested is None and got["s"].mode == "reason_preserving"
    assert got["r"].budget_requested == 12 and got["r"].sections_kept + got["r"].sections_dropped == 8 and got["r"].budget_used <= 12
    assert got["r"].mode == "resume_focused"  # three tokens a node, and few edges explain
    path = m.context_path(spark.createDataFrame([("p", "a", "c"), ("q", "c", "a")], "request_id string, root string, target string")).collect()
    found = {r.request_id: r for r in path}
    assert "title d" not in found["p"].content and found["p"].content.startswith("Node title a")
    found = {r.request_id: (r.fault, r.detail) for r in m.detail(spark.createDataFrame([("1", " b "), ("2", "c"), ("3", "z"), ("4", " ")], "request_id string, node_id string")).collect()}
    assert found == {"1": (None, "because of it"), "2": (None, None), "3": ("Node not found: z", None), "4": ("node_id cannot be empty", None)}
    tiers = {(r.request_id, r.tier): r.content for r in m.tiers(asked).collect()}
    assert tiers["s", 0].startswith("Objective: title a") and "title b" in tiers["s", 2] and ("r", 2) not in tiers
    roles = spark.createDataFrame([("r", "agent", None, 1000), ("r", "judge", "c", 700), ("s", "agent", None, None)], "request_id string, role string, focus string, budget long")
    told = {(r.request_id, r.role): r for r in m.session(asked.drop("budget"), roles).collect()}
    assert set(told) == {("r", "agent"), ("r", "judge"), ("s", "agent")}
    assert told["r", "agent"].sections == 8 and told["r", "judge"].content != told["r", "agent"].content
    assert told["r", "judge"].content.split("\n\n")[1].startswith("Relationship b")  # its focus comes first
