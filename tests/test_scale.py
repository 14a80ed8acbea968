"""What keeps the work of queries in proportion to their rows, with the same results."""

import random

from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.functions import scalars
from mnemograph.operators import evaluate

NAN, INF = float("nan"), float("inf")


def plain_candidates(vectors, queries, k):
    pairs = queries.withColumnRenamed("v", "qv").join(vectors, "grp").filter("query <> ref")
    scored = pairs.select("query", "ref", scalars.cosine(F.col("qv"), F.col("v")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ref"))
    return scored.withColumn("place", place.cast("long")).filter(F.col("place") <= k).select("query", "place", "ref", "score")


def rows(df):
    return sorted(map(str, df.collect()))


def test_candidates_score_as_the_plain_join_does(spark):
    r = random.Random(3)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [NAN, 1.0, 1.0], [INF, 1.0, 0.0], [1e-200, 0.0, 0.0], [1e200, 1e200, 0.0], [1.0, 2.0]]
    held = [(i, g, odd[i % 9] if g == 2 and i < 60 else [r.choice((-1.0, 0.5, r.random())) for _ in range(3)] if i % 5 else [0.25, 0.5, 0.75]) for i, g in enumerate(r.choice((0, 1, 2, None)) for _ in range(300))]
    vectors = spark.createDataFrame(held, "ref long, grp int, v array<double>")
    queries = vectors.filter("ref % 3 = 0").withColumnRenamed("ref", "query")
    want = rows(plain_candidates(vectors, queries, 4))
    assert rows(evaluate.candidates(vectors, queries, 4)) == want
    assert rows(evaluate.candidates(vectors, queries, 4, most=7)) == want  # groups of several blocks on both sides
    assert rows(evaluate.candidates(vectors, queries, 200)) == rows(plain_candidates(vectors, queries, 200))


def test_candidates_make_no_row_for_each_pair(spark):
    vectors = spark.range(400).select(F.col("id").alias("ref"), F.lit(0).alias("grp"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    found = evaluate.candidates(vectors, vectors.withColumnRenamed("ref", "query"), 3)
    assert found.count() == 1200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "query <> ref" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_lone_marks_are_not_sent_to_python(spark):
    from mnemograph.functions import spans

    texts = ["paid $5 on 2024-01-02", "a ` tick", "plain", "pay $5 and $6", "$$a", "`x`", "``", "\\(a", "see http://x.y", "```a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sent = [r[0] for r in df.filter(spans._marked(F.col("text")).isNotNull()).collect()]
    assert sent == texts[3:]
    assert not any(spans.protected_spans(t) for t in texts[:3])
    r = random.Random(5)
    mixed = ["".join(r.choice(("`", "$", "\\(", "\\)", "a", " ", "1")) for _ in range(r.randrange(8))) for _ in range(500)]
    unsent = spark.createDataFrame([(t,) for t in mixed], "text string").filter(spans._marked(F.col("text")).isNull())
    assert not any(spans.protected_spans(r[0]) for r in unsent.collect())


def test_answers_are_derived_without_a_row_for_each_distinct_value(spark):
    from mnemograph.operators import interpret

    questions = spark.createDataFrame([("a", "How much was spent?"), ("b", "What is the total cost?"), ("c", "Who?")], "request_id string, question string")
    fragments = spark.createDataFrame([("a", 1, "paid $5"), ("a", 2, "and $6"), ("b", 1, "paid $5"), ("b", 2, "or 6 EUR")], "request_id string, ord long, text string")
    found = interpret.answers_of(questions, fragments)
    got = {r[0]: (r["operands"], r["number"], r["status"]) for r in found.filter("reader = 'currency'").collect()}
    assert got == {"a": (2, 11.0, "derived"), "b": (2, None, "mixed kinds"), "c": (0, None, "not asked")}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_truncation_packs_sections_once(spark):
    from mnemograph.operators import render

    r = random.Random(7)
    held = [(f"r{i % 20}", i, r.randrange(3), r.randrange(9), None if i % 20 == 3 else 20, [8, 9, 7]) for i in range(400)]
    sections = spark.createDataFrame(held, "request_id string, ord long, tier int, tokens long, budget long, caps array<long>")
    found = render.cut(sections)
    want = render.truncation(sections.filter("budget is not null"), render.packed(sections.filter("budget is not null")))
    assert rows(found.select(want.columns)) == rows(want)
    plain = sections.drop("tier", "caps").filter("budget is not null")
    assert rows(render.cut(plain).select(want.columns)) == rows(render.truncation(plain, render.packed(plain)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_relation_has_its_type_worked_out_once(spark):
    from mnemograph.operators import writing

    requests = spark.createDataFrame([], writing.REQUEST)
    plan = writing.plans(requests).select("relations")._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("lower(") < 100  # 662 where each rule worked the type out again


def test_spread_tables_give_no_task_more_rows_than_so_many(spark):
    from mnemograph.sources import views

    assert views.spread(spark.range(0, 1000, 1, 2), most=50).rdd.getNumPartitions() == 20
    assert views.spread(spark.range(0, 1000, 1, 2)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert views.spread(spark.range(0, 1000, 1, 30), most=50).rdd.getNumPartitions() == 30


def graph_of(spark, monkeypatch):
    """Edges and requests of a graph, where a task gets about ten rows; and how often the edges' ends are written."""
    from mnemograph.operators import graph
    from mnemograph.sources import views

    dealt, steps, times = views.dealt, graph._steps, []
    monkeypatch.setattr(views, "dealt", lambda df, *keys, rows=None: dealt(df, *keys, rows=rows, most=10))
    monkeypatch.setattr(graph, "_steps", lambda edges: times.append(1) or steps(edges))
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", "t") for i in range(60) for j in (2 * i + 1, 2 * i + 2, i // 3)], "source string, target string, relation_type string")
    return edges, times


def test_tables_are_dealt_by_their_rows(spark):
    from mnemograph.sources import views

    assert views.dealt(spark.range(1000), "id", most=50).rdd.getNumPartitions() == 20
    assert views.dealt(spark.range(0), "id", rows=1000, most=50).rdd.getNumPartitions() == 20
    assert views.dealt(spark.range(1000), "id").count() == 1000


def test_a_context_path_walks_over_edges_written_once(spark, monkeypatch):
    from mnemograph.operators import graph

    edges, times = graph_of(spark, monkeypatch)
    asked = [("a", "n0", "n37"), ("a", "n0", "n38"), ("b", "n5", "n5"), ("c", "n0", "nowhere"), ("d", "n90", "n1"), ("a", "n0", "none"), ("e", "n0", "n4")]
    got = graph.context_paths(edges, spark.createDataFrame(asked, "request_id string, root string, target string"), 0)
    found = {k: {r.node for r in got.filter(f"request_id = '{k}'").collect()} for k in "abcde"}
    assert len(times) == 1
    assert found["a"] == {"n0", "n1", "n3", "n8", "n18", "n37", "n38"} and found["e"] == {"n0", "n1", "n4"} and found["c"] == {"nowhere"}
    assert "n5" in found["b"] and len(found["b"]) > 60 and len(found["d"]) > 60
    assert got.count() == got.distinct().count()


def test_faults_of_a_batch_in_small_tasks(spark, monkeypatch):
    from mnemograph.operators import ingest

    edges, _ = graph_of(spark, monkeypatch)
    edges = edges.union(spark.createDataFrame([("n7", "n7", "t"), ("n200", "n201", "t")], edges.schema))
    nodes = spark.createDataFrame([(f"n{i}", " " if i == 9 else "x") for i in [*range(119), 4, 201, 300]], "node_id string, title string")
    found = ingest.batch_faults(nodes, edges, spark.createDataFrame([("b", "n0")], "request_id string, root string"))
    want = {("duplicate node", "n4"), ("blank title", "n9"), ("edge to itself", "n0"), ("edge to itself", "n7"), *(("unknown node", f"n{i}") for i in (119, 120, 200)), ("not reached", "n201"), ("not reached", "n300")}
    assert {(r.fault, r.key) for r in found.collect()} == want and found.count() == len(want)


def test_the_edges_of_a_request_in_small_tasks(spark, monkeypatch):
    from mnemograph.operators import graph

    edges, _ = graph_of(spark, monkeypatch)
    requests = spark.createDataFrame([("a", "n0"), ("b", "n20"), ("c", "gone")], "request_id string, root string")
    kept = graph.written(edges)
    got = {tuple(r) for r in graph.induced(kept, graph.reach(kept, requests, 2), requests).collect()}
    ends = [tuple(r) for r in edges.collect()]
    want = set()
    for request, root in (("a", "n0"), ("b", "n20")):
        near = {t for s, t, _ in ends if s == root}
        held = {root} | near | {t for s, t, _ in ends if s in near}
        want |= {(request, *e) for e in ends if e[0] in held and e[1] in held}
    assert got == want

def test_near_is_one_join_and_one_pass(spark):
    from mnemograph.operators import temporal

    r = random.Random(11)
    held = [(f"a{i % 7}", "d", "s", f"e{i}", r.randrange(2), f"{r.randrange(30):03d}") for i in range(300)]
    found = spark.createDataFrame(held, "about string, dimension string, scope_id string, ref_id string, axis int, key string")
    requests = spark.createDataFrame([(f"r{i}", f"a{i % 8}", i % 2, f"{i % 31:03d}") for i in range(40)], "request_id string, about string, axis int, key string")
    for before, after in ((2, 2), (0, 3), (1, 0), (50, 50)):
        want = []
        for request, about, axis, cursor in requests.collect():
            own = sorted(h for h in held if h[0] == about and h[4] == axis)
            own.sort(key=lambda h: (h[4], h[5], h[1], h[2], h[3]))
            less, more = [h for h in own if h[5] < cursor], [h for h in own if h[5] > cursor]
            want += [(request, h[3]) for h in less[max(0, len(less) - before) :] + [h for h in own if h[5] == cursor] + more[:after]]
        got = temporal.near(found, requests, before, after)
        assert sorted(got.select("request_id", "ref_id").collect()) == sorted(want)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1

def test_leaves_are_taken_without_rounds_over_levels(spark):
    import json

    from mnemograph.operators import leaves

    deep = {"a:b": "x", 'k":': {"z": [1, "y\\\"q", {"c": [], "b": "tab\there"}], "m": None}, "n": [[True, "N/A", 2.5, "Answer: deep."]], "é": "x"}
    docs = [(1, json.dumps(deep)), (2, '"top"'), (3, "[1.10, 1E5, 1.1]"), (4, "nope"), (5, None), (6, json.dumps(["\n" * 20000 + "end"])), (7, "[" * 60 + '"in"' + "]" * 60)]
    found = leaves.meaningful(spark.createDataFrame(docs, "id long, json string"))
    got = {}
    for r in sorted(found.collect()):
        got.setdefault(r.id, []).append(r.leaf)
    assert got[1] == ["x", "1", 'y\\"q', "tab\there", "2.5", "deep"]
    assert got[2] == ["top"] and got[3] == ["1.1", "100000"] and got[6] == ["\n" * 20000 + "end"] and got[7] == ["in"] and set(got) == {1, 2, 3, 6, 7}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_equal_actions_are_parsed_once(spark):
    from mnemograph.operators import readers

    actions = ['{"type":"stop"}'] * 5 + ['{"type":"tool_call","tool":"kernel_near","arguments":{"around":{"ref":"a"}}}'] * 3 + ["nope", None]
    found = readers.observed_capabilities(spark.createDataFrame([(a,) for a in actions], "action string"))
    assert {tuple(r) for r in found.collect()} == {("tool:stop", 5), ("window:stop_sufficient", 5), ("tool:kernel_near", 3), ("cursor:ref", 3)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_operands_are_dealt_by_their_rows(spark, monkeypatch):
    from mnemograph.operators import readers

    monkeypatch.setattr(readers, "OPERANDS", 2)
    questions = spark.createDataFrame([("a", "How many different parts?", "count", "none"), ("b", "Which?", "list", "none")], "request_id string, question string, operation string, unit string")
    held = [(q, i, "l", "include", None, e, 1.0) for q in "ab" for i, e in enumerate(["x", "The X", "y", None, "x", " ", "z"])]
    found = readers.labelled_answers(questions, spark.createDataFrame(held, "request_id string, ord long, ref_id string, label string, role string, entity string, value double"))
    assert {r.request_id: r.answer for r in found.collect()} == {"a": "5: x, y, z", "b": "x, The X, y, x, z"}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_plain_trims_are_those_of_the_pattern(spark):
    from mnemograph.operators import readers

    r = random.Random(13)
    texts = ["".join(r.choice(" \t\n\x0b\f\r\x85\u2028\u2029\xa0\u3000ab") for _ in range(r.randrange(7))) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert df.filter(~readers._trimmed(F.col("x")).eqNullSafe(F.regexp_replace("x", readers._WHITE, ""))).count() == 0
    assert readers._ENDS[0] == "\x85"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_snippets_take_one_shuffle(spark):
    from mnemograph.plans import catalog

    assert shuffles(catalog.QUERIES["evidence_snippets"](spark, "/root/testdata/sf0.001")) == 1


def test_turn_fragments_take_one_shuffle(spark):
    from mnemograph.plans import catalog

    assert shuffles(catalog.QUERIES["turn_fragments"](spark, "/root/testdata/sf0.001")) == 1


def test_memories_get_their_shape_without_json(spark):
    from mnemograph.operators import ingest
    from mnemograph.plans import memory_queries

    df = spark.createDataFrame([([("a", [("d", 3)]), None, ("b", None)],), (None,), ([],)], "e array<struct<id: string, coordinates: array<struct<dimension: string, sequence: int>>>>")
    to = ingest.MEMORY["entries"].dataType
    got = df.select(memory_queries._as(F.col("e"), df.schema["e"].dataType, to).alias("e"))
    assert got.schema["e"].dataType.simpleString() == to.simpleString()
    assert rows(got) == rows(df.select(F.from_json(F.to_json("e"), to).alias("e")))
    assert "from_json" not in got._jdf.queryExecution().optimizedPlan().toString()


def shuffles(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")  # a new plan, not one that has run


def test_sections_shuffle_nothing_but_lines_and_nodes(spark):
    from mnemograph.plans import catalog

    for name in ("tier_sections", "truncation_metadata"):
        found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert shuffles(found) == 4, name  # lines to their parts and to their orders, parts, orders


def test_packing_shuffles_no_sections_that_lie_together(spark):
    from mnemograph.operators import render

    r = random.Random(11)
    held = [(f"r{i % 30}", i, r.randrange(3), r.randrange(9), None if i % 30 == 3 else 20, [8, 9, 7]) for i in range(900)]
    sections = spark.createDataFrame(held, "request_id string, ord long, tier int, tokens long, budget long, caps array<long>")
    found = render.cut(sections.repartition(3, "request_id"), met=True)
    assert rows(found) == rows(render.cut(sections)) and found.count() == 29
    assert shuffles(found) == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # requests that go over several batches
    try:
        assert rows(render.cut(sections.coalesce(1))) == rows(found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sections_over_odd_tables_agree_with_sql(spark, tmp_path, monkeypatch):
    import functools

    import duckdb

    from mnemograph.plans import catalog
    from mnemograph.sources import views

    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"create table {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    # Lines of one part and order, by one flag and by several; parts and orders that are not there; a part and an order twice.
    c.execute("insert into lineitem select * replace (l_linenumber + 10 as l_linenumber, 'A' as l_returnflag) from lineitem where l_orderkey % 3 = 0")
    c.execute("insert into lineitem select * replace (l_linenumber + 20 as l_linenumber, 'N' as l_returnflag) from lineitem where l_orderkey % 4 = 0")
    c.execute("insert into lineitem select * replace (null as l_orderkey) from lineitem where l_orderkey % 50 = 0")
    c.execute("delete from part where p_partkey % 13 = 5")
    c.execute("delete from orders where o_orderkey % 17 = 5")
    c.execute("update part set p_type = '' where p_partkey % 7 = 1")
    c.execute("insert into part select * from part where p_partkey % 11 = 3")
    c.execute("insert into orders select * from orders where o_orderkey % 19 = 3")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    dealt = views.dealt
    for most in (views.SPREAD_ROWS, 400):
        monkeypatch.setattr(views, "dealt", functools.partial(dealt, most=most))
        for name in ("tier_sections", "truncation_metadata"):
            got = catalog.QUERIES[name](spark, str(tmp_path))
            want = c.execute(catalog.ORACLES[name])
            columns = [d[0] for d in want.description]
            assert rows(got.select(columns).toDF(*columns)) == sorted(str(spark_row(columns, x)) for x in want.fetchall()), (name, most)


def spark_row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values)))


def test_tier_sections_lists_every_kind_of_row(spark):
    from mnemograph.operators import render

    nodes = spark.createDataFrame([("q", n, "k", n.upper(), s, "OPEN") for n, s in (("a", ""), ("b", "x"), ("c", " "))] + [("r", n, "k", n.upper(), "", "OPEN") for n in "abcd"] + [("t", "a", "k", None, "", "OPEN")], "request_id string, node_id string, node_kind string, title string, summary string, status string")
    edges = spark.createDataFrame([(q, *e) for q in "qr" for e in (("a", "b", "x", "structural", None), ("a", "c", "y", "constraint", 2), ("c", "b", "z", "causal", 3), ("b", "c", "z", "causal", None), ("b", "a", "w", None, 1))], "request_id string, source string, target string, relation_type string, semantic_class string, sequence int")
    details = spark.createDataFrame([("q", "a", "one"), ("q", "b", "two"), ("r", "a", "one")], "request_id string, node_id string, detail string")
    asked = spark.createDataFrame([("q", "a", "b", "reason_preserving", None), ("r", "a", None, "resume_focused", 1), ("t", "a", None, "reason_preserving", 0)], "request_id string, root string, focus string, mode string, max_tier int")
    found = render.tier_sections(nodes, edges, details, asked)
    got = {q: [(x.tier, x.content) for x in sorted((x for x in found.collect() if x.request_id == q), key=lambda x: tuple((v is not None, v) for v in x.ord))] for q in "qrt"}
    top = "Objective: A. Status: OPEN. Blocker: a > c. Next: c > b"
    why = [(1, "Relationship c --z--> b [causal] step=3"), (1, "Relationship b --z--> c [causal]"), (1, "Relationship a --y--> c [constraint] step=2")]
    assert got["q"] == [(0, top), (1, "Node A (k)"), (1, "Node B (k): x"), *why, (2, "Relationship a --x--> b [structural]"), (2, "Node C (k)"), (2, "Detail b: two"), (2, "Detail a: one")]
    assert got["r"] == [(0, top), (1, "Node A (k)"), (1, "Node B (k)"), (1, "Node C (k)"), *why]
    assert got["t"] == [(0, None)]
    assert shuffles(found) <= 2  # the rows of the bundles, and the requests
