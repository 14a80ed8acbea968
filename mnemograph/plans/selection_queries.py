"""Queries of selections, coordinates, answers and checks over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.functions import scalars
from mnemograph.kernel import Memory
from mnemograph.operators import evaluate, graph, leaves, projection, selection, splits, temporal
from mnemograph.sources import views
from mnemograph.sources.views import EDGES_SQL, NODES_SQL, POSITIONS_SQL

from .registry import query

_ORDER_EDGES = f"{EDGES_SQL}, oe AS (SELECT source AS request_id, * FROM edges WHERE source LIKE 'order:%')"


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.edges(spark, sf_dir).filter(F.col("source").startswith("order:")).withColumn("request_id", F.col("source"))


def _large_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").filter("p_size > 25").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"))


_LARGE = "large AS (SELECT 'part:' || p_partkey AS node FROM part WHERE p_size > 25)"


@query("canonical_order", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT e.source AS request_id, n.node_id, row_number() OVER (PARTITION BY e.source ORDER BY n.node_id, n.node_kind, n.title) AS place FROM edges e JOIN nodes n ON n.node_id = e.target WHERE e.source LIKE 'nation:%'")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir).filter(F.col("source").startswith("nation:")).withColumn("request_id", F.col("source"))
    n = views.nodes(spark, sf_dir).join(e.select("request_id", F.col("target").alias("node_id")), "node_id")
    return graph.ordered(n, e)[0].select("request_id", "node_id", "place")


@query(
    "conflict_texts",
    f"""WITH {_ORDER_EDGES}, placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY source, target, relation_type) AS place FROM oe)
SELECT request_id, min(place) AS place, source || ' contradicts ' || target || CASE WHEN sequence > 3 THEN ': line ' || sequence ELSE '' END AS text FROM placed WHERE relation_type = 'contradicts' GROUP BY 1, 3""",
)
def conflict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _order_edges(spark, sf_dir).withColumn("rationale", F.lit(" ")).withColumn("evidence", F.when(F.col("sequence") > 3, F.concat(F.lit(" line "), F.col("sequence").cast("string"))))
    return graph.conflicts(graph.ordered(e.limit(0).select("request_id", F.lit("").alias("node_id"), F.lit("").alias("node_kind"), F.lit("").alias("title")), e)[1])


@query(
    "existing_refs",
    "SELECT 'c' || c_custkey AS request_id, array_to_string(list_sort(list_distinct(list_concat(['customer:' || c_custkey, 'nation:' || any_value(c_nationkey)], list(DISTINCT 'order:' || o_orderkey) FILTER (o_orderkey IS NOT NULL)))), ',') AS refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
def existing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    requests = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("request_id"), F.concat(F.lit("customer:"), key).alias("root"))
    return graph.existing(views.edges(spark, sf_dir), requests).select("request_id", F.array_join("refs", ",").alias("refs"))


@query("touched_edges", f"WITH {_ORDER_EDGES}, {_LARGE} SELECT DISTINCT request_id, source, target, relation_type FROM oe WHERE target IN (SELECT node FROM large)")
def touched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _order_edges(spark, sf_dir)
    selected = e.select("request_id", F.col("target").alias("node")).join(_large_parts(spark, sf_dir), "node", "left_semi")
    return graph.touched(e, selected).select("request_id", "source", "target", "relation_type")


@query(
    "ref_coordinates",
    f"WITH {POSITIONS_SQL} SELECT about AS request_id, ref_id, string_agg(axis || '/' || key || '/' || dimension, ',' ORDER BY axis, key, dimension, scope_id) AS coordinates FROM (SELECT DISTINCT * FROM positions) GROUP BY 1, 2",
)
def ref_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.positions(views.entries(spark, sf_dir)).withColumn("request_id", F.col("about"))
    text = F.array_join(F.transform("coordinates", lambda c: F.concat_ws("/", c["axis"].cast("string"), c["key"], c["dimension"])), ",")
    return temporal.coordinates(found).select("request_id", "ref_id", text.alias("coordinates"))


@query("missing_positions", "SELECT DISTINCT 'user:' || user_id || ':' || axis AS request_id, axis = 2 AS missing FROM events, range(0, 3) t(axis)")
def missing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.entries(spark, sf_dir)
    requests = e.select("about").distinct().withColumn("axis", F.explode(F.array(F.lit(temporal.TIME), F.lit(temporal.SEQUENCE), F.lit(temporal.RANK))))
    requests = requests.withColumn("request_id", F.concat_ws(":", "about", F.col("axis").cast("string")))
    return temporal.missing_positions(temporal.positions(e), requests)


@query(
    "response_quality",
    f"""WITH {_ORDER_EDGES}, {_LARGE},
n AS (SELECT request_id, count(DISTINCT target) AS nodes, count(*) AS relationships, count(DISTINCT target) + 1 AS relation_nodes,
  count(DISTINCT target) FILTER (target IN (SELECT node FROM large)) AS details, count(*) FILTER (semantic_class IN ('causal', 'motivational', 'evidential')) AS causal FROM oe GROUP BY 1)
SELECT request_id, nodes, relationships, relation_nodes, details, details / nodes AS detail_coverage, causal / relationships AS causal_density FROM n""",
)
def response_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _order_edges(spark, sf_dir)
    nodes = e.select("request_id", F.col("target").alias("node_id")).distinct()
    details = nodes.join(_large_parts(spark, sf_dir).withColumnRenamed("node", "node_id"), "node_id", "left_semi")
    return evaluate.response_quality(e, nodes, details)


_SAID = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "answer_hits",
    f"SELECT p_partkey, contains({_SAID.format('p_name')}, {_SAID.format('p_brand')}) AND {_SAID.format('p_brand')} <> '' AS by_name, contains({_SAID.format(chr(39) + 'the ' + chr(39) + ' || p_type || p_brand')}, {_SAID.format('p_type')}) AS by_type, false AS by_nothing FROM part",
)
def answer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("the "), F.col("p_type"), F.col("p_brand"))
    return views.table(spark, sf_dir, "part").select("p_partkey", scalars.answer_hit(F.col("p_brand"), F.col("p_name")).alias("by_name"), scalars.answer_hit(F.col("p_type"), said).alias("by_type"), scalars.answer_hit(F.lit(" -"), said).alias("by_nothing"))


@query(
    "identifier_answers",
    f"SELECT c_custkey, length(replace({_SAID.format('c_name')}, ' ', '')) >= 8 AS by_identifier, {_SAID.format('c_mktsegment')} = {_SAID.format('c_name')} AS by_words, true AS same FROM customer",
)
def identifier_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's name holds a number, so it is found inside a text; its segment holds none."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    inside = F.concat(F.lit("it was "), name, F.lit(" who said so"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", scalars.text_contains_answer(inside, name).alias("by_identifier"), scalars.text_contains_answer(name, segment).alias("by_words"), scalars.text_contains_answer(segment, segment).alias("same"))


@query(
    "evidence_hits",
    """WITH t AS (SELECT DISTINCT conv_id, turn, role, length(text) > 200 AS seen, text IS NULL AS no_text FROM conversations),
j AS (SELECT conv_id, count(DISTINCT turn) FILTER (role = 'user') AS wanted, count(DISTINCT turn) FILTER (role = 'user' AND seen) AS found FROM t GROUP BY 1)
SELECT 'q' || conv_id AS question, CASE WHEN wanted = 0 OR conv_id % 7 = 0 THEN 'not applicable' WHEN wanted = found THEN 'full' WHEN found > 0 THEN 'partial' ELSE 'missing' END AS hit FROM j""",
)
def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "conversations").withColumn("question", F.concat(F.lit("q"), F.col("conv_id").cast("string")))
    wanted = t.select("question", (F.col("conv_id") % 7 == 0).alias("abstention"), F.when(F.col("role") == "user", F.col("turn").cast("string")).alias("ref_id")).distinct()
    seen = t.filter(F.length("text") > 200).select("question", F.col("turn").cast("string").alias("ref_id"))
    return evaluate.evidence_hits(wanted, seen)


@query(
    "validated_runs",
    """WITH e AS (SELECT o_custkey AS task, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
o AS (SELECT o_custkey AS task, count(*) AS m FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
f AS (SELECT coalesce(e.task, o.task) AS task, CASE WHEN n IS NULL THEN 'not expected' WHEN m IS NULL THEN 'missing' WHEN n > 1 THEN 'expected twice' WHEN m > 1 THEN 'observed twice' END AS fault FROM e FULL JOIN o ON e.task = o.task)
SELECT * FROM f WHERE fault IS NOT NULL""",
)
def validated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "task")
    return evaluate.validated(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus <> 'O'"), ["task"])


@query(
    "task_types",
    "SELECT o_orderpriority AS task_type, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS successes, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS success_rate, avg(CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.5 ELSE 0 END) AS process_score FROM orders GROUP BY 1",
)
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    tasks = views.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task_type"), (status == "F").alias("success"), F.when(status == "F", 1.0).when(status == "P", 0.5).otherwise(0.0).alias("process_score"))
    return evaluate.by_task_type(tasks)


@query("civil_days", "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, 'memory:' || o_orderkey AS memory FROM orders")
def civil_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    key = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "ingest:").otherwise(""), F.col("o_orderkey").cast("string"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", scalars.civil_day(F.year(d), F.month(d), F.dayofmonth(d)).alias("day"), scalars.memory_id(key).alias("memory"))


@query(
    "verb_inspect",
    "SELECT 'c' || c_custkey AS request_id, c_name AS title, c_mktsegment AS detail, 1::BIGINT AS incoming, count(o_orderkey) AS outgoing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment",
)
def verb_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("request_id"), F.col("c_mktsegment").alias("detail"))
    memory = Memory(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), c.select("node_id", "detail"))
    return memory.inspect(c.select("request_id", F.col("node_id").alias("root"))).select("request_id", "title", "detail", "incoming", "outgoing")


#: Selections by a user's number modulo their count: mode, include, exclude, scope_mode, abouts and scope_ids; {u} is the user.
_SELECTIONS = (
    ("all", [], [], "all", [], []),
    ("only", ["click", "purchase"], [], "current", [], []),
    ("except", [], ["error"], "abouts", ["user:{u}", "user:1"], []),
    ("only", ["view", "signup"], [], "current", [], ["signup"]),
    ("all", [], [], "current", [], ["about:user:{u}:dimension:view", "click"]),
    ("except", [], ["view"], "abouts", ["user:0"], []),
    ("only", [], ["view"], "current", ["user:1"], []),
    ("all", ["view"], [], "abouts", [" "], []),
    ("except", ["view"], [], "all", ["user:1"], []),
)


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = views.table(spark, sf_dir, "events").select("user_id").distinct()
    rule = spark.createDataFrame([(i, *r) for i, r in enumerate(_SELECTIONS)], "n int, mode string, include array<string>, exclude array<string>, scope_mode string, abouts array<string>, scope_ids array<string>")
    own = lambda c: F.transform(c, lambda x: F.replace(x, F.lit("{u}"), F.col("user_id").cast("string"))).alias(c)
    root = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    made = users.join(F.broadcast(rule), F.col("user_id") % len(_SELECTIONS) == F.col("n"))
    return made.select(root.alias("request_id"), root.alias("root"), "mode", "include", "exclude", "scope_mode", own("abouts"), own("scope_ids"))


@query(
    "selection_faults",
    """
SELECT 'user:' || user_id AS request_id, faults FROM (SELECT DISTINCT user_id FROM events) JOIN (VALUES
  (6, 'only requires include; only must not set exclude; current must not set abouts'), (7, 'all must not set include or exclude; abouts requires abouts'), (8, 'except requires exclude; except must not set include; all abouts must not set abouts')) v(n, faults)
ON user_id % 9 = n""",
)
def selection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.faults(_selections(spark, sf_dir)).filter("size(faults) > 0").select("request_id", F.array_join("faults", "; ").alias("faults"))


@query(
    "selected_bundles",
    """
WITH e AS (SELECT user_id AS u, 'user:' || user_id AS r, event_type AS dimension, 'about:user:' || (CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END) || ':dimension:' || event_type AS scope, 'event:' || event_id AS id, event_id AS n FROM events),
c AS (
  SELECT * FROM e WHERE CASE u % 9
    WHEN 0 THEN true
    WHEN 1 THEN dimension IN ('click', 'purchase') AND (n % 7 > 0 OR u = 0)
    WHEN 2 THEN dimension <> 'error' AND (n % 7 > 0 OR u = 0)
    WHEN 3 THEN dimension = 'signup' AND (n % 7 > 0 OR u = 0)
    WHEN 4 THEN dimension IN ('view', 'click') AND (n % 7 > 0 OR u = 0)
    WHEN 5 THEN dimension <> 'view' AND n % 7 = 0 END),
p AS (SELECT r, 'proof:' || n AS id, n, id AS entry FROM c WHERE n % 5 = 0),
roots AS (SELECT DISTINCT u, r FROM e WHERE u % 9 < 6),
items AS (
  SELECT r, 'node' AS part, r AS item FROM roots UNION SELECT r, 'node', id FROM c UNION SELECT r, 'node', scope FROM c UNION SELECT r, 'node', id FROM p
  UNION SELECT r, 'edge', scope || ' contains_entry ' || id FROM c UNION SELECT r, 'edge', r || ' records ' || id FROM c UNION SELECT r, 'edge', id || ' supports ' || entry FROM p
  UNION SELECT r, 'detail', id FROM c WHERE n % 3 = 0)
SELECT r AS request_id, part, item FROM items
""",
)
def selected_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a bundle for each user, of events with their scopes, evidence and details, cut down by selections of every mode."""
    e = views.table(spark, sf_dir, "events")
    root = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    about = F.when(F.col("event_id") % 7 == 0, F.lit("user:0")).otherwise(root)
    id_ = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    rows = e.select(root.alias("request_id"), F.col("event_type").alias("dimension"), scalars.dimension_identity(about, F.col("event_type")).alias("scope_id"), id_.alias("entry"), F.concat(F.lit("proof:"), F.col("event_id").cast("string")).alias("proof"), "event_id")
    proofs = rows.filter("event_id % 5 = 0")
    node = lambda df, c, kind: df.select("request_id", F.col(c).alias("node_id"), F.lit(kind).alias("node_kind"))
    nodes = node(rows, "entry", "event").union(node(rows, "scope_id", "memory_dimension").distinct()).union(node(rows, "request_id", "memory_anchor").distinct()).union(node(proofs, "proof", "evidence"))
    none = F.lit(None).cast("string")
    edge = lambda df, a, kind, b, *at: df.select("request_id", F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("relation_type"), *(at or (none.alias("dimension"), none.alias("scope_id"))))
    edges = edge(rows, "scope_id", "contains_entry", "entry", F.col("dimension"), F.col("scope_id")).union(edge(rows, "request_id", "records", "entry")).union(edge(proofs, "proof", "supports", "entry"))
    details = rows.filter("event_id % 3 = 0").select("request_id", F.col("entry").alias("node_id"))
    good = selection.faults(_selections(spark, sf_dir)).filter("size(faults) = 0").drop("faults")
    got = selection.selected(nodes.join(good.select("request_id"), "request_id", "left_semi"), edges.join(good.select("request_id"), "request_id", "left_semi"), details.join(good.select("request_id"), "request_id", "left_semi"), good)
    part = lambda name, item: got[f"{name}s"].select("request_id", F.lit(name).alias("part"), item.alias("item"))
    return part("node", F.col("node_id")).union(part("edge", F.concat_ws(" ", "source", "relation_type", "target"))).union(part("detail", F.col("node_id")))


@query(
    "selected_abouts",
    """
WITH s AS (SELECT DISTINCT user_id AS u, CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END AS a FROM events),
x AS (SELECT u, 'user:' || u AS about, 0 AS step FROM s UNION SELECT u, 'user:' || (u + 1), 1 FROM s UNION SELECT u, 'user:' || a, 2 FROM s),
o AS (SELECT u, about, min(step) AS step FROM x GROUP BY ALL)
SELECT 'user:' || u AS request_id, row_number() OVER (PARTITION BY u ORDER BY step, about) - 1 AS place, about FROM o
""",
)
def selected_abouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user's subjects: its own, another's anchor in its bundle, and those that its scopes name."""
    e = views.table(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("user:"), c.cast("string"))
    requests = e.select(name(F.col("user_id")).alias("request_id")).distinct().withColumn("root", F.col("request_id"))
    anchors = e.select(name(F.col("user_id")).alias("request_id"), F.explode(F.array(name(F.col("user_id")), name(F.col("user_id") + 1))).alias("node_id"), F.lit("memory_anchor").alias("node_kind")).distinct()
    scopes = e.select(name(F.col("user_id")).alias("request_id"), scalars.dimension_identity(F.when(F.col("event_id") % 7 == 0, F.lit("user:0")).otherwise(name(F.col("user_id"))), F.col("event_type")).alias("scope_id"))
    return selection.abouts(anchors, requests, scopes)


_RUNS = "r AS (SELECT l_returnflag AS mix, l_linestatus AS noise, l_linenumber AS scale, l_quantity > 25 AS task, l_discount > 0.05 AS restart, l_quantity AS tokens FROM lineitem)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_returnflag").alias("mix"), F.col("l_linestatus").alias("noise"), F.col("l_linenumber").alias("scale"), (F.col("l_quantity") > 25).alias("task"), (F.col("l_discount") > 0.05).alias("restart"), F.col("l_quantity").alias("tokens"))


@query(
    "cross_tabs",
    f"""WITH {_RUNS}
SELECT array_to_string(list_filter([CASE WHEN grouping(mix) = 0 THEN 'mix' END, CASE WHEN grouping(noise) = 0 THEN 'noise' END, CASE WHEN grouping(scale) = 0 THEN 'scale' END], lambda x: x IS NOT NULL), ',') AS level,
  coalesce(mix, '*') AS mix, coalesce(noise, '*') AS noise, coalesce(scale, 0) AS scale, count(*) AS runs, count(*) FILTER (task) AS task, count(*) FILTER (restart) AS restart
FROM r GROUP BY GROUPING SETS ((mix, noise, scale), (mix, noise), (mix), (noise), (scale), ())""",
)
def cross_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [["mix", "noise", "scale"], ["mix", "noise"], ["mix"], ["noise"], ["scale"], []]
    return evaluate.cross_tabs(_runs(spark, sf_dir), by, ["task", "restart"]).fillna({"mix": "*", "noise": "*", "scale": 0})


@query(
    "controlled_gains",
    f"""WITH {_RUNS}, c AS (SELECT noise, scale, count(*) FILTER (mix = 'R') AS n_high, count(*) FILTER (mix = 'A') AS n_low, count(*) FILTER (mix = 'R' AND task) AS a, count(*) FILTER (mix = 'A' AND task) AS b FROM r GROUP BY ALL)
SELECT noise, scale, n_high, n_low, a / n_high - b / n_low AS task_gain FROM c WHERE n_high > 0 AND n_low > 0""",
)
def controlled_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.controlled(_runs(spark, sf_dir), "mix", "R", "A", ["noise", "scale"], ["task"])


@query("cost_of_success", f"WITH {_RUNS} SELECT mix, noise, count(*) AS runs, count(*) FILTER (task) AS successes, sum(tokens) / count(*) FILTER (task) AS tokens_per_success FROM r GROUP BY ALL")
def cost_of_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cost_of_success(_runs(spark, sf_dir), ["mix", "noise"], "task", "tokens")


@query(
    "bundle_differences",
    f"""
WITH {EDGES_SQL}, e AS (SELECT * FROM edges WHERE source LIKE 'nation:%' OR source LIKE 'customer:%'),
d AS (SELECT source, target, hash FROM (SELECT source, target, CAST(regexp_extract(target, '[0-9]+') AS BIGINT) AS hash FROM e))
SELECT source, target, 'contains' AS relation_type, 'structural' AS semantic_class, 1 AS more FROM d WHERE hash % 50 IN (1, 2)
UNION ALL SELECT source, target, 'contains', 'causal', -1 FROM d WHERE hash % 50 = 2
UNION ALL SELECT target, source, 'contains', 'structural', -1 FROM d WHERE hash % 50 = 3
""",
)
def bundle_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as they are against what events of them fold to, after some events are lost, changed or new."""
    e = views.edges(spark, sf_dir).filter(F.col("source").startswith("nation:") | F.col("source").startswith("customer:")).select("source", "target", "relation_type", "semantic_class")
    number = (F.regexp_extract("target", "[0-9]+", 0).cast("long") % 50).alias("n")
    sent = e.select("*", number).filter("n <> 1").withColumn("semantic_class", F.when(F.col("n") == 2, "causal").otherwise(F.col("semantic_class")))
    back = e.select("*", number).filter("n = 3").select(F.col("target").alias("source"), F.col("source").alias("target"), "relation_type", "semantic_class")
    every = sent.drop("n").unionByName(back)
    data = F.to_json(F.struct(F.col("source").alias("source_node_id"), F.col("target").alias("target_node_id"), "relation_type", F.struct("semantic_class").alias("explanation")))
    events = every.select(F.monotonically_increasing_id().alias("seq"), F.lit("graph.relation.materialized").alias("subject"), data.alias("data"))
    folded = projection.fold(projection.mutations(events))["edges"].select(*e.columns)
    return evaluate.differences(e, folded)


@query(
    "json_leaves",
    """
WITH o AS (SELECT o_orderkey AS id, o_custkey, trim(o_orderstatus) AS s, o_orderpriority AS p FROM orders),
x AS (
  SELECT id, unnest([{'path': 1, 'leaf': p}, {'path': 2, 'leaf': CAST(o_custkey AS VARCHAR)}, {'path': 3, 'leaf': s}, {'path': 4, 'leaf': CASE WHEN id % 2 = 0 THEN 'deep ' || id END}, {'path': 5, 'leaf': p}]) AS l FROM o),
f AS (SELECT id, l.leaf AS leaf, min(l.path) AS path FROM x WHERE l.leaf IS NOT NULL AND l.leaf <> '' GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY path) AS place, leaf FROM f
""",
)
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values of orders: texts, numbers, what is no leaf, and repeats."""
    o = views.spread(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    deep = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"Answer: deep '), F.col("o_orderkey").cast("string"), F.lit('."'))).otherwise("N/A").alias("text"), F.lit(True).alias("true"), F.lit("-").alias("x"))
    value = F.struct(F.array(F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("a"), F.struct(F.col("o_custkey").alias("n"), F.struct(F.array(F.struct(F.concat(F.lit(" "), "o_orderstatus").alias("s")), F.struct(F.lit("").alias("s"))).alias("list")).alias("o")).alias("b"), F.array(F.array(deep)).alias("c"), F.col("o_orderpriority").alias("d"))
    return leaves.meaningful(o.select(F.col("o_orderkey").alias("id"), F.to_json(value).alias("json")))


@query(
    "covering_groups",
    """
WITH RECURSIVE b AS (SELECT 'order:' || l_orderkey AS g, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N') AS x FROM lineitem GROUP BY 1),
k AS (
  SELECT *, list_reduce(list_transform(range(1, strlen(g) + 3), lambda i: ord(substr('"' || g || '"', i, 1))::UBIGINT), lambda s, c: ((xor(s, c)::UHUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT, xor(14695981039346656037::UBIGINT, 7::UBIGINT)) AS h FROM b),
t AS (SELECT sum(r) AS r, sum(a) AS a, sum(x) AS x FROM k),
s AS (
  SELECT 0 AS round, []::VARCHAR[] AS done, 0::HUGEINT AS r, 0::HUGEINT AS a, 0::HUGEINT AS x
  UNION ALL
  SELECT round + 1, list_append(done, p.g), r + p.r, a + p.a, x + p.x FROM (
    SELECT any_value(s.round) AS round, any_value(s.done) AS done, any_value(s.r) AS r, any_value(s.a) AS a, any_value(s.x) AS x,
      arg_min({'g': k.g, 'r': k.r, 'a': k.a, 'x': k.x}, (
        -(least(k.r, greatest(12 - s.r, 0)) + least(k.a, greatest(12 - s.a, 0)) + least(k.x, greatest(12 - s.x, 0))),
        -((k.r > 0 AND s.r < 12)::INT + (k.a > 0 AND s.a < 12)::INT + (k.x > 0 AND s.x < 12)::INT), k.n, k.h, k.g)) AS p
    FROM s, k, t WHERE NOT list_contains(s.done, k.g) AND t.r - s.r - k.r >= 20 AND t.a - s.a - k.a >= 20 AND t.x - s.x - k.x >= 20
      AND least(k.r, greatest(12 - s.r, 0)) + least(k.a, greatest(12 - s.a, 0)) + least(k.x, greatest(12 - s.x, 0)) > 0
    HAVING count(*) > 0))
SELECT done[round] AS "group", CAST(round AS INTEGER) AS round FROM s WHERE round > 0
""",
)
def covering_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders held out until twelve lines of each of three kinds are among them."""
    line = views.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag").isin("R", "A"), F.col("l_returnflag")).when(F.col("l_linestatus") == "F", "NF")
    rows = line.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("group"), kind.alias("capability"))
    return splits.covering_groups(rows, ["R", "A", "NF"], 12, 20, 7)[0]
