"""Queries of ingest, graph batches, tiers, chunks and audits over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.operators import corpus, graph, ingest, projection, render
from mnemograph.sources import views
from mnemograph.sources.views import EDGES_SQL, NODES_SQL

from .memory_queries import _ORDER_EDGES, _order_edges
from .registry import query


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for each conversation: its turns are entries, each assistant turn answers the turn before it."""
    c = views.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    about, ref = F.concat(F.lit("conv:"), F.col("conv_id").cast("string")), F.concat_ws(":", F.lit("turn"), "conv_id", "turn")
    null = lambda t="string": F.lit(None).cast(t)
    at = F.struct(F.lit("dialogue").alias("dimension"), F.lit("main").alias("scope_id"), *(null().alias(n) for n in ("occurred_at", "observed_at", "ingested_at", "valid_from", "valid_until")), F.col("turn").alias("sequence"), null("long").alias("rank"))
    entry = F.struct(ref.alias("id"), F.col("role").alias("kind"), F.col("text").alias("text"), F.array(at).alias("coordinates"))
    before = F.concat_ws(":", F.lit("turn"), F.col("conv_id"), F.col("turn") - 1)
    answer = F.when((F.col("role") == "assistant") & (F.col("turn") > 0), F.struct(ref.alias("source"), before.alias("target"), F.lit("Answers To").alias("rel"), F.lit("evidential").alias("class"), F.lit("reply").alias("why")))
    return c.groupBy("conv_id").agg(F.collect_list(entry).alias("entries"), F.collect_list(answer).alias("relations")).select(
        F.col("conv_id").alias("seq"), about.alias("about"), F.expr("array(named_struct('id', 'dialogue', 'kind', 'conversation', 'title', cast(null as string)))").alias("dimensions"), "entries", "relations", F.expr("cast(array() as array<struct<id:string,text:string,supports:array<string>>>)").alias("evidence")
    )


_TURNS = "t AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2)"


@query(
    "memory_ingest",
    f"""WITH {_TURNS}, e AS (
  SELECT 'conv:' || conv_id AS source, 'about:conv:' || conv_id || ':dimension:dialogue' AS target, 'has_dimension' AS relation_type, 'structural' AS semantic_class FROM t
  UNION SELECT 'conv:' || conv_id, 'turn:' || conv_id || ':' || turn, 'records', 'structural' FROM t
  UNION SELECT 'about:conv:' || conv_id || ':dimension:dialogue', 'turn:' || conv_id || ':' || turn, 'contains_entry', 'structural' FROM t
  UNION SELECT 'turn:' || conv_id || ':' || turn, 'turn:' || conv_id || ':' || (turn - 1), 'answers_to', 'evidential' FROM t WHERE role = 'assistant' AND turn > 0)
SELECT * FROM e""",
)
def memory_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _memories(spark, sf_dir)
    return projection.fold(ingest.mutations(good))["edges"].select("source", "target", "relation_type", "semantic_class")


#: What is wrong with the memory of an order, by its number modulo their count.
_FAULTS = (
    "",
    "about is blank",
    "an entry has no id",
    "an entry has no text",
    "an entry has no coordinate",
    "ids repeat",
    "a coordinate names no dimension of the memory",
    "a relation has no type",
    "a relation is not structural and has no reason",
    "a relation has an unknown class",
    "about is blank; a relation has no type",
    "there is no dimension; there is no entry",
)


@query("every_memory_fault", f"SELECT o_orderkey AS seq, errors FROM orders JOIN (VALUES {', '.join(f"({i}, '{f}')" for i, f in enumerate(_FAULTS) if f)}) v(n, errors) ON o_orderkey % {len(_FAULTS)} = n")
def every_memory_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for each order, most of them with one of all faults or with two."""
    n, key = F.col("o_orderkey") % len(_FAULTS), F.col("o_orderkey").cast("string")
    if_ = lambda k, bad, good: F.when(n.isin(k) if isinstance(k, int) else n.isin(*k), bad).otherwise(good)
    text, blank = F.lit, F.lit(" ")
    null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in ingest.COORDINATE}
    at = F.struct(*(if_(6, text("other"), text("work")).alias("dimension") if c == "dimension" else v for c, v in null.items()))
    none = F.array().cast(f"array<{ingest.COORDINATE.simpleString()}>")
    entry = lambda i, own: F.struct(i.alias("id"), text("order").alias("kind"), (if_(3, blank, F.col("o_orderpriority")) if own else F.col("o_orderstatus")).alias("text"), (if_(4, none, F.array(at)) if own else F.array(at)).alias("coordinates"))
    one, two = if_(2, blank, F.concat(text("e:"), key)), F.concat(text("f:"), key)
    relation = F.struct(one.alias("source"), two.alias("target"), if_((7, 10), blank, text("leads to")).alias("rel"), if_(9, text("odd"), text("causal")).alias("class"), if_(8, blank, text("why")).alias("why"))
    evidence = F.struct(if_(5, F.concat(text("e:"), key), F.concat(text("v:"), key)).alias("id"), text("proof").alias("text"), F.array(two).alias("supports"))
    memories = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        if_((1, 10), blank, F.concat(text("c:"), key)).alias("about"),
        F.array(F.struct(text("work").alias("id"), text("kind").alias("kind"), F.lit(None).cast("string").alias("title"))).alias("dimensions"),
        F.array(entry(one, True), entry(two, False)).alias("entries"),
        F.array(relation).alias("relations"),
        F.array(evidence).alias("evidence"),
    )
    bare = {c: F.when(F.col("seq") % len(_FAULTS) == 11, F.array().cast(memories.schema[c].dataType)).otherwise(F.col(c)) for c in ("dimensions", "entries")}
    return ingest.faults(memories.withColumns(bare)).filter("size(errors) > 0").select("seq", F.array_join("errors", "; ").alias("errors"))


@query("memory_faults", f"WITH {_TURNS} SELECT conv_id AS seq, 'an entry has no text' AS errors FROM t GROUP BY 1 HAVING count(*) FILTER (trim(text) = '' OR text IS NULL) > 0")
def memory_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.faults(_memories(spark, sf_dir)).filter("size(errors) > 0").select("seq", F.array_join("errors", "; ").alias("errors"))


@query(
    "graph_batch_faults",
    f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'not reached' AS fault, node_id AS key FROM nodes WHERE node_kind <> 'region' AND node_id NOT IN (SELECT target FROM edges) UNION ALL SELECT 'unknown node', node_id FROM nodes WHERE node_kind = 'part' AND status = 'none'",
)
def graph_batch_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = views.nodes(spark, sf_dir), graph.written(views.edges(spark, sf_dir).select("source", "target"))
    roots = n.filter("node_kind = 'region'").select(F.lit("batch").alias("request_id"), F.col("node_id").alias("root"))
    return ingest.batch_faults(n, e, roots, 6)


@query("generated_graphs", "SELECT 'meso' AS preset, CAST(10 * 21 AS BIGINT) AS nodes, CAST(10 * 20 AS BIGINT) AS edges UNION ALL SELECT 'micro', 40, 30 UNION ALL SELECT 'stress', 490, 480")
def generated_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name, chain, branches in (("micro", 3, 0), ("meso", 5, 3), ("stress", 8, 5)):
        nodes, edges = ingest.generated(spark, 10, chain, branches)
        one = nodes.agg(F.lit(name).alias("preset"), F.count("*").alias("nodes")).join(edges.agg(F.lit(name).alias("preset"), F.count("*").alias("edges")), "preset")
        rows = one if rows is None else rows.union(one)
    return rows


@query(
    "tier_classification",
    f"""WITH {_ORDER_EDGES},
n AS (SELECT DISTINCT request_id, node_id FROM (SELECT request_id, source AS node_id FROM oe UNION ALL SELECT request_id, target FROM oe)),
i AS (SELECT request_id, CASE WHEN node_id = request_id THEN 1 ELSE 2 END AS tier FROM n UNION ALL SELECT request_id, CASE WHEN semantic_class IN ('causal', 'motivational', 'evidential', 'constraint') THEN 1 ELSE 2 END FROM oe)
SELECT request_id, CAST(tier AS INTEGER) AS tier, count(*) AS items FROM i GROUP BY 1, 2""",
)
def tier_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _order_edges(spark, sf_dir)
    n = e.select("request_id", F.explode(F.array("source", "target")).alias("node_id"))
    roots = e.select("request_id", F.col("request_id").alias("root")).distinct()
    return render.classified(n, e, roots).groupBy("request_id", "tier").agg(F.count("*").alias("items"))


@query(
    "l0_summary",
    f"""WITH {_ORDER_EDGES}, {NODES_SQL},
s AS (SELECT request_id, arg_min(source || ' > ' || target, (coalesce(sequence, 4611686018427387904), source, target)) AS nxt FROM oe WHERE semantic_class = 'causal' GROUP BY 1)
SELECT r.request_id, 'Objective: ' || title || '. Status: ' || status || coalesce('. Next: ' || nxt, '') AS summary
FROM (SELECT DISTINCT request_id FROM oe) r JOIN nodes ON node_id = r.request_id LEFT JOIN s ON s.request_id = r.request_id""",
)
def l0_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _order_edges(spark, sf_dir)
    roots = e.select("request_id", F.col("request_id").alias("root")).distinct()
    return render.summary(views.nodes(spark, sf_dir), e, roots)


@query("iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:00Z') AS iso FROM orders")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" (Mon) "), F.date_format("o_orderdate", "HH:mm"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", corpus.iso_date(text).alias("iso"))


@query("text_chunks", "SELECT p_partkey, CAST(2 AS BIGINT) AS chunks FROM part")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("1. "), F.col("p_name"), F.lit("\nintro\n2. "), F.col("p_type"))
    return views.table(spark, sf_dir, "part").select("p_partkey", F.size(corpus.chunks(text)).cast("long").alias("chunks"))


@query("question_operations", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'sum' WHEN 1 THEN 'count' WHEN 2 THEN 'average' ELSE 'unknown' END AS operation FROM orders")
def question_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(F.lit("What is the total?"), F.lit("How many parts?"), F.lit("The mean price?"), F.lit("Who?")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", corpus.operation(q).alias("operation"))


@query("anonymous_refs", "WITH f AS (SELECT l_orderkey AS row_id, 'part:' || l_partkey AS ref, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2) SELECT row_id, ref, 'ref_' || row_number() OVER (PARTITION BY row_id ORDER BY place, ref) AS alias FROM f")
def anonymous_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.anonymous(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("ref"), F.col("l_linenumber").alias("place")))


@query("run_inventory", "SELECT event_type AS run, count(*) AS refs FROM events GROUP BY 1")
def run_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run_inventory(views.table(spark, sf_dir, "events").select(F.concat(F.lit("run:"), F.col("event_type"), F.lit(":task_type:x:"), F.col("event_id").cast("string")).alias("ref")))


@query("ref_audit", "SELECT 'part:' || p_partkey AS ref, 'missing' AS fault FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def ref_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string")).alias("ref")
    return corpus.ref_audit(views.table(spark, sf_dir, "part").select(ref("p_partkey")), views.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(ref("l_partkey")))


@query(
    "policy_rates",
    "SELECT l_linestatus AS mode, count(*) AS predictions, round(count(*) FILTER (l_discount < 0.08) / count(*), 6) AS valid_rate, round(count(*) FILTER (l_discount < 0.08 AND l_returnflag = 'R') / count(*) FILTER (l_discount < 0.08), 6) AS tool_rate, round(count(*) FILTER (l_discount < 0.08 AND l_returnflag = 'R' AND l_linenumber = 1) / count(*) FILTER (l_discount < 0.08 AND l_returnflag = 'R'), 6) AS exact_rate FROM lineitem GROUP BY 1",
)
def policy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("mode"), F.lit("R").alias("tool"), F.when(F.col("l_discount") < 0.08, F.col("l_returnflag")).alias("predicted_tool"), F.lit(1).alias("args"), F.col("l_linenumber").alias("predicted_args"))
    return corpus.policy_rates(p).withColumns({c: F.round(c, 6) for c in ("valid_rate", "tool_rate", "exact_rate")})


@query("writer_lifecycle", "SELECT user_id AS entry, max(event_id) FILTER (event_type = 'view') AS read_at, arg_max(CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'commit' ELSE event_type END, event_id) AS state FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0")
def writer_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "commit").otherwise(F.col("event_type"))
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), kind.alias("kind"), F.col("event_id").alias("at"))
    return corpus.lifecycle(e).filter("read_at is not null").select("entry", "read_at", "state")
