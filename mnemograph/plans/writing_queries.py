"""Queries of writers' requests: plans, what was read, writes and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.kernel import Consumer, Memory
from mnemograph.operators import ingest, writing
from mnemograph.sources import views

from .memory_queries import _ledger
from .registry import query

_LINE = ("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order: a decision tied to the parts of its lines, some of which it has read."""
    o, n = F.col("o_orderkey"), F.col("l_linenumber")
    part, flag = F.concat(F.lit("part:"), F.col("l_partkey").cast("string")), F.col("l_returnflag")
    link = F.struct(part.alias("ref"), F.when(flag == "A", "depends-on").when(flag == "R", "Corrects").otherwise("answers").alias("rel"), F.when(n == 6, "structural").when(flag == "A", "causal").otherwise("evidential").alias("class"), flag.alias("why"), F.col("l_linestatus").alias("evidence"), F.when(n == 2, "low").alias("confidence"))
    lines = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(*_LINE, link.alias("link")))).alias("x"),
        F.collect_list(F.when(F.col("l_linestatus") == "F", part)).alias("inspected"),
        F.collect_list(F.when(n == 1, part)).alias("met"),
        F.collect_list(F.when(n == 2, F.struct(part.alias("from"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("to"), F.lit(None).cast("array<string>").alias("refs")))).alias("traced"),
    )
    key = o.cast("string")
    null = F.lit(None).cast("string")
    columns = {
        "seq": o,
        "about": F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")),
        "intent": F.when(o % 17 == 0, "guess").otherwise("record_decision"),
        "actor": F.lit("clerk"),
        "observed_at": F.col("o_orderdate").cast("string"),
        "idempotency_key": F.concat(F.lit("ingest:w"), F.floor(o / 2).cast("string")),
        "source_kind": null,
        "scope": F.struct(F.lit("orders").alias("process"), F.when(o % 2 == 0, F.lit("even")).alias("task"), null.alias("episode")),
        "options": F.struct((o % 3 == 0).alias("dry_run"), (o % 4 < 2).alias("strict"), F.lit(None).cast("long").alias("sequence")),
        "current": F.struct(null.alias("ref"), F.lit("decision").alias("kind"), F.concat(F.lit("Order "), key).alias("summary"), F.when(o % 19 != 0, "seen").alias("evidence")),
        "read_context": F.struct(F.col("inspected").alias("inspected_refs"), F.col("met").alias("temporal_refs"), F.lit(None).cast("array<string>").alias("wake_refs"), F.lit(None).cast("array<string>").alias("ask_refs"), F.col("traced").alias("trace_paths")),
        "connect_to": F.transform("x", lambda x: x["link"]),
        "semantic_delta": F.when(o % 5 == 0, F.struct(null.alias("ref"), F.lit("open").alias("from"), F.concat(F.lit("Closed "), key).alias("to"), F.lit("paid").alias("why"), F.lit("bill").alias("evidence"))),
    }
    joined = views.table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(*(c.cast(writing.REQUEST[n].dataType).alias(n) for n, c in columns.items()))


_PLANS = """
l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS n, l_linenumber AS ln, l_partkey AS p, l_returnflag AS f,
    bool_or(l_linestatus = 'F' OR l_linenumber IN (1, 2)) OVER (PARTITION BY l_orderkey, l_partkey) AS seen, l_orderkey % 4 < 2 AS strict FROM lineitem),
d AS (
  SELECT o, n, strict, f <> 'N' AS rich, seen, f <> 'N' AS needed, ln = 6 AS wrong, ln = 2 AS low FROM l
  UNION ALL SELECT o, 1000, strict, true, true, false, false, false FROM l WHERE n = 1 AND o % 5 = 0
  UNION ALL SELECT o, 1001, strict, true, seen, true, false, false FROM l WHERE n = 1 AND o % 5 = 0),
q AS (SELECT *, rich AND NOT strict AND (NOT seen OR low) AS doubted FROM d),
m AS (SELECT o, count(*) AS total, count(*) FILTER (rich AND NOT doubted) AS rich, count(*) FILTER (NOT rich) AS anemic, count(*) FILTER (doubted) AS suspect, count(*) FILTER (needed) AS needed, count(*) FILTER (needed AND seen) AS read FROM q GROUP BY o),
e AS (
  SELECT o, n, CASE WHEN wrong THEN 'a relation''s type can not have its class' ELSE 'a rich relation''s target has not been read' END AS text FROM d WHERE wrong OR strict AND rich AND NOT seen
  UNION ALL SELECT DISTINCT o, -2, 'the intent is unknown' FROM l WHERE o % 17 = 0
  UNION ALL SELECT DISTINCT o, -1, 'a strict request has no evidence' FROM l WHERE strict AND o % 19 = 0),
u AS (SELECT o, string_agg(text, '; ' ORDER BY n) AS errors FROM (SELECT o, text, min(n) AS n FROM e GROUP BY ALL) GROUP BY o)"""


@query(
    "write_plans",
    f"WITH {_PLANS.strip()} SELECT m.o AS seq, coalesce(errors, '') AS errors, total, rich, anemic, suspect, needed, m.read AS read, CASE WHEN m.o % 5 = 0 THEN 2 ELSE 1 END AS entries FROM m LEFT JOIN u ON u.o = m.o",
)
def write_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = writing.plans(_requests(spark, sf_dir))
    return planned.select("seq", F.array_join("errors", "; ").alias("errors"), *(F.col(f"metrics.{n}").cast("long").alias(n) for n in ("total", "rich", "anemic", "suspect", "needed", "read")), F.size("generated_refs").alias("entries"))


@query(
    "writer_writes",
    f"""WITH {_PLANS.strip()},
v AS (SELECT m.o, o_custkey AS c, u.errors, m.o % 3 = 0 AS dry FROM m LEFT JOIN u ON u.o = m.o JOIN orders ON o_orderkey = m.o),
k AS (SELECT o, c, row_number() OVER (PARTITION BY o // 2 ORDER BY o) AS nth FROM v WHERE errors IS NULL AND NOT dry),
r AS (SELECT *, CASE WHEN nth = 1 THEN count(*) FILTER (nth = 1) OVER (PARTITION BY c ORDER BY o) END AS revision FROM k)
SELECT v.o AS seq, CASE WHEN errors IS NOT NULL THEN 'invalid' WHEN dry THEN 'dry run' WHEN nth = 1 THEN 'accepted' ELSE 'key conflict' END AS outcome, coalesce(revision, 0) AS revision FROM v LEFT JOIN r ON r.o = v.o""",
)
def writer_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some requests are dry runs, some have faults, and two orders may share a key."""
    return writing.write_memory(_ledger(spark), _requests(spark, sf_dir))[0].select("seq", "outcome", F.coalesce("revision", F.lit(0)).alias("revision"))


@query(
    "read_index",
    """WITH p AS (
  SELECT l_orderkey AS o, 'part:' || l_partkey AS ref_id, unnest([CASE WHEN l_linestatus = 'F' THEN 'kernel_inspect' END, CASE l_linenumber WHEN 1 THEN 'kernel_temporal' WHEN 2 THEN 'kernel_trace' END]) AS tool FROM lineitem
  UNION ALL SELECT l_orderkey, 'order:' || l_orderkey, 'kernel_trace' FROM lineitem WHERE l_linenumber = 2)
SELECT o AS seq, ref_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM p WHERE tool IS NOT NULL AND o IN (SELECT o_orderkey FROM orders) GROUP BY ALL""",
)
def read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.read_index(_requests(spark, sf_dir)).withColumn("tools", F.array_join("tools", ","))


@query(
    "writer_candidates",
    """WITH c AS (
  SELECT DISTINCT l_orderkey AS o, l_orderkey % 4 AS own, l_orderkey % 3 AS kind,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'about:m:dimension:' || l_linenumber ELSE 'm:subtask:' || l_linenumber - 2 || CASE WHEN l_returnflag = 'R' THEN ':question' WHEN l_returnflag = 'A' THEN ':answer' ELSE ':note' END END AS ref,
    CASE WHEN l_returnflag = 'R' THEN 'question' WHEN l_returnflag = 'A' THEN 'answer' END AS turn, CASE WHEN l_returnflag <> 'N' THEN l_orderkey % 4 - (l_linenumber - 2) END AS gap, l_returnflag = 'N' AND l_linestatus = 'O' AS dim FROM lineitem),
r AS (SELECT *, CASE WHEN dim THEN 'dimension_scope' WHEN turn IS NULL THEN 'unknown' ELSE CASE WHEN gap = 0 THEN 'same' WHEN gap = 1 THEN 'previous' WHEN gap > 1 THEN 'older' ELSE 'future' END || '_subtask_' || turn END AS role FROM c),
p AS (SELECT *, CASE
    WHEN kind = 0 AND role = 'same_subtask_question' THEN 10 WHEN kind = 0 AND role = 'previous_subtask_answer' THEN 30 WHEN kind = 0 AND role = 'previous_subtask_question' THEN 40
    WHEN kind = 1 AND role = 'previous_subtask_answer' THEN 10 WHEN kind = 1 AND role = 'previous_subtask_question' THEN 30 WHEN kind = 1 AND role = 'older_subtask_answer' THEN 50
    WHEN role = 'same_subtask_question' THEN 30 WHEN role = 'previous_subtask_answer' THEN 40 WHEN role = 'dimension_scope' THEN 90 ELSE 80 END AS priority FROM r)
SELECT o AS seq, ref, role, coalesce(turn, 'unknown') AS turn_kind, priority, row_number() OVER (PARTITION BY o ORDER BY priority, ref) AS place FROM p""",
)
def writer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, flag = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")
    entry = F.concat(F.lit("m:subtask:"), (o % 4).cast("string"), F.lit(":question:own"))
    kind = F.when(o % 3 == 0, "subtask_answer_feedback").when(o % 3 == 1, "subtask_question").otherwise("note")
    turn = F.concat(F.lit("m:subtask:"), (n - 2).cast("string"), F.when(flag == "R", ":question").when(flag == "A", ":answer").otherwise(":note"))
    ref = F.when((flag == "N") & (F.col("l_linestatus") == "O"), F.concat(F.lit("about:m:dimension:"), n.cast("string"))).otherwise(turn)
    found = views.table(spark, sf_dir, "lineitem").select(o.alias("seq"), entry.alias("entry_ref"), kind.alias("entry_kind"), ref.alias("ref"))
    return writing.ranked_candidates(found).select("seq", "ref", "role", "turn_kind", "priority", "place")


@query(
    "consumer_recall",
    """SELECT 'nation:' || n_nationkey AS request_id, 'nation:' || n_nationkey AS about, count(c_custkey) + 1 AS nodes, count(c_custkey) AS relationships, CAST(0 AS BIGINT) AS details, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS revision, 'UNKNOWN' AS answer
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
)
def consumer_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recorded of every second nation, and what a consumer recalls of all."""
    roots = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("root"))
    nodes = views.nodes(spark, sf_dir)
    consumer = Consumer(Memory(nodes, views.edges(spark, sf_dir), nodes.limit(0).select("node_id", F.lit("").alias("detail"))), _ledger(spark))
    fields = {
        "seq": F.col("seq"),
        "about": F.col("root"),
        "dimensions": F.array(F.struct(F.lit("d").alias("id"), F.lit("d").alias("kind"), F.lit("d").alias("title"))),
        "entries": F.from_json(F.to_json(F.array(F.struct(F.concat(F.lit("entry:"), "root").alias("id"), F.lit("note").alias("kind"), F.lit("seen").alias("text"), F.array(F.struct(F.lit("d").alias("dimension"))).alias("coordinates")))), ingest.MEMORY["entries"].dataType),
        "relations": F.array().cast(ingest.MEMORY["relations"].dataType),
        "evidence": F.array().cast(ingest.MEMORY["evidence"].dataType),
    }
    consumer.record(roots.filter("seq % 2 = 0").select(*(c.alias(n) for n, c in fields.items())))
    asked = roots.select(F.col("root").alias("request_id"), "root")
    return consumer.ask(asked, 1).select("request_id", "about", "nodes", "relationships", "details", "revision", "answer")
