"""Queries of dumps, shown texts, scopes, references and lines over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.functions import scalars
from mnemograph.operators import evaluate, render, temporal
from mnemograph.sources import views
from mnemograph.sources.views import EDGES_SQL, NODES_SQL

from .registry import query

_NATIONS = f"""{NODES_SQL}, {EDGES_SQL}, ne AS (SELECT source AS request_id, * FROM edges WHERE source LIKE 'nation:%'),
line AS (
  SELECT 'nation:' || n_nationkey AS request_id, 0 AS phase, '' AS a, 'Node: nation:' || n_nationkey || '. Kind: nation. Summary: .' AS line FROM nation
  UNION ALL SELECT request_id, 1, node_id, 'Node: ' || node_id || '. Kind: ' || node_kind || '. Summary: ' || summary || '.' || CASE WHEN node_kind = 'customer' THEN ' Detail: ' || title || '.' ELSE '' END FROM ne JOIN nodes ON node_id = target
  UNION ALL SELECT request_id, 2, target, 'Relationship: ' || source || ' connects to ' || target || ' via ' || relation_type || '. Semantic class: ' || semantic_class || '.' FROM ne),
dumps AS (SELECT request_id, string_agg(line, chr(10) ORDER BY phase, a) || chr(10) AS dump FROM line GROUP BY 1)"""


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir).filter(F.col("source").startswith("nation:")).withColumn("request_id", F.col("source"))
    roots = views.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("root")).withColumn("request_id", F.col("root"))
    ids = e.select("request_id", F.col("target").alias("node_id")).union(roots.select("request_id", "root"))
    nodes = views.nodes(spark, sf_dir).join(ids, "node_id")
    details = nodes.filter("node_kind = 'customer'").select("request_id", "node_id", F.col("title").alias("detail"))
    return render.raw_dump(roots, nodes, e, details)


@query("raw_dump", f"WITH {_NATIONS} SELECT request_id, dump FROM dumps")
def raw_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dumps(spark, sf_dir)


@query("compression_ratio", f"WITH {_NATIONS} SELECT request_id, len(regexp_split_to_array(trim(dump, ' ' || chr(10)), '\\s+')) AS raw_tokens, CASE WHEN request_id = 'nation:0' THEN 1.0 ELSE len(regexp_split_to_array(trim(dump, ' ' || chr(10)), '\\s+')) / 10 END AS compression_ratio FROM dumps")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = _dumps(spark, sf_dir).withColumn("dump", F.regexp_replace("dump", "\n$", ""))
    return render.compression(dumps, dumps.select("request_id", F.when(F.col("request_id") == "nation:0", 0).otherwise(10).alias("tokens")))


@query(
    "shown_texts",
    """WITH t AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text, min(role) AS role FROM conversations GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t),
g AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS tier, arg_min(text, turn) FILTER (trim(text) <> '') AS section,
  string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole, string_agg(text, '|' ORDER BY turn) FILTER (n <= 5 AND trim(text) <> '') AS state FROM n GROUP BY 1)
SELECT conv_id AS request_id, coalesce(tier, section, whole) AS summary, coalesce(state, CASE WHEN section IS NULL THEN '' ELSE whole END) AS current_state FROM g""",
)
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("content"), F.min("role").alias("role")).withColumnRenamed("conv_id", "request_id")
    tiers = t.filter("role = 'assistant'").select("request_id", F.col("turn").alias("tier"), "content")
    return render.shown(t.select("request_id", F.col("turn").alias("ord"), "content"), tiers).withColumn("current_state", F.array_join("current_state", "|"))


@query(
    "requested_scopes",
    """WITH c AS (SELECT c_custkey AS k, 'n' || c_nationkey AS about, lower(c_mktsegment) AS d FROM customer)
SELECT k AS request_id, CASE k % 4 WHEN 0 THEN 'about:' || about || ':dimension:' || d || ',about:' || about || ':dimension:time'
  WHEN 1 THEN 'about:a:dimension:' || d || ',about:a:dimension:time,about:b:dimension:' || d || ',about:b:dimension:time'
  WHEN 2 THEN array_to_string(list_sort(['about:' || about || ':dimension:' || d, 'about:' || about || ':dimension:own']), ',') ELSE '' END AS scopes,
  CASE about WHEN 'n5' THEN 'n5,n1,n9' WHEN 'n9' THEN 'n9,n1,n5' ELSE 'n1,n5,n9' END AS roots FROM c""",
)
def requested_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, about = F.col("c_custkey") % 4, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    d = F.lower("c_mktsegment")
    words = lambda *xs: F.array(*(F.lit(x) for x in xs))
    own = F.array(F.concat(F.lit(" "), d), F.concat(F.lit("about:"), about, F.lit(":dimension:own")), F.lit("about:other:dimension:x"), F.lit(" "), d)
    requests = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), about.alias("current"), F.when(case == 3, "except").otherwise("only").alias("mode"), F.when(case == 1, "abouts").otherwise("current").alias("scope_mode"), F.array(F.lit("time"), d, F.lit(" "), F.lit("time")).alias("dimensions"),
        words("b", "a", "b").alias("abouts"), words("n9", " n1", "", "n5", "n1").alias("roots"), F.when(case == 2, own).otherwise(F.expr("cast(array() as array<string>)")).alias("scope_ids"),
    )
    roots = requests.select("request_id", F.array_join(temporal.about_roots(F.col("roots"), F.col("current")), ",").alias("roots"))
    return temporal.requested_scopes(requests).join(roots, "request_id").withColumn("scopes", F.array_join("scopes", ","))


@query(
    "ref_differences",
    """WITH e AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS ref FROM lineitem WHERE l_returnflag <> 'N'), o AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS ref FROM lineitem WHERE l_linenumber > 1),
f AS (SELECT coalesce(e.k, o.k) AS k, e.ref AS a, o.ref AS b FROM e FULL JOIN o ON e.k = o.k AND e.ref = o.ref)
SELECT k AS l_orderkey, coalesce(string_agg(a, ',' ORDER BY a) FILTER (b IS NULL), '') AS missing, coalesce(string_agg(b, ',' ORDER BY b) FILTER (a IS NULL), '') AS extra FROM f GROUP BY 1""",
)
def ref_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "ref_id")
    found = evaluate.ref_differences(lines.filter("l_returnflag <> 'N'"), lines.filter("l_linenumber > 1"), ["l_orderkey"])
    return found.select("l_orderkey", *(F.array_join(c, ",").alias(c) for c in ("missing", "extra")))


@query(
    "read_lines",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) ELSE 0 END AS number, CASE WHEN p_size > 25 THEN p_size || ' . ' || p_name END AS text,
  p_size % 3 = 0 AS sum_is_math, false AS price_is_math, true AS number_is_math FROM part""",
)
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    line = F.concat(F.lit("  "), F.when(F.col("p_size") > 25, size).otherwise("no"), F.lit(" . "), F.col("p_name"))
    fact = scalars.fact_line(line)
    total = F.concat(F.lit("x"), F.when(F.col("p_size") % 3 == 0, " + y").otherwise(" y "), size)
    return views.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(fact["number"], F.lit(0)).alias("number"), fact["text"].alias("text"), scalars.inline_math(total).alias("sum_is_math"), scalars.inline_math(F.concat(size, F.lit(" and the rest"))).alias("price_is_math"), scalars.inline_math(size).alias("number_is_math"))
