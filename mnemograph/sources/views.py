"""Nodes, edges and positions of the memory model over the relational tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.functions import scalars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(df: DataFrame) -> Column:
    """Where a row of a table lies: the name of its file, if there are several, and its number in the file."""
    row = F.col("_metadata.row_index")
    return F.struct("_metadata.file_name", row) if len(df.inputFiles()) > 1 else F.struct(row)


#: Most rows that a task gets of a table which is spread.
SPREAD_ROWS = 200_000


def spread(df: DataFrame, most: int = SPREAD_ROWS) -> DataFrame:
    """df dealt to all cores, and to more tasks where those would get more than so many rows each: for costly work on each row.
    Tables whose files give as many splits stay as they are read; rows are counted by the files' footers."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def dealt(df: DataFrame, *keys: str, rows: int | None = None, most: int = SPREAD_ROWS) -> DataFrame:
    """df dealt by keys, to so many tasks that each gets about so many rows; where that is no more than the cores, Spark chooses.
    rows: how many there are, if it is known; else they are counted."""
    tasks = -(-(df.count() if rows is None else rows) // most)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


#: Each kind of node: its table, key, title, summary and status.
NODE_TABLES = {
    "region": ("region", "r_regionkey", "r_name", "''", "'ACTIVE'"),
    "nation": ("nation", "n_nationkey", "n_name", "''", "'ACTIVE'"),
    "customer": ("customer", "c_custkey", "c_name", "c_mktsegment", "'ACTIVE'"),
    "order": ("orders", "o_orderkey", "concat('Order ', cast(o_orderkey as string))", "o_orderpriority", "o_orderstatus"),
    "supplier": ("supplier", "s_suppkey", "s_name", "''", "'ACTIVE'"),
    "part": ("part", "p_partkey", "p_name", "p_type", "'ACTIVE'"),
}


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def nodes_of(rows: DataFrame, kind: str) -> DataFrame:
    """Nodes of one kind, out of the rows of its table, with the table's key."""
    _, key, title, summary, status = NODE_TABLES[kind]
    return rows.select(F.col(key).alias("key"), node_id(kind, F.col(key)).alias("node_id"), F.lit(kind).alias("node_kind"), F.expr(title).alias("title"), F.expr(summary).alias("summary"), F.expr(status).alias("status"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, node_kind, title, summary, status."""
    parts = [nodes_of(table(spark, sf_dir, of[0]), kind).drop("key") for kind, of in NODE_TABLES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def line_kind() -> Column:
    """What a line's flag says of its edge: R, A or nothing."""
    flag = F.col("l_returnflag")
    return F.when(flag.isin("R", "A"), flag).otherwise("")


def line_edge() -> list[Column]:
    """The edge of lines of one order, part and kind, of l_orderkey, l_partkey, kind and sequence."""
    return [
        node_id("order", F.col("l_orderkey")).alias("source"),
        node_id("part", F.col("l_partkey")).alias("target"),
        F.when(F.col("kind") == "R", "contradicts").when(F.col("kind") == "A", "depends_on").otherwise("records").alias("relation_type"),
        F.when(F.col("kind") == "R", "evidential").when(F.col("kind") == "A", "causal").otherwise("structural").alias("semantic_class"),
        F.col("sequence").cast("long").alias("sequence"),
    ]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation_type, semantic_class, sequence; one row for each (source, target, type)."""

    def inside(name: str, kind: str, key: str, up: str, up_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{up}:"), F.col(up_key).cast("string")).alias("source"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("target"), F.lit("contains").alias("relation_type"), F.lit("structural").alias("semantic_class"), F.lit(None).cast("long").alias("sequence")
        )

    # Grouped by the numbers; the names are made of what is left. Few lines fall together, so they are dealt before.
    lines = (
        dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber"), "l_orderkey")
        .groupBy("l_orderkey", "l_partkey", line_kind().alias("kind"))
        .agg(F.max("l_linenumber").alias("sequence"))
        .select(*line_edge())
    )
    return inside("nation", "nation", "n_nationkey", "region", "n_regionkey").unionByName(inside("customer", "customer", "c_custkey", "nation", "c_nationkey")).unionByName(inside("orders", "order", "o_orderkey", "customer", "o_custkey")).unionByName(lines)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """about, dimension, scope_id, ref_id, occurred_at, sequence of every event; sequence counts a user's events."""
    e = table(spark, sf_dir, "events")
    about = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return e.select(
        about.alias("about"),
        F.col("event_type").alias("dimension"),
        scalars.dimension_identity(about, F.col("event_type")).alias("scope_id"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("ref_id"),
        F.col("ts").alias("occurred_at"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("sequence"),
    )


NODES_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_kind, r_name AS title, '' AS summary, 'ACTIVE' AS status FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, '', 'ACTIVE' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_mktsegment, 'ACTIVE' FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'Order ' || o_orderkey, o_orderpriority, o_orderstatus FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, '', 'ACTIVE' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_type, 'ACTIVE' FROM part)"""

EDGES_SQL = """
edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS relation_type, 'structural' AS semantic_class, CAST(NULL AS BIGINT) AS sequence FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'structural', NULL FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'contains', 'structural', NULL FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey,
    CASE l_returnflag WHEN 'R' THEN 'contradicts' WHEN 'A' THEN 'depends_on' ELSE 'records' END,
    CASE l_returnflag WHEN 'R' THEN 'evidential' WHEN 'A' THEN 'causal' ELSE 'structural' END, CAST(max(l_linenumber) AS BIGINT)
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

ENTRIES_SQL = """
entries AS (
  SELECT 'user:' || user_id AS about, event_type AS dimension, 'about:user:' || user_id || ':dimension:' || event_type AS scope_id,
    'event:' || event_id AS ref_id, ts AS occurred_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence
  FROM events)"""

#: One row for each axis that an entry has; keys are strings that sort as their values do.
POSITIONS_SQL = (
    ENTRIES_SQL
    + """,
positions AS (
  SELECT about, dimension, scope_id, ref_id, 0 AS axis,
    'unix:' || lpad(CAST(epoch_us(occurred_at) // 1000000 + 100000000000 AS VARCHAR), 12, '0') || ':' || lpad(CAST((epoch_us(occurred_at) % 1000000) * 1000 AS VARCHAR), 9, '0') AS key FROM entries
  UNION ALL SELECT about, dimension, scope_id, ref_id, 1, lpad(CAST(sequence AS VARCHAR), 10, '0') FROM entries)"""
)
