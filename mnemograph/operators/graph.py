"""Bounded traversal over edges (G1 to G10), for a batch of requests at once.

requests: request_id, root. edges: source, target, relation_type. Depth is at most 25, so hops are a short loop of
equi-joins over the edges' distinct ends, which are written once, dealt by their source. Each hop's frontier is written
to the checkpoint folder, which cuts lineage and survives lost executors; one of few rows is broadcast.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.functions import scalars
from mnemograph.sources import views

#: Depth of a traversal that names none, and the deepest one.
DEFAULT_DEPTH, MOST_DEPTH = 10, 25
EDGE_KEY = ["source", "target", "relation_type"]


def depth_of(asked: Column) -> Column:
    """0 is the default; others lie between 1 and the deepest."""
    return F.when(asked == 0, DEFAULT_DEPTH).otherwise(F.greatest(F.lit(1), F.least(asked, F.lit(MOST_DEPTH))))


#: Most rows of a frontier that a hop broadcasts.
FEW = 100_000
#: Nodes that a path is thought to have when its rows are dealt to tasks.
PATH_NODES = 5


def _kept(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not shared and not sc.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or f"file://{tempfile.mkdtemp(prefix='mnemograph-')}")
    return df.checkpoint()


def written(edges: DataFrame) -> DataFrame:
    """edges written to the checkpoint folder, for those who read them more than once."""
    return _kept(edges)


def _steps(edges: DataFrame) -> tuple[DataFrame, int]:
    """node and next of the distinct ends of edges, dealt by node, and how many edges there are."""
    rows = edges.count()
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    return _kept(views.dealt(ends, "node", rows=rows).distinct()), rows


def _met(frontier: DataFrame, rows: int, steps: DataFrame) -> DataFrame:
    return (F.broadcast(frontier) if rows <= FEW else frontier).join(steps, "node")


def reach(edges: DataFrame, requests: DataFrame, depth: int, steps: tuple[DataFrame, int] | None = None) -> DataFrame:
    """G1: request_id, node, hops of the nodes that a request's root reaches in 1 to depth hops, without the root.

    steps: what _steps has made of the edges, if that is at hand. A hop is dealt to tasks by the rows of the larger side.
    """
    frontier = _kept(requests.select("request_id", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct())
    seen = frontier
    for hop in range(1, depth + 1):
        rows = frontier.count()
        if not rows:
            break
        steps = steps or _steps(edges)
        ahead = _met(frontier, rows, steps[0]).select("request_id", F.col("next").alias("node"))
        ahead = views.dealt(ahead, "request_id", "node", rows=max(rows, steps[1])).distinct()
        frontier = _kept(ahead.join(seen.select("request_id", "node"), ["request_id", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def induced(edges: DataFrame, reached: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and the edges between a request's nodes, root included; none for a root that reaches nothing."""
    own = reached.select("request_id", "node")
    nodes = own.union(requests.join(own.select("request_id").distinct(), "request_id", "left_semi").select("request_id", "root")).distinct()
    rows = edges.count()
    from_ = views.dealt(edges, "source", rows=rows).join(nodes.withColumnRenamed("node", "source"), "source")
    return views.dealt(from_, "request_id", "target", rows=rows).join(nodes.withColumnRenamed("node", "target"), ["request_id", "target"]).select("request_id", *edges.columns)


def _found(requests: DataFrame, steps: DataFrame, rows: int, depth: int) -> DataFrame | None:
    """root, target and path of the pairs of requests that have one."""
    open_ = _kept(requests.filter("root <> target").select("root", "target").distinct())
    level = _kept(open_.select("root").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path")))
    seen, found = level.select("root", "node"), None
    for _ in range(depth):
        here = level.count()
        if not here or open_.isEmpty():
            break
        ahead = _met(level, here, steps).select("root", F.col("next").alias("node"), "path")
        ahead = views.dealt(ahead, "root", "node", rows=max(here, rows))
        fresh = ahead.join(seen, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path"))
        level = _kept(fresh.withColumn("path", F.concat("path", F.array("node"))))
        ends = level.withColumnRenamed("node", "target")
        hit = _kept(ends.join(open_, ["root", "target"], "left_semi"))
        found = hit if found is None else found.unionByName(hit)
        open_ = _kept(open_.join(hit.select("root", "target"), ["root", "target"], "left_anti"))
        seen = seen.union(level.select("root", "node"))
    return found


def shortest_paths(edges: DataFrame, requests: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """request_id and path (array of nodes) from root to target; of equal lengths, the smallest path.

    requests: request_id, root, target. A request without a path, or from a node to itself, gives no row. The graph is
    walked once for each distinct root, until the last of its targets is found, and requests are joined at the end.
    """
    return _joined(requests, requests.count(), _found(requests, *_steps(edges), depth))


def _joined(requests: DataFrame, rows: int, found: DataFrame | None) -> DataFrame:
    if found is None:
        return requests.select("request_id", F.array("root").alias("path")).limit(0)
    return views.dealt(requests, "root", "target", rows=rows).join(found, ["root", "target"]).select("request_id", "path")


def context_paths(edges: DataFrame, requests: DataFrame, depth: int) -> DataFrame:
    """request_id and node of the path and of the target's subtree; without a path, the target's neighbourhood."""
    steps, rows = _steps(edges), requests.count()
    found = _found(requests, *steps, MOST_DEPTH)
    paths = _joined(requests, rows, found)
    # Nodes of a path are told apart where their request is, so paths are dealt before they are listed.
    out = views.dealt(paths, "request_id", rows=PATH_NODES * rows).select("request_id", F.explode("path").alias("node"))
    missed = requests if found is None else views.dealt(requests, "root", "target", rows=rows).join(found, ["root", "target"], "left_anti")
    missed = _kept(missed.select("request_id", F.col("target").alias("root")))
    lost = missed if missed.isEmpty() else missed.join(paths.select("request_id"), "request_id", "left_anti")
    if depth:
        below = requests.join(paths.select("request_id"), "request_id", "left_semi").select("request_id", F.col("target").alias("root"))
        out = out.union(reach(edges, below, min(depth, MOST_DEPTH), steps).select("request_id", "node"))
    far = lost.union(reach(edges, lost, DEFAULT_DEPTH, steps).select("request_id", "node")).distinct()
    return out.distinct().union(far)  # a request that has a path is not lost


def relationships(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, direction and edge of the edges into and out of each root."""
    out = requests.join(edges.withColumn("root", F.col("source")), "root").withColumn("direction", F.lit("outgoing"))
    into = requests.join(edges.withColumn("root", F.col("target")), "root").withColumn("direction", F.lit("incoming"))
    return out.unionByName(into).select("request_id", "direction", *edges.columns)


def merged(bundles: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys in a request, the one of the first root (root_rank) stays."""
    rest = [c for c in bundles.columns if c not in (*keys, "request_id")]
    best = bundles.groupBy("request_id", *keys).agg(F.min(F.struct("root_rank", *(c for c in rest if c != "root_rank"))).alias("b"))
    return best.select("request_id", *keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def without_placeholders(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F8: nodes that are no placeholders by their kind, a label or a property, and the edges between such."""
    is_bad = F.col("node_kind") == "placeholder"
    if "labels" in nodes.columns:
        is_bad = is_bad | F.coalesce(F.array_contains("labels", "placeholder"), F.lit(False))
    if "properties" in nodes.columns:
        is_bad = is_bad | F.coalesce(F.col("properties")["placeholder"] == "true", F.lit(False))
    bad = nodes.filter(is_bad).select("node_id")
    kept = nodes.join(bad, "node_id", "left_anti")
    clean = edges.join(bad.withColumnRenamed("node_id", "source"), "source", "left_anti").join(bad.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return kept, clean.select(edges.columns)


def broken(nodes: DataFrame, edges: DataFrame, details: DataFrame) -> DataFrame:
    """Fault and key of duplicate nodes, and of edges and details outside the nodes."""
    ids = nodes.select("node_id").distinct()
    twice = nodes.groupBy("node_id").count().filter("count > 1").select(F.lit("duplicate node").alias("fault"), F.col("node_id").alias("key"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"), F.concat_ws(" ", *EDGE_KEY).alias("key"))
    loose = ends.join(ids, "node_id", "left_anti").select(F.lit("edge outside").alias("fault"), "key").distinct()
    stray = details.join(ids, "node_id", "left_anti").select(F.lit("detail outside").alias("fault"), F.col("node_id").alias("key"))
    return twice.union(loose).union(stray)


def ordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Place of each node of a request by (node_id, kind, title), and of each edge by (source, target, type)."""
    first = Window.partitionBy("request_id").orderBy("node_id", "node_kind", "title")
    second = Window.partitionBy("request_id").orderBy(*EDGE_KEY)
    return nodes.withColumn("place", F.row_number().over(first).cast("long")), edges.withColumn("place", F.row_number().over(second).cast("long"))


def conflicts(edges: DataFrame) -> DataFrame:
    """request_id, place and text of the edges that contradict, each text once at its first place.

    edges: request_id, place, source, target, relation_type, and rationale and evidence where they are known.
    """
    said = [F.when(F.trim(c) != "", F.concat(F.lit(": "), F.trim(c))) for c in ("rationale", "evidence") if c in edges.columns]
    relation = scalars.relation_type(F.col("relation_type"))
    text = F.concat(F.concat_ws(" ", F.col("source"), relation, F.col("target")), F.coalesce(*said, F.lit("")))
    said = edges.filter(relation == "contradicts").select("request_id", "place", text.alias("text"))
    return said.groupBy("request_id", "text").agg(F.min("place").alias("place")).select("request_id", "place", "text")


def existing(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, refs (sorted array of what the root's edges name, root included)."""
    out = requests.join(edges.select(F.col("source").alias("root"), F.col("target").alias("ref")), "root")
    into = requests.join(edges.select(F.col("target").alias("root"), F.col("source").alias("ref")), "root")
    every = out.select("request_id", "ref").union(into.select("request_id", "ref")).union(requests.select("request_id", "root"))
    return every.groupBy("request_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def touched(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """edges of a request with an end among its selected nodes (request_id, node)."""
    ends = edges.withColumn("node", F.explode(F.array_distinct(F.array("source", "target"))))
    return ends.join(selected.distinct(), ["request_id", "node"], "left_semi").drop("node").distinct()
