"""Selections of dimensions: their faults, and bundles cut down to what they select.

A selection has mode (all, only, except), include and exclude (dimensions), scope_mode (current, abouts, all), abouts and
scope_ids. Null arrays are empty, a null mode is all and a null scope_mode is current.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.functions import scalars

#: Kinds of nodes that are evidence, and the kind of a subject's own node.
EVIDENCE = ("memory_evidence", "evidence")
ANCHOR = "memory_anchor"


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def faults(requests: DataFrame) -> DataFrame:
    """requests with `faults`: what stands against each selection, in words; empty if nothing does."""
    mode, scope = F.coalesce("mode", F.lit("all")), F.coalesce("scope_mode", F.lit("current"))
    some = lambda c: F.size(c) > 0
    include, exclude = _list("include"), _list("exclude")
    named = F.filter(_list("abouts"), lambda a: F.trim(a) != "")
    checks = {
        "unknown mode": ~mode.isin("all", "only", "except"),
        "only requires include": (mode == "only") & ~some(include),
        "only must not set exclude": (mode == "only") & some(exclude),
        "except requires exclude": (mode == "except") & ~some(exclude),
        "except must not set include": (mode == "except") & some(include),
        "all must not set include or exclude": (mode == "all") & (some(include) | some(exclude)),
        "unknown scope mode": ~scope.isin("current", "abouts", "all"),
        "current must not set abouts": (scope == "current") & some(named),
        "abouts requires abouts": (scope == "abouts") & ~some(named),
        "all abouts must not set abouts": (scope == "all") & some(named),
    }
    return requests.withColumn("faults", F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items()))))


def includes(dimension: Column, scope_id: Column) -> Column:
    """whether a coordinate passes the selection that stands beside it (F1 and F2 and F3), with its root as the current about."""
    mode, scope = F.coalesce("mode", F.lit("all")), F.coalesce("scope_mode", F.lit("current"))
    dimension, scope_id = F.coalesce(dimension, F.lit("")), F.coalesce(scope_id, F.lit(""))
    kind = F.when(mode == "only", F.array_contains(_list("include"), dimension)).when(mode == "except", ~F.array_contains(_list("exclude"), dimension)).otherwise(True)
    own = scalars.scope_about(scope_id)
    trimmed = F.transform(_list("abouts"), lambda a: F.trim(a))
    about = F.when(scope == "all", True).when(scope == "abouts", F.coalesce(F.array_contains(trimmed, own), F.lit(False))).otherwise(F.coalesce(own == F.col("root"), F.lit(False)))
    asked = _list("scope_ids")
    exact = (F.size(asked) == 0) | F.array_contains(asked, scope_id) | F.coalesce(F.array_contains(asked, scalars.scope_dimension(scope_id)), F.lit(False))
    return kind & about & exact


def selected(nodes: DataFrame, edges: DataFrame, details: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """the nodes, edges and details of each request's bundle that its selection keeps.

    nodes: request_id, node_id, node_kind; edges: request_id, source, target, relation_type, dimension, scope_id;
    details: request_id, node_id; requests: request_id, root and the selection. Kept are the root, the scopes and entries
    of the coordinates (contains_entry) that the selection includes, and evidence that supports such an entry; of other
    edges those with both ends kept. Every step is an equi-join on the request and the node.
    """
    key = ["request_id", "node_id"]
    rule = requests.select("request_id", "root", "mode", "include", "exclude", "scope_mode", "abouts", "scope_ids")
    at = edges.filter("relation_type = 'contains_entry'").join(rule, "request_id").filter(includes(F.col("dimension"), F.col("scope_id"))).select(*edges.columns)
    entries = at.select("request_id", "target").distinct()
    proof = nodes.filter(F.col("node_kind").isin(*EVIDENCE)).select("request_id", F.col("node_id").alias("source"))
    support = edges.filter("relation_type = 'supports'").select("request_id", "source", "target").join(entries, ["request_id", "target"], "left_semi").join(proof, ["request_id", "source"], "left_semi")
    ends = at.select("request_id", F.explode(F.array("source", "target")).alias("node_id"))
    kept = requests.select("request_id", F.col("root").alias("node_id")).union(ends).union(support.select("request_id", "source")).distinct()
    end = lambda c: kept.withColumnRenamed("node_id", c)
    others = edges.filter("relation_type <> 'contains_entry'").join(end("source"), ["request_id", "source"], "left_semi").join(end("target"), ["request_id", "target"], "left_semi")
    return {"nodes": nodes.join(kept, key, "left_semi"), "edges": at.unionByName(others.select(*edges.columns)), "details": details.join(kept, key, "left_semi")}


def abouts(nodes: DataFrame, requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """request_id, place and about: the root, then the bundle's anchors in the order of their ids, then the subjects of
    the scope ids (request_id, scope_id), each once."""
    root = requests.select("request_id", F.lit(0).alias("step"), F.col("root").alias("about"))
    anchors = nodes.filter(F.col("node_kind") == ANCHOR).select("request_id", F.lit(1), "node_id")
    named = scopes.select("request_id", F.lit(2), scalars.scope_about(F.col("scope_id")).alias("about")).filter("about is not null")
    once = root.union(anchors).union(named).groupBy("request_id", "about").agg(F.min("step").alias("step"))
    listed = once.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("step", "about"))).alias("all"))
    return listed.select("request_id", F.posexplode("all").alias("place", "x")).select("request_id", F.col("place").cast("long").alias("place"), "x.about")
