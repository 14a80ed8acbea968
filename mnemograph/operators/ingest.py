"""Memories written: checks, mutations, graph batches and a generator of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.functions import scalars
from mnemograph.operators import graph, projection
from mnemograph.sources import views

_TEXT = T.StringType()


def _struct(*names: str, **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in names] + [T.StructField(n, t) for n, t in others.items()])


COORDINATE = _struct("dimension", "scope_id", "occurred_at", "observed_at", "ingested_at", "valid_from", "valid_until", sequence=T.LongType(), rank=T.LongType())
#: A memory to be written: one row for each request.
MEMORY = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("about", _TEXT),
        T.StructField("dimensions", T.ArrayType(_struct("id", "kind", "title"))),
        T.StructField("entries", T.ArrayType(_struct("id", "kind", "text", coordinates=T.ArrayType(COORDINATE)))),
        T.StructField("relations", T.ArrayType(_struct("source", "target", "rel", "class", "why"))),
        T.StructField("evidence", T.ArrayType(_struct("id", "text", supports=T.ArrayType(_TEXT)))),
    ]
)


def faults(memories: DataFrame) -> DataFrame:
    """Memories with `errors`: what stands against writing each, in words; empty if nothing does."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    known = F.concat(F.transform("entries", lambda e: e["id"]), F.transform("evidence", lambda e: e["id"]))
    ids = F.transform("dimensions", lambda d: d["id"])
    coordinates = F.flatten(F.transform("entries", lambda e: F.coalesce(e["coordinates"], F.array())))
    checks = {
        "about is blank": blank(F.col("about")),
        "there is no dimension": F.coalesce(F.size("dimensions"), F.lit(0)) < 1,
        "there is no entry": F.coalesce(F.size("entries"), F.lit(0)) < 1,
        "an entry has no id": F.exists("entries", lambda e: blank(e["id"])),
        "an entry has no text": F.exists("entries", lambda e: blank(e["text"])),
        "an entry has no coordinate": F.exists("entries", lambda e: F.coalesce(F.size(e["coordinates"]), F.lit(0)) < 1),
        "ids repeat": F.size(F.array_distinct(known)) < F.size(known),
        "a coordinate names no dimension of the memory": F.exists(coordinates, lambda c: ~F.array_contains(ids, c["dimension"])),
        "a relation has no type": F.exists("relations", lambda r: blank(r["rel"])),
        "a relation is not structural and has no reason": F.exists("relations", lambda r: (r["class"] != "structural") & blank(r["why"])),
        "a relation has an unknown class": F.exists("relations", lambda r: ~r["class"].isin(*scalars.SALIENCE)),
    }
    return memories.withColumn("errors", F.filter(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())), lambda x: x.isNotNull()))


def mutations(memories: DataFrame) -> DataFrame:
    """The mutations of memories without faults, in the shape of projection.mutations.

    A memory makes its about's anchor, a node for each dimension, entry and evidence, details of the texts, and the
    edges has_dimension, records, contains_entry (one for each coordinate's scope), has_evidence, supports and its own.
    """
    m = memories
    scope = lambda d: scalars.dimension_identity(F.col("about"), d)

    def shaped(df: DataFrame, op: str, **have: Column) -> DataFrame:
        return df.select("seq", projection.mutation(op, **have).alias("m")).select("seq", "m.*")

    def nodes(df: DataFrame, key: Column, kind: Column, title: Column) -> DataFrame:
        have = {"node_kind": kind, "title": title, "status": F.lit("ACTIVE")}
        return shaped(df, "node", node_id=key, node=F.struct(*(have.get(n, F.lit(None)).alias(n) for n in projection.NODE_VALUES)))

    def edges(df: DataFrame, source: Column, target: Column, relation: Column, cls: Column) -> DataFrame:
        explanation = F.struct(*((cls if n == "semantic_class" else F.lit(None)).alias(n) for n in projection.EXPLANATION.names))
        return shaped(df, "edge", source=source, target=target, relation_type=relation, explanation=explanation)

    def details(df: DataFrame, key: Column, text: Column, revision: Column) -> DataFrame:
        return shaped(df, "detail", node_id=key, detail=F.struct(text.alias("detail"), F.lit(None).alias("content_hash"), revision.alias("revision")))

    d = m.select("seq", "about", F.explode("dimensions").alias("d"))
    e = m.select("seq", "about", F.explode("entries").alias("e"))
    c = e.select("seq", "about", "e", F.explode("e.coordinates").alias("c"))
    r = m.select("seq", "about", F.explode("relations").alias("r"))
    v = m.select("seq", "about", F.explode("evidence").alias("v"))
    s = v.select("seq", "about", "v", F.explode("v.supports").alias("s"))
    x, structural, evidential = F.col, F.lit("structural"), F.lit("evidential")
    parts = [
        nodes(m, x("about"), F.lit("memory_anchor"), x("about")),
        nodes(d, scope(x("d.id")), F.lit("memory_dimension"), F.coalesce("d.title", "d.id")),
        edges(d, x("about"), scope(x("d.id")), F.lit("has_dimension"), structural),
        nodes(e, x("e.id"), x("e.kind"), scalars.truncated(x("e.text"))),
        details(e, x("e.id"), x("e.text"), F.lit(1).cast("long")),
        edges(e, x("about"), x("e.id"), F.lit("records"), structural),
        edges(c, scope(x("c.dimension")), x("e.id"), F.lit("contains_entry"), structural),
        edges(r, x("r.source"), x("r.target"), scalars.relation_type(x("r.rel")), x("r.class")),
        nodes(v, x("v.id"), F.lit("evidence"), scalars.truncated(x("v.text"))),
        details(v, x("v.id"), x("v.text"), F.lit(1).cast("long")),
        edges(v, x("about"), x("v.id"), F.lit("has_evidence"), evidential),
        edges(s, x("v.id"), x("s"), F.lit("supports"), evidential),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_faults(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = graph.MOST_DEPTH) -> DataFrame:
    """Fault and key of a graph batch: repeated and blank nodes, edges to nothing or to themselves, nodes that the
    roots (request_id, root) do not reach. Edges are read several times (graph.written keeps them)."""
    many, links = nodes.count(), edges.count()
    ids = views.dealt(nodes.select("node_id"), "node_id", rows=many).groupBy("node_id").count()
    twice = ids.filter("count > 1").select(F.lit("duplicate node").alias("fault"), F.col("node_id").alias("key"))
    blank = nodes.filter(F.trim("title") == "").select(F.lit("blank title"), "node_id")
    own = edges.filter("source = target").select(F.lit("edge to itself"), "source")
    ends = views.dealt(edges.select(F.explode(F.array("source", "target")).alias("node_id")), "node_id", rows=2 * links).distinct()
    strange = ends.join(ids, "node_id", "left_anti").select(F.lit("unknown node"), "node_id")
    reached = graph.reach(edges, roots, depth).select(F.col("node").alias("node_id")).union(roots.select("root"))
    lost = ids.join(views.dealt(reached, "node_id", rows=many), "node_id", "left_anti").select(F.lit("not reached"), "node_id")
    return twice.union(blank).union(own).union(strange).union(lost)


def generated(spark: SparkSession, graphs: int, chain: int, branches: int, prefix: str = "g") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of so many graphs: a causal chain from a root, and at each step branches of noise."""
    g = spark.range(graphs).withColumn("root", F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")))
    step = g.select("root", F.explode(F.sequence(F.lit(1), F.lit(chain))).alias("k"))
    at = lambda k: F.when(k == 0, F.col("root")).otherwise(F.concat(F.col("root"), F.lit(":chain:"), k.cast("string")))
    noise = step.select("root", "k", F.explode(F.sequence(F.lit(1), F.lit(branches))).alias("b")) if branches else step.withColumn("b", F.lit(0)).limit(0)
    noisy = F.concat(F.col("root"), F.lit(":noise:"), F.col("k").cast("string"), F.lit(":"), F.col("b").cast("string"))
    nodes = g.select(F.col("root").alias("node_id"), F.lit("root").alias("node_kind")).union(step.select(at(F.col("k")), F.lit("step"))).union(noise.select(noisy, F.lit("noise")))
    links = step.select(at(F.col("k") - 1).alias("source"), at(F.col("k")).alias("target"), F.lit("leads_to").alias("relation_type"), F.lit("causal").alias("semantic_class"), F.col("k").cast("long").alias("sequence"))
    side = noise.select(at(F.col("k")), noisy, F.lit("related_to"), F.lit("structural"), F.lit(None).cast("long"))
    return nodes, links.union(side)
