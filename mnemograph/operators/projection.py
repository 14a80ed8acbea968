"""Events folded to nodes, edges and details, and heads of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.operators.graph import _kept as kept

EXPLANATION = T.StructType([T.StructField(n, T.StringType()) for n in ("semantic_class", "rationale", "motivation", "method", "decision_id", "caused_by_node_id", "evidence", "confidence")] + [T.StructField("sequence", T.LongType())])
NODE_EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("node_id", "node_kind", "title", "summary", "status")]
    + [
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("related_nodes", T.ArrayType(T.StructType([T.StructField("node_id", T.StringType()), T.StructField("relation_type", T.StringType()), T.StructField("explanation", EXPLANATION)]))),
    ]
)
EDGE_EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("source_node_id", "target_node_id", "relation_type")] + [T.StructField("explanation", EXPLANATION)])
DETAIL_EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("node_id", "detail", "content_hash")] + [T.StructField("revision", T.LongType())])
#: The kinds of events by subject.
SUBJECTS = {"graph.node.materialized": "node", "graph.relation.materialized": "edge", "node.detail.materialized": "detail"}
#: Fixed value: the subject of the notice that a root's bundle has changed.
OUTBOUND = "context.bundle.generated"


def _read(events: DataFrame) -> DataFrame:
    """events with kind and with data parsed by its subject alone."""
    of = lambda name, schema: F.when(F.col("subject") == {v: k for k, v in SUBJECTS.items()}[name], F.from_json("data", schema)).alias(name)
    parsed = events.select("*", of("node", NODE_EVENT), of("edge", EDGE_EVENT), of("detail", DETAIL_EVENT))
    kind = F.when(F.col("node.node_id").isNotNull(), "node").when(F.col("edge.source_node_id").isNotNull(), "edge").when(F.col("detail.node_id").isNotNull(), "detail").otherwise("refused")
    return parsed.withColumn("kind", kind)


def routed(events: DataFrame) -> dict[str, DataFrame]:
    """IO12: events (subject, data, seq) by kind with data parsed; the rest, and data that cannot be parsed, in 'refused'."""
    named = _read(events)
    return {k: named.filter(F.col("kind") == k) for k in ("node", "edge", "detail", "refused")}


#: What a mutation sets, by kind, after its key.
NODE_VALUES = ("node_kind", "title", "summary", "status", "labels", "properties")
DETAIL_VALUES = ("detail", "content_hash", "revision")
_MUTATION = "struct<op:string,node_id:string,source:string,target:string,relation_type:string,node:struct<node_kind:string,title:string,summary:string,status:string,labels:array<string>,properties:map<string,string>>,explanation:" + EXPLANATION.simpleString() + ",detail:struct<detail:string,content_hash:string,revision:bigint>>"


def mutation(op: str, **values: Column) -> Column:
    """One mutation: op with its key (node_id, or source, target and relation_type) and a struct node, explanation or detail."""
    names = ("node_id", "source", "target", "relation_type", "node", "explanation", "detail")
    return F.struct(F.lit(op).alias("op"), *(values.get(n, F.lit(None)).alias(n) for n in names)).cast(_MUTATION)


#: A node that an edge names before it is materialised.
PLACEHOLDER = {
    "node_kind": "placeholder",
    "title": "[unmaterialized node]",
    "summary": "Referenced by relation before node materialization",
    "status": "UNMATERIALIZED",
    "labels": ["placeholder"],
    "properties": {"placeholder": "true", "placeholder_reason": "relation_materialized_before_node", "placeholder_created_by_subject": "graph.relation.materialized"},
}


def mutations(events: DataFrame) -> DataFrame:
    """Seq and the mutations that the events ask for: op, the key (node_id, or source, target and relation_type),
    and the values of a node, an explanation or a detail. Each event is parsed once."""
    part = lambda name, fields: F.struct(*(F.col(f"{name}.{f}") for f in fields))
    related = F.transform(F.coalesce("node.related_nodes", F.array()), lambda r: mutation("edge", source=F.col("node.node_id"), target=r["node_id"], relation_type=r["relation_type"], explanation=r["explanation"]))
    node = F.concat(F.array(mutation("node", node_id=F.col("node.node_id"), node=part("node", NODE_VALUES))), related)
    edge = F.array(mutation("edge", source=F.col("edge.source_node_id"), target=F.col("edge.target_node_id"), relation_type=F.col("edge.relation_type"), explanation=F.col("edge.explanation")))
    detail = F.array(mutation("detail", node_id=F.col("detail.node_id"), detail=part("detail", DETAIL_VALUES)))
    asked = F.when(F.col("kind") == "node", node).when(F.col("kind") == "edge", edge).when(F.col("kind") == "detail", detail)
    return _read(events).select("seq", F.explode(asked).alias("m")).select("seq", "m.*")


_KEY = ["op", "node_id", "source", "target", "relation_type"]


def latest(changes: DataFrame) -> DataFrame:
    """The last mutation of each key, by seq, in the shape of mutations: folds of parts can be put together and folded on."""
    last = changes.groupBy(*_KEY).agg(F.max("seq").alias("seq"), F.max_by(F.struct("node", "explanation", "detail"), "seq").alias("x"))
    return last.select("seq", *_KEY, "x.*")


def outbound(model: DataFrame, changes: DataFrame, roles: tuple[str, ...] = ("agent",)) -> DataFrame:
    """IO13: an envelope for each root that changes touch: its state after them in model, both in the shape of mutations.

    A root is a node with its detail and the edges that leave it. The revision is the seq of its last change, the watermark
    that of all changes. The content hash is of the number of a root's rows and the sums of two hashes of each, which do
    not depend on their order and are added up before the shuffle, however many edges a root has.
    """
    root = F.coalesce("node_id", "source").alias("root")
    touched = changes.select(root).distinct()
    row = F.to_json(F.struct("op", "target", "relation_type", "node", "explanation", "detail"))
    big = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(20,0)")).cast("string")
    state = model.withColumn("root", root).join(touched, "root", "left_semi").groupBy("root").agg(F.max("seq").alias("revision"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), big(1), big(2)), 256).alias("content_hash"))
    mark = changes.agg(F.max("seq").cast("string").alias("mark"))
    data = F.struct(F.col("root").alias("root_node_id"), F.array(*map(F.lit, roles)).alias("roles"), "revision", "content_hash", F.col("mark").alias("projection_watermark"))
    event = F.concat_ws(":", F.lit(OUTBOUND), "root", F.col("revision").cast("string"))
    return state.crossJoin(F.broadcast(mark)).select(event.alias("event_id"), F.col("root").alias("aggregate_id"), F.lit("node").alias("aggregate_type"), F.lit(OUTBOUND).alias("subject"), F.to_json(data).alias("data"))


def fold(changes: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges and details after all mutations; the last of a key wins, by seq.

    One aggregate with a partial step folds all three, and is written to the checkpoint folder. An edge whose end has no
    node makes a placeholder there.
    """
    folded = kept(changes.groupBy(*_KEY).agg(F.max_by(F.struct("node", "explanation", "detail"), "seq").alias("x")))
    known = folded.filter("op = 'node'").select("node_id", "x.node.*")
    edges = folded.filter("op = 'edge'").select("source", "target", "relation_type", "x.explanation.*")
    details = folded.filter("op = 'detail'").select("node_id", "x.detail.*")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().join(known, "node_id", "left_anti")
    texts = {k: F.lit(v) for k, v in PLACEHOLDER.items() if isinstance(v, str)}
    labels = F.array(*map(F.lit, PLACEHOLDER["labels"]))
    properties = F.create_map(*(F.lit(x) for pair in PLACEHOLDER["properties"].items() for x in pair))
    holes = ends.select("node_id", *(v.alias(k) for k, v in texts.items()), labels.alias("labels"), properties.alias("properties"))
    return {"nodes": known.unionByName(holes), "edges": edges, "details": details}


def once(events: DataFrame) -> DataFrame:
    """Each (consumer, event_id) at its first arrival (seq)."""
    rest = [c for c in events.columns if c not in ("consumer", "event_id", "seq")]
    first = events.groupBy("consumer", "event_id").agg(F.min_by(F.struct("seq", *rest), "seq").alias("x"))
    return first.select("consumer", "event_id", "x.*")


def checkpoints(events: DataFrame) -> DataFrame:
    """Consumer, stream, last_event, last_at and events of each consumer's stream."""
    return events.groupBy("consumer", "stream").agg(F.max_by("event_id", "seq").alias("last_event"), F.max_by("occurred_at", "seq").alias("last_at"), F.count("*").alias("events"))


def heads(log: DataFrame) -> DataFrame:
    """Aggregate heads: root, role and the content hash of the latest revision."""
    return log.groupBy("root", "role").agg(F.max("revision").alias("revision"), F.max_by("content_hash", "revision").alias("content_hash"))
