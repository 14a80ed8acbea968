"""The memory verbs over a set of nodes, edges, details and entries, for batches of requests (V2 to V14), and what a consumer sees of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.functions import scalars
from mnemograph.operators import commands, evaluate, graph, render, temporal
from mnemograph.sources import logs

#: Rows that a wake and an answer show.
SPINE, STATE, EVIDENCE = 8, 5, 5


@dataclass
class Memory:
    """nodes: node_id, node_kind, title, summary, status; edges: source, target, relation_type, semantic_class,
    sequence; details: node_id, detail; entries: as temporal.positions reads them."""

    nodes: DataFrame
    edges: DataFrame
    details: DataFrame
    entries: DataFrame | None = None

    def _loaded(self, requests: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and details of each request's neighbourhood, roots included."""
        reached = graph.reach(self.edges, requests, depth)
        ids = reached.select("request_id", F.col("node").alias("node_id")).union(requests.select("request_id", F.col("root"))).distinct()
        nodes = ids.join(self.nodes, "node_id").select("request_id", *self.nodes.columns)
        return nodes, graph.induced(self.edges, reached, requests), ids.join(self.details, "node_id").select("request_id", *self.details.columns)

    def _moded(self, nodes: DataFrame, edges: DataFrame, requests: DataFrame, session: bool) -> DataFrame:
        """requests with focus, max_tier and mode, which is found out where they name none."""
        have = set(requests.columns)
        null = {"focus": "string", "mode": "string", "max_tier": "int", "budget": "long"}
        asked = requests.select("request_id", "root", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in null.items()))
        n = nodes.groupBy("request_id").agg(F.count("*").alias("n"))
        d = edges.groupBy("request_id").agg(F.avg(F.col("semantic_class").isin(*scalars.DENSITY_CLASSES).cast("int")).alias("d"))
        known = asked.join(n, "request_id", "left").join(d, "request_id", "left").fillna({"n": 0, "d": 0.0})
        return known.withColumn("mode", F.coalesce("mode", render.mode(F.col("budget"), F.col("n"), F.col("d"), F.col("focus").isNotNull(), F.lit(session)))).drop("n", "d")

    def _flat(self, nodes: DataFrame, edges: DataFrame, details: DataFrame, asked: DataFrame) -> DataFrame:
        """The root, its edges (those of the focus first, by salience), the other nodes and the details, with tiers and caps."""
        text = render.edge_text(F.col("source"), F.col("target"), F.col("relation_type"), F.col("semantic_class"), F.col("sequence"))
        roots = asked.select("request_id", F.col("root").alias("node_id"))
        node = render.node_text(F.col("title"), F.col("node_kind"), F.col("summary"))
        place = lambda phase, n, key: F.struct(F.lit(phase).alias("phase"), n.cast("long").alias("n"), key.alias("id")).alias("ord")
        none, explains = F.lit(0), F.col("semantic_class").isin(*scalars.TIER_CLASSES)
        first = nodes.join(roots, ["request_id", "node_id"], "left_semi").select("request_id", place(0, none, F.col("node_id")), F.lit(0).alias("tier"), node.alias("content"))
        middle = render.salient(edges, asked.filter("focus is not null")).select("request_id", place(1, F.col("place"), F.col("source")), F.when(explains, 1).otherwise(2).alias("tier"), text.alias("content"))
        others = nodes.join(roots, ["request_id", "node_id"], "left_anti").select("request_id", place(2, none, F.col("node_id")), F.lit(2).alias("tier"), node.alias("content"))
        last = details.join(asked.select("request_id", "focus"), "request_id").select("request_id", place(3, F.when(F.col("node_id").eqNullSafe(F.col("focus")), 0).otherwise(1), F.col("node_id")), F.lit(2).alias("tier"), F.concat(F.lit("Detail "), F.col("node_id"), F.lit(": "), F.col("detail")).alias("content"))
        sections = first.unionByName(middle).unionByName(others).unionByName(last).withColumn("tokens", render.tokens(F.col("content")))
        caps = F.array(*(c.cast("long") for c in render.budgets(F.col("budget"), F.col("mode") == "resume_focused"))).alias("caps")
        return sections.join(asked.select("request_id", "budget", caps), "request_id")

    def _rendered(self, loaded: tuple[DataFrame, DataFrame, DataFrame], requests: DataFrame, session: bool = False) -> DataFrame:
        nodes, edges, details = loaded
        asked = self._moded(nodes, edges, requests, session)
        sections = self._flat(nodes, edges, details, asked)
        kept = render.packed(sections)
        out = render.rendered(kept).join(asked.select("request_id", "mode"), "request_id")
        return out.join(render.truncation(sections, kept), "request_id", "left")

    def context(self, requests: DataFrame, budget: int | None = None, depth: int = 2) -> DataFrame:
        """The rendered context of each request with its mode and what its budget has cut.

        requests: request_id, root, and where they ask for them focus, mode and budget; a budget given here is that of all.
        """
        asked = requests if budget is None else requests.withColumn("budget", F.lit(budget).cast("long"))
        return self._rendered(self._loaded(requests, depth), asked)

    def tiers(self, requests: DataFrame, depth: int = 2) -> DataFrame:
        """request_id, tier, content, tokens of the tiers of each request, each within its own budget."""
        nodes, edges, details = self._loaded(requests, depth)
        asked = self._moded(nodes, edges, requests, False)
        caps = F.array(*render.budgets(F.coalesce("budget", F.lit(2**31 - 1)), F.col("mode") == "resume_focused"))
        sections = render.tier_sections(nodes, edges, details, asked).withColumn("tokens", render.tokens(F.col("content"))).join(asked.select("request_id", caps.alias("caps")), "request_id")
        fit = render.tiered(sections.withColumn("budget", F.get("caps", F.col("tier"))))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n\n")
        return fit.groupBy("request_id", "tier").agg(text.alias("content")).withColumn("tokens", render.tokens(F.col("content")))

    def context_path(self, requests: DataFrame, depth: int = 0) -> DataFrame:
        """As context, over each request's path from root to target and what lies within depth of the target.

        requests: request_id, root, target, and as for context; a request whose target is not reached gives no row. The
        target is the focus where none is named.
        """
        on = graph.context_paths(self.edges, requests, depth)
        reached = requests.join(on.select("request_id").distinct(), "request_id", "left_semi")
        nodes = on.select("request_id", F.col("node").alias("node_id")).distinct().join(self.nodes, "node_id").select("request_id", *self.nodes.columns)
        end = lambda c: on.select("request_id", F.col("node").alias(c)).distinct()
        edges = end("source").join(self.edges, "source").join(end("target"), ["request_id", "target"], "left_semi").select("request_id", *self.edges.columns)
        details = on.select("request_id", F.col("node").alias("node_id")).distinct().join(self.details, "node_id").select("request_id", *self.details.columns)
        focus = F.coalesce("focus", "target") if "focus" in requests.columns else F.col("target")
        return self._rendered((nodes, edges, details), reached.withColumn("focus", focus).drop("target"))

    def detail(self, requests: DataFrame) -> DataFrame:
        """request_id, fault, and the node with its detail, which may be null; requests: request_id, node_id.

        A blank node_id and one that is no node are faults.
        """
        asked = requests.select("request_id", F.nullif(F.trim("node_id"), F.lit("")).alias("node_id"))
        found = asked.join(self.nodes.withColumn("known", F.lit(True)), "node_id", "left").join(self.details, "node_id", "left")
        fault = F.when(F.col("node_id").isNull(), "node_id cannot be empty").when(F.col("known").isNull(), F.concat(F.lit("Node not found: "), F.col("node_id")))
        return found.select("request_id", "node_id", fault.alias("fault"), *(c for c in self.nodes.columns if c != "node_id"), *(c for c in self.details.columns if c != "node_id"))

    def wake(self, requests: DataFrame, depth: int = 2) -> DataFrame:
        """V2: the first edges of each request in edge order, with their place."""
        _, edges, _ = self._loaded(requests, depth)
        w = Window.partitionBy("request_id").orderBy(*render.edge_order())
        return edges.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= SPINE)

    def ask(self, requests: DataFrame, depth: int = 2) -> DataFrame:
        """V3: the distinct texts of a request's first evidence details, joined; UNKNOWN without any."""
        nodes, _, details = self._loaded(requests, depth)
        evidence = details.join(nodes.filter("node_kind = 'evidence'").select("request_id", "node_id"), ["request_id", "node_id"], "left_semi")
        w = Window.partitionBy("request_id").orderBy("node_id")
        first = evidence.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= EVIDENCE)
        texts = first.groupBy("request_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "detail"))), lambda x: x["detail"])), "\n").alias("answer"))
        return requests.select("request_id").join(texts, "request_id", "left").fillna({"answer": "UNKNOWN"})

    def temporal(self, direction: str, cursors: DataFrame, limit: int | None = None) -> DataFrame:
        """V4 to V7: goto, near, rewind or forward; the references of each request in order."""
        if self.entries is None:
            raise ValueError("this memory has no entries")
        found = temporal.positions(self.entries)
        return temporal.refs(temporal.near(found, cursors) if direction == "near" else temporal.move(found, cursors, direction, limit))

    def trace(self, requests: DataFrame, page: int = 64, offset: int = 0) -> DataFrame:
        """A page of the edges along each request's path, or of its target's neighbourhood without one."""
        nodes = graph.context_paths(self.edges, requests, 0)
        own = nodes.withColumnRenamed("node", "source").join(self.edges, "source").join(nodes.withColumnRenamed("node", "target"), ["request_id", "target"])
        w = Window.partitionBy("request_id").orderBy(*render.edge_order())
        return own.withColumn("place", F.row_number().over(w).cast("long")).filter((F.col("place") > offset) & (F.col("place") <= offset + min(page, 256)))

    def inspect(self, requests: DataFrame) -> DataFrame:
        """V9: each request's node with its detail and the numbers of its edges."""
        edges = graph.relationships(self.edges, requests).groupBy("request_id").agg(F.count_if(F.col("direction") == "incoming").alias("incoming"), F.count_if(F.col("direction") == "outgoing").alias("outgoing"))
        node = requests.join(self.nodes.withColumnRenamed("node_id", "root"), "root").join(self.details.withColumnRenamed("node_id", "root"), "root", "left")
        return node.join(edges, "request_id", "left").fillna({"incoming": 0, "outgoing": 0})

    def session(self, requests: DataFrame, roles: DataFrame, budget: int | None = None, depth: int = 2) -> DataFrame:
        """A rendered context for each role of each request, from one load of its neighbourhood.

        roles: request_id and role, and where a role has its own focus, mode or budget; without request_id every request
        has all of them. Each role is rendered under its own, with the session's measure of a generous budget.
        """
        if roles.isEmpty():
            raise ValueError("a session needs a role")
        own = requests.join(roles, "request_id") if "request_id" in roles.columns else requests.crossJoin(F.broadcast(roles))
        named = own.withColumns({"of": F.col("request_id"), "request_id": F.to_json(F.struct("request_id", "role"))})
        if budget is not None:
            named = named.withColumn("budget", F.coalesce("budget", F.lit(budget)).cast("long") if "budget" in named.columns else F.lit(budget).cast("long"))
        key = named.select("of", F.col("request_id").alias("each"))
        by_role = [part.withColumnRenamed("request_id", "of").join(key, "of").drop("of").withColumnRenamed("each", "request_id") for part in self._loaded(requests, depth)]
        out = self._rendered(tuple(by_role), named.drop("of", "role"), session=True)
        return out.join(named.select("request_id", "of", "role"), "request_id").drop("request_id").withColumnRenamed("of", "request_id")

    @staticmethod
    def validate_scope(asked: DataFrame, found: DataFrame) -> DataFrame:
        """V14."""
        return evaluate.scope_validation(asked, found)


#: The contract that a consumer may check before it starts.
CONTRACT_VERSION = 1


@dataclass
class Consumer:
    """A memory as a consumer sees it: it recalls, and records where there is a ledger. Requests are those of Memory;
    a request's root is what it asks about."""

    memory: Memory
    ledger: logs.Ledger | None = None

    def capabilities(self) -> dict[str, object]:
        """What this consumer can do, by name, and the version of the contract."""
        return {"contract_version": CONTRACT_VERSION, "capabilities": ["wake", "ask"] + (["record"] if self.ledger is not None else [])}

    def wake(self, requests: DataFrame, depth: int = 2) -> DataFrame:
        """request_id, about, content, mode, nodes, relationships, details, snapshot and revision of each request.

        snapshot is a hash of all rows that a recall was made of, in any order: recalls with the same one saw the same
        memory. revision is the last one that the ledger has for what is asked about, 0 without any.
        """
        loaded = self.memory._loaded(requests, depth)
        out = requests.select("request_id", F.col("root").alias("about"))
        for name, part in zip(("nodes", "relationships", "details"), loaded):
            own = [c for c in part.columns if c != "request_id"]
            seen = part.groupBy("request_id").agg(F.count("*").alias(name), F.bit_xor(F.xxhash64(F.lit(name), *own)).alias(f"{name}_hash"))
            out = out.join(seen, "request_id", "left").fillna(0, [name, f"{name}_hash"])
        snapshot = F.lower(F.hex(F.xxhash64("nodes", "nodes_hash", "relationships", "relationships_hash", "details", "details_hash")))
        text = self.memory._rendered(loaded, requests).select("request_id", "content", "mode")
        return out.withColumn("snapshot", snapshot).join(text, "request_id", "left").join(self._revisions(), "about", "left").fillna(0, ["revision"]).select("request_id", "about", "content", "mode", "nodes", "relationships", "details", "snapshot", "revision")

    def ask(self, requests: DataFrame, depth: int = 2) -> DataFrame:
        """wake's columns and the answer of each request, UNKNOWN where nothing is known."""
        return self.wake(requests, depth).join(self.memory.ask(requests, depth).select("request_id", "answer"), "request_id")

    def record(self, memories: DataFrame) -> DataFrame:
        """Outcomes of memories (commands.write) with what was accepted of each; ready tells whether it can be read now."""
        if self.ledger is None:
            raise ValueError("this consumer has no ledger to record in")
        found, _ = commands.write(self.ledger, memories)
        good = F.col("outcome").isin("accepted", "replayed")
        return found.select("seq", "about", "memory_id", "outcome", "revision", *(F.when(good, F.col(c)).otherwise(0).alias(c) for c in ("entries", "relations", "evidence")), good.alias("ready"), "warnings", "errors")

    def _revisions(self) -> DataFrame:
        if self.ledger is None:
            return self.memory.nodes.limit(0).select(F.lit("").alias("about"), F.lit(0).cast("long").alias("revision"))
        return self.ledger.read().filter("role = 'memory'").groupBy(F.col("root").alias("about")).agg(F.max("revision").alias("revision"))
