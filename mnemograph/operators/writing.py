"""Writers' requests compiled to memories, with the quality of their relations, and the candidates that writers may link to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from mnemograph.functions import scalars
from mnemograph.operators import commands, ingest
from mnemograph.operators.graph import _kept as kept
from mnemograph.operators.ingest import _struct
from mnemograph.sources import logs

_TEXTS = T.ArrayType(T.StringType())
_READ = {"inspected_refs": "kernel_inspect", "temporal_refs": "kernel_temporal", "wake_refs": "kernel_wake", "ask_refs": "kernel_ask"}
#: A writer's request: one row for each call.
REQUEST = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("about", "intent", "actor", "observed_at", "idempotency_key", "source_kind")]
    + [
        T.StructField("scope", _struct("process", "task", "episode")),
        T.StructField("options", _struct(dry_run=T.BooleanType(), strict=T.BooleanType(), sequence=T.LongType())),
        T.StructField("current", _struct("ref", "kind", "summary", "evidence")),
        T.StructField("read_context", _struct(**{n: _TEXTS for n in _READ}, trace_paths=T.ArrayType(_struct("from", "to", refs=_TEXTS)))),
        T.StructField("connect_to", T.ArrayType(_struct("ref", "rel", "class", "why", "evidence", "confidence"))),
        T.StructField("semantic_delta", _struct("ref", "from", "to", "why", "evidence")),
    ]
)
#: Intents, kinds of entries and confidences that a request may have.
INTENTS = ("record_turn", "record_observation", "record_decision", "record_feedback", "record_delta")
KINDS = ("turn", "observation", "decision", "feedback", "semantic_delta", "constraint", "preference", "derived_value", "error_path", "success_path")
CONFIDENCES = ("high", "medium", "low", "unknown")
#: Classes that each relation type of a writer may have; all are rich but those named below.
CLASSES = {
    "follows": ("procedural",), "answers": ("evidential",), "uses_background": ("evidential",), "depends_on": ("causal",), "chosen_because": ("causal", "motivational"), "triggers": ("causal",), "authorizes": ("causal", "motivational"),
    "verified_by": ("evidential",), "semantic_delta_from": ("causal",), "updates_state": ("causal",), "supersedes": ("evidential",), "contradicts": ("evidential",), "satisfies_constraint": ("constraint",), "violates_constraint": ("constraint",),
    "contributes_to": ("evidential",), "excluded_from": ("constraint",), "checked_against": ("constraint",), "derived_from": ("evidential",), "supports": ("evidential",), "confirms_selection": ("evidential", "motivational"), "restates": ("evidential",),
    "corrects": ("evidential",), "component_of": ("evidential",), "total_of": ("evidential",), "same_event_as": ("evidential",), "same_entity_as": ("evidential",), "qualifies_as": ("evidential",), "matches_requirement": ("constraint",),
    "contains": ("structural",), "member_of": ("structural",), "scoped_to": ("structural",),
}
ANEMIC = ("follows", "answers", "uses_background")
STRUCTURAL = ("contains", "member_of", "scoped_to")
EXPLANATORY = ("causal", "motivational", "evidential", "constraint")


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x) == "", F.lit(True))


def _empty(x: Column, kind: T.DataType) -> Column:
    return F.coalesce(x, F.array().cast(kind))


def _reads(context: Column) -> Column:
    """Pairs of a reference and the tool that has shown it, blank references left out."""
    pair = lambda tool: lambda r: F.struct(r.alias("ref_id"), F.lit(tool).alias("tool"))
    traced = F.flatten(F.transform(_empty(context["trace_paths"], REQUEST["read_context"].dataType["trace_paths"].dataType), lambda t: F.concat(F.array(t["from"], t["to"]), _empty(t["refs"], _TEXTS))))
    lists = [F.transform(_empty(context[n], _TEXTS), pair(tool)) for n, tool in _READ.items()] + [F.transform(_empty(traced, _TEXTS), pair("kernel_trace"))]
    return F.filter(F.concat(*lists), lambda p: ~_blank(p["ref_id"]))


def read_index(requests: DataFrame) -> DataFrame:
    """Seq, ref_id and tools (sorted) of every reference that a request (REQUEST) says it has read."""
    pairs = requests.select("seq", F.explode(_reads(F.col("read_context"))).alias("p"))
    return pairs.groupBy("seq", F.col("p.ref_id").alias("ref_id")).agg(F.array_sort(F.collect_set("p.tool")).alias("tools"))


def _diagnosed(links: Column, source: Column, strict: Column, reads: Column, local: Column) -> Column:
    """Relations with their quality and their first fault, if they have one. local: references that the request itself makes.

    What a rule asks for more than once is worked out by a step of its own, since the functions that go over arrays
    evaluate each expression wherever it stands.
    """
    classes = F.create_map(*(x for name, some in CLASSES.items() for x in (F.lit(name), F.array(*(F.lit(c) for c in some)))))

    def named(x: Column) -> Column:
        return F.struct(x.alias("link"), scalars.relation_type(x["rel"]).alias("rel"), F.coalesce(x["confidence"], F.lit("high")).alias("confidence"), F.coalesce(x["class"] == "structural", F.lit(False)).alias("structural"), F.array_contains(local, x["ref"]).alias("here"))

    def met(x: Column) -> Column:
        rel, link = x["rel"], x["link"]
        known = rel.isin(*CLASSES)
        base = F.when(~known, "suspect").when(rel.isin(*ANEMIC), "anemic").when(rel.isin(*STRUCTURAL), "structural").otherwise("rich")
        seen = F.when(x["here"], F.array(F.lit("current_request"))).otherwise(F.array_sort(F.array_distinct(F.transform(F.filter(reads, lambda p: p["ref_id"] == link["ref"]), lambda p: p["tool"]))))
        proven = x["structural"] | (~_blank(link["why"]) & ~_blank(link["evidence"]))
        return F.struct(x.alias("x"), known.alias("known"), base.alias("base"), seen.alias("seen"), proven.alias("proven"))

    def judged(m: Column) -> Column:
        x, known, base, seen, proven = (m[n] for n in ("x", "known", "base", "seen", "proven"))
        link, rel, confidence = x["link"], x["rel"], x["confidence"]
        cls = link["class"]
        fits = F.when(known, F.array_contains(F.try_element_at(classes, rel), cls)).otherwise(~x["structural"])
        observed = F.size(seen) > 0
        error = (
            F.when(_blank(link["ref"]), "a relation has no target")
            .when(_blank(link["rel"]), "a relation has no type")
            .when(~F.coalesce(cls.isin(*scalars.SALIENCE), F.lit(False)), "a relation has an unknown class")
            .when(~proven, "a relation is not structural and has no reason or evidence")
            .when(~confidence.isin(*CONFIDENCES), "a relation has an unknown confidence")
            .when(strict & ~known, "a relation's type is not a writer's")
            .when(~fits, "a relation's type can not have its class")
            .when(source == link["ref"], "a relation points to where it comes from")
            .when(strict & (base == "rich") & ~observed, "a rich relation's target has not been read")
        )
        doubted = ~strict & (base == "rich") & (~observed | confidence.isin("low", "unknown"))
        quality = F.when(doubted, "suspect").otherwise(base)
        return F.struct(
            source.alias("source"), link["ref"].alias("target"), rel.alias("rel"), cls.alias("class"), confidence.alias("confidence"), link["why"].alias("why"), link["evidence"].alias("evidence"), quality.alias("quality"),
            (quality == "anemic").alias("fallback"), ((base == "rich") & ~x["here"]).alias("needs_reading"), observed.alias("read"), seen.alias("read_by"), proven.alias("proven"), error.alias("error"),
        )

    return F.transform(F.transform(F.transform(links, named), met), judged)


def _is(name: str) -> Callable[[Column], Column]:
    return lambda x: x == name


def metrics(relations: Column) -> Column:
    """P10: counts and shares of diagnosed relations; a share of nothing is 0."""
    count = lambda rule: F.size(F.filter(relations, rule))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total = F.size(relations)
    of = {q: F.size(F.filter(F.transform(relations, lambda r: r["quality"]), _is(q))) for q in ("rich", "anemic", "structural", "suspect")}
    needed = count(lambda r: r["needs_reading"])
    met = count(lambda r: r["needs_reading"] & r["read"])
    semantic = of["rich"] + of["anemic"] + of["suspect"]
    shares = {"rich_share": share(of["rich"], semantic), "anemic_share": share(of["anemic"], semantic), "explanatory_share": share(count(lambda r: r["class"].isin(*EXPLANATORY)), total - of["structural"]), "proven_share": share(count(lambda r: r["proven"]), total), "read_share": share(met, needed)}
    return F.struct(total.alias("total"), *(x.alias(q) for q, x in of.items()), needed.alias("needed"), met.alias("read"), *(x.alias(n) for n, x in shares.items()))


def plans(requests: DataFrame) -> DataFrame:
    """P10: seq, about, dry_run, idempotency_key, errors, memory, generated_refs, relations, metrics and suggested_reads of
    writers' requests (REQUEST).

    memory has the columns of ingest.MEMORY: a dimension for each scope (its id is the scope, which coordinates name), the
    entry, its relations, evidence of it and of each relation; with a semantic delta also that, one step later, reached by
    updates_state and tied to the first target by semantic_delta_from. Without options a request is strict and a dry run.
    A strict request needs evidence, a relation, writers' relation types, and rich relations only to what it has read or
    makes itself; in others such relations are suspect. errors is empty if there is a memory to write; else memory is null.
    """
    o = lambda name, default: F.coalesce(F.col(f"options.{name}"), F.lit(default))
    about, scope, current, delta = F.col("about"), F.col("scope"), F.col("current"), F.col("semantic_delta")
    given = F.nullif(F.trim(current["ref"]), F.lit(""))
    own = F.nullif(F.trim(delta["ref"]), F.lit(""))
    links_type = REQUEST["connect_to"].dataType
    said = F.to_json(F.struct(*(n for n in REQUEST.names if n not in ("seq", "idempotency_key"))))
    rows = requests.select(
        *REQUEST.names,
        o("dry_run", True).alias("dry_run"),
        o("strict", True).alias("strict"),
        F.when(F.col("options.sequence") > 0, F.col("options.sequence")).otherwise(1).cast("long").alias("step"),
        F.coalesce(given, scalars.entry_ref(about, current["kind"], current["summary"])).alias("ref"),
        F.when(delta.isNotNull(), F.coalesce(own, scalars.entry_ref(about, F.lit("semantic_delta"), delta["to"]))).alias("delta_ref"),
        _reads(F.col("read_context")).alias("reads"),
        _empty(F.col("connect_to"), links_type).alias("links"),
        F.coalesce(F.nullif(F.trim("idempotency_key"), F.lit("")), scalars.idempotency_key(said)).alias("key"),
    )
    ref, delta_ref, strict = F.col("ref"), F.col("delta_ref"), F.col("strict")
    local = F.array_compact(F.array(ref, delta_ref))
    link = lambda target, rel: F.struct(target.alias("ref"), F.lit(rel).alias("rel"), F.lit("causal").alias("class"), delta["why"].alias("why"), delta["evidence"].alias("evidence"), F.lit("high").alias("confidence"))
    direct = _diagnosed(F.col("links"), ref, strict, F.col("reads"), F.array(ref))
    onward = _diagnosed(F.array(link(delta_ref, "updates_state")), ref, strict, F.col("reads"), local)
    first = F.get("links", F.lit(0))["ref"]
    back = F.when(F.size("links") > 0, _diagnosed(F.array(link(first, "semantic_delta_from")), delta_ref, strict, F.col("reads"), local))
    of_delta = F.when(F.size("links") > 0, F.concat(onward, back)).otherwise(onward)
    tied = F.when(delta.isNull(), direct).otherwise(F.concat(direct, of_delta))
    rows = rows.withColumn("relations", tied)
    read = F.col("read_context")
    named = F.concat(*(_empty(read[n], _TEXTS) for n in _READ), F.flatten(F.transform(_empty(read["trace_paths"], REQUEST["read_context"].dataType["trace_paths"].dataType), lambda t: F.concat(F.array(t["from"], t["to"]), _empty(t["refs"], _TEXTS)))))
    checks = {
        "about is blank": _blank(about),
        "the intent is unknown": ~F.coalesce(F.col("intent").isin(*INTENTS), F.lit(False)),
        "the actor is blank": _blank(F.col("actor")),
        "observed_at is blank": _blank(F.col("observed_at")),
        "a reference that was read is blank": F.exists(named, _blank),
        "the process is blank": _blank(scope["process"]),
        "the kind is unknown": ~F.coalesce(current["kind"].isin(*KINDS), F.lit(False)),
        "the summary is blank": _blank(current["summary"]),
        "a strict request has no evidence": strict & _blank(current["evidence"]),
        "a strict request has no relation": strict & (F.size("links") == 0),
        "the semantic delta is incomplete": delta.isNotNull() & (_blank(delta["from"]) | _blank(delta["to"]) | _blank(delta["why"]) | _blank(delta["evidence"])),
        "a generated reference repeats": delta.isNotNull() & (ref == delta_ref),
    }
    errors = F.array_distinct(F.array_compact(F.concat(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in checks.items())), F.transform("relations", lambda r: r["error"]))))
    scopes = {"task": ("task", "Kernel write task"), "process": ("agentic_process", "Kernel write process"), "episode": ("agentic_episode", "Kernel write episode")}
    memory = {f.name: f.dataType for f in ingest.MEMORY}
    dimensions = F.array_compact(F.array(*(F.when(~_blank(scope[n]), F.struct(scope[n].alias("id"), F.lit(kind).alias("kind"), F.lit(title).alias("title"))) for n, (kind, title) in scopes.items())))
    parts = lambda d, step: {"dimension": d["id"], "scope_id": d["id"], "observed_at": F.col("observed_at"), "sequence": step}
    coordinate = lambda step: lambda d: F.struct(*(parts(d, step).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ingest.COORDINATE))
    entry = lambda key, kind, text, step: F.struct(key.alias("id"), kind.alias("kind"), text.alias("text"), F.transform(dimensions, coordinate(step)).alias("coordinates"))
    change = F.concat(F.lit("From: "), delta["from"], F.lit("\nTo: "), delta["to"], F.lit("\nWhy: "), delta["why"])
    entries = F.array_compact(F.array(entry(ref, current["kind"], current["summary"], F.col("step")), F.when(delta.isNotNull(), entry(delta_ref, F.lit("semantic_delta"), change, F.col("step") + 1))))
    proof = lambda key, text, *to: F.struct(key.alias("id"), text.alias("text"), F.array(*to).alias("supports"))
    of_links = F.transform("links", lambda x, i: proof(F.concat(F.lit("evidence:"), ref, F.lit(":relation:"), (i + 1).cast("string")), F.coalesce(x["evidence"], F.lit("")), ref, x["ref"]))
    own_proof = F.array_compact(F.array(F.when(~_blank(current["evidence"]), proof(F.concat(F.lit("evidence:"), ref, F.lit(":current")), current["evidence"], ref))))
    delta_proof = F.array_compact(F.array(F.when(delta.isNotNull(), proof(F.concat(F.lit("evidence:"), delta_ref, F.lit(":semantic_delta")), delta["evidence"], delta_ref, ref))))
    relations = F.transform("relations", lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["rel"].alias("rel"), r["class"].alias("class"), r["why"].alias("why")))
    columns = {"dimensions": dimensions, "entries": entries, "relations": relations, "evidence": F.concat(own_proof, of_links, delta_proof)}
    whole = F.struct(*(x.cast(memory[n]).alias(n) for n, x in columns.items()))
    trace = F.when(F.size("links") > 0, F.struct(F.lit("kernel_trace").alias("tool"), ref.alias("from"), first.alias("to")))
    judged = rows.withColumn("errors", errors)
    good = F.size("errors") == 0
    return judged.select("seq", "about", "dry_run", F.col("key").alias("idempotency_key"), "errors", F.when(good, whole).alias("memory"), local.alias("generated_refs"), "relations", metrics(F.col("relations")).alias("metrics"), F.array_compact(F.array(trace)).alias("suggested_reads"))


def write_memory(ledger: logs.Ledger, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of writers' requests and the mutations of the accepted ones.

    Outcomes: seq, about, outcome, memory_id, revision, errors, generated_refs and metrics. A request with faults is
    'invalid', a dry run 'dry run'; the others are written (commands.write), by their sequence.
    """
    planned = kept(plans(requests))
    live = planned.filter("size(errors) = 0 and not dry_run").select("seq", "about", "memory.*", "idempotency_key")
    written, made = commands.write(ledger, live)
    found = written.select("seq", F.col("outcome").alias("found"), "memory_id", "revision", F.col("errors").alias("late"))
    outcome = F.when(F.size("errors") > 0, "invalid").when(F.col("dry_run"), "dry run").otherwise(F.col("found"))
    out = planned.join(found, "seq", "left").withColumn("outcome", outcome)
    return out.select("seq", "about", "outcome", "memory_id", "revision", F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.coalesce("late", "errors")).alias("errors"), "generated_refs", "metrics"), made


#: What a candidate's role makes of it for an entry of a kind; kinds without a row of their own follow.
_QUESTION, _ANSWER = "subtask_question", "subtask_answer_feedback"
PRIORITIES = {
    (_ANSWER, "same_subtask_question"): 10, (_ANSWER, "previous_subtask_answer"): 30, (_ANSWER, "previous_subtask_question"): 40,
    (_QUESTION, "previous_subtask_answer"): 10, (_QUESTION, "previous_subtask_question"): 30, (_QUESTION, "older_subtask_answer"): 50,
    (None, "same_subtask_question"): 30, (None, "previous_subtask_answer"): 40, (None, "dimension_scope"): 90,
}
HINTS = {
    (_ANSWER, "same_subtask_question"): "answer_addresses_question", (_ANSWER, "previous_subtask_answer"): "answer_uses_prior_answer", (_ANSWER, "previous_subtask_question"): "answer_uses_prior_question",
    (_QUESTION, "previous_subtask_answer"): "question_follows_previous_answer", (_QUESTION, "previous_subtask_question"): "question_refines_previous_question", (_QUESTION, "older_subtask_answer"): "question_uses_older_answer",
    (None, "dimension_scope"): "scope_anchor",
}


def turn(ref: Column) -> Column:
    """K9: struct of subtask and kind of a turn's reference, `...:subtask:<number>:question` or `answer`; null for others."""
    tail = F.when(F.contains(ref, F.lit(":subtask:")), F.substring_index(ref, ":subtask:", -1))
    shape = r"(?s)^([+-]?[0-9]+):(question|answer)(?::.*)?$"
    number = F.regexp_extract(tail, shape, 1).try_cast("long")
    return F.when(number.isNotNull(), F.struct(number.alias("subtask"), F.regexp_extract(tail, shape, 2).alias("kind")))


def candidate_refs(requests: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """K9: seq, entry_ref and ref of what a request's entry could be linked to: references inspected or met in time, the
    targets it names, and those of its calls (seq, arguments: JSON with ref, from, to or around.ref); never the entry itself."""
    entry = F.coalesce(F.nullif(F.trim("current.ref"), F.lit("")), scalars.entry_ref(F.col("about"), F.col("current.kind"), F.col("current.summary"))).alias("entry_ref")
    linked = F.transform(_empty(F.col("connect_to"), REQUEST["connect_to"].dataType), lambda x: x["ref"])
    own = requests.select("seq", entry, F.explode(F.concat(_empty(F.col("read_context.inspected_refs"), _TEXTS), _empty(F.col("read_context.temporal_refs"), _TEXTS), linked)).alias("ref"))
    if calls is not None:
        named = F.array(*(F.get_json_object("arguments", f"$.{p}") for p in ("ref", "from", "to", "around.ref")))
        own = own.unionByName(calls.select("seq", F.explode(named).alias("ref")).join(requests.select("seq", entry), "seq"))
    return own.filter("ref is not null and ref <> entry_ref").distinct()


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """K9: candidates (seq, entry_ref, entry_kind, ref) once each, with role, turn_kind, relative_position,
    temporal_distance, priority, relation_hint and place (by priority, then reference)."""
    own, other = turn(F.col("entry_ref")), turn(F.col("ref"))
    distance = own["subtask"] - other["subtask"]
    position = F.when(distance == 0, "same_subtask").when(distance == 1, "previous_subtask").when(distance > 1, "older_subtask").when(distance < 0, "future_subtask").otherwise("unknown")
    role = F.when(F.contains("ref", F.lit(":dimension:")), "dimension_scope").when(own.isNotNull() & other.isNotNull(), F.concat_ws("_", position, other["kind"])).otherwise("unknown")

    def looked_up(table: dict, default: object) -> Column:
        out = F.lit(default)
        for own_kind in (None, _QUESTION, _ANSWER):
            for (kind, name), value in table.items():
                if kind == own_kind:
                    out = F.when((F.col("role") == name) & (F.lit(True) if kind is None else F.coalesce(F.col("entry_kind") == kind, F.lit(False))), value).otherwise(out)
        return out

    once = candidates.select("seq", "entry_ref", "entry_kind", "ref").dropDuplicates(["seq", "ref"])
    found = once.withColumns({"role": role, "turn_kind": F.coalesce(other["kind"], F.lit("unknown")), "relative_position": position, "temporal_distance": distance})
    found = found.withColumns({"priority": looked_up(PRIORITIES, 80), "relation_hint": looked_up(HINTS, "context_candidate")})
    return found.withColumn("place", F.row_number().over(Window.partitionBy("seq").orderBy("priority", "ref")).cast("long"))
