"""Scorecards and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema

from mnemograph.functions import nearest, scalars


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Rate, low and high of a share's 95 % interval; zeros without trials."""
    p = hits / n
    base = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    some = n > 0
    return F.when(some, p).otherwise(0.0), F.when(some, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


def task_scores(runs: DataFrame, final_types: tuple[str, ...] = ()) -> DataFrame:
    """Task, subtasks, progress and success; runs: task, task_type, step, success.

    A task succeeds if all its subtasks do, or for the types named if its last does.
    """
    got = runs.groupBy("task", "task_type").agg(F.count("*").alias("subtasks"), F.avg(F.col("success").cast("int")).alias("progress"), F.bool_and("success").alias("every"), F.max_by("success", "step").alias("last"))
    return got.select("task", "task_type", "subtasks", "progress", F.when(F.col("task_type").isin(*final_types), F.col("last")).otherwise(F.col("every")).alias("success"))


def at_depth(runs: DataFrame) -> DataFrame:
    """A10: step, runs and success rate."""
    return runs.groupBy("step").agg(F.count("*").alias("runs"), F.avg(F.col("success").cast("int")).alias("rate"))


def failure_class(known: Column, observed: Column, answered: Column, correct: Column) -> Column:
    """The first fault of a run."""
    return F.when(~known, "temporal_leak").when(~observed, "evidence_not_observed").when(~answered, "no_answer").when(~correct, "wrong_answer").otherwise("success")


def candidates(vectors: DataFrame, queries: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """Query, place, ref and score of the k candidates of highest cosine in each query's own group.

    vectors: ref, grp, v; queries: query, grp, v. A query meets its group only, as in the per-item search. All pairs of a
    group are looked at, so the work grows with its square; it is dealt to blocks of about `most` queries and vectors of
    a group, however large that is, and each block gives a query's k best (functions/nearest.py).
    """
    sizes = vectors.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).join(queries.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias("sides")), "grp")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = vectors.join(sizes, "grp").withColumn("part", own("ref", "parts")).withColumn("side", every("sides")).select("grp", "part", "side", "ref", "v")
    asked = queries.join(sizes, "grp").withColumn("side", own("query", "sides")).withColumn("part", every("parts")).select(F.col("grp").alias("of"), F.col("part").alias("at"), F.col("side").alias("by"), "query", F.col("v").alias("qv"))
    schema = asked.select("query").schema.add(dealt.schema["ref"]).add("score", "double")
    block = nearest.block(k, to_arrow_schema(schema))
    some = asked.groupBy("of", "at", "by").cogroup(dealt.groupBy("grp", "part", "side")).applyInArrow(lambda mine, theirs: block(mine, theirs), schema)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ref")).cast("long")
    return some.withColumn("place", best).filter(F.col("place") <= k).select("query", "place", "ref", "score")


def recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Query, gold, hits and outcome (full, partial, missing)."""
    g = gold.groupBy("query").agg(F.count_distinct("ref").alias("gold"))
    h = found.join(gold.distinct(), ["query", "ref"], "left_semi").groupBy("query").agg(F.count_distinct("ref").alias("hits"))
    out = g.join(h, "query", "left").fillna({"hits": 0})
    return out.withColumn("outcome", F.when(F.col("hits") == F.col("gold"), "full").when(F.col("hits") > 0, "partial").otherwise("missing"))


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows with one content hash, the first in order."""
    hashed = rows.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", *keys), 256))
    w = Window.partitionBy("content_hash").orderBy(*order)
    return hashed.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("nth")


def overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of test whose content is in train."""
    key = F.sha2(F.concat_ws("\x1f", *keys), 256)
    return test.withColumn("h", key).join(train.select(key.alias("h")).distinct(), "h", "left_semi").drop("h")


def policy_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """step_id and verdict between two runs (step_id, correct)."""
    both = before.select("step_id", F.col("correct").alias("b")).join(after.select("step_id", F.col("correct").alias("a")), "step_id", "full_outer")
    verdict = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.col("a") & ~F.col("b"), "fixed").when(~F.col("a") & F.col("b"), "regressed").otherwise("same")
    return both.select("step_id", verdict.alias("verdict"))


def scope_validation(asked: DataFrame, found: DataFrame) -> DataFrame:
    """request_id, allowed, missing and extra of two sets of scopes (request_id, scope)."""
    trim = lambda df: df.select("request_id", F.trim("scope").alias("scope")).filter("scope <> ''").distinct()
    both = trim(asked).withColumn("a", F.lit(1)).join(trim(found).withColumn("f", F.lit(1)), ["request_id", "scope"], "full_outer")
    listed = lambda where: F.array_join(F.array_sort(F.collect_list(F.when(where, F.col("scope")))), ",")
    missing, extra = F.col("f").isNull(), F.col("a").isNull()
    return both.groupBy("request_id").agg((F.count_if(missing | extra) == 0).alias("allowed"), listed(missing).alias("missing"), listed(extra).alias("extra"))


def latency(actions: DataFrame) -> DataFrame:
    """K1: action, calls, mean and most milliseconds."""
    return actions.groupBy("action").agg(F.count("*").alias("calls"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("most_ms"))


def growth(probes: DataFrame) -> DataFrame:
    """Step, tool, fewest and most refs, whole mean milliseconds and probes."""
    return probes.groupBy("step", "tool").agg(F.min("refs").alias("least"), F.max("refs").alias("most"), F.floor(F.sum("ms") / F.count("*")).cast("long").alias("mean_ms"), F.count("*").alias("probes"))


def variance(runs: DataFrame) -> DataFrame:
    """Condition, mean and population variance of the rates of its seeds."""
    rates = runs.groupBy("condition", "seed").agg(F.avg(F.col("success").cast("int")).alias("rate"))
    return rates.groupBy("condition").agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("variance"), F.count("*").alias("seeds"))


def verdict(rate_a: Column, rate_b: Column, margin: float = 0.05) -> Column:
    """Whether a's rate supports a hypothesis over b's."""
    d = rate_a - rate_b
    return F.when(d > margin, "SUPPORTED").when(F.abs(d) <= margin, "MIXED").otherwise("NOT SUPPORTED")


def forbidden(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """ref_id and pattern of texts that a forbidden pattern matches."""
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(p)) for p in patterns)), lambda x: x.isNotNull())
    return texts.select("ref_id", F.explode(hits).alias("pattern"))


def argmax(scores: DataFrame) -> DataFrame:
    """request_id and the index of the highest score, the lowest of equal ones."""
    return scores.groupBy("request_id").agg(F.max_by("idx", F.struct("score", -F.col("idx"))).alias("idx"))


def evidence_hits(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Question and hit: full, partial, missing, or not applicable without expected references or with abstention.

    expected: question, abstention, ref_id (null: none); observed: question, ref_id.
    """
    both = expected.join(observed.distinct().withColumn("seen", F.lit(1)), ["question", "ref_id"], "left")
    judged = both.groupBy("question").agg(F.max("abstention").alias("abstention"), F.count("ref_id").alias("wanted"), F.count(F.when(F.col("ref_id").isNotNull(), F.col("seen"))).alias("found"))
    hit = F.when(F.col("abstention") | (F.col("wanted") == 0), "not applicable").when(F.col("wanted") == F.col("found"), "full").when(F.col("found") > 0, "partial").otherwise("missing")
    return judged.select("question", hit.alias("hit"))


def validated(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and fault of observed rows that nothing expects, of expected ones that are missing, and of repeated ones."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    o = observed.groupBy(*keys).agg(F.count("*").alias("observed"))
    both = e.join(o, keys, "full_outer")
    fault = F.when(F.col("expected").isNull(), "not expected").when(F.col("observed").isNull(), "missing").when(F.col("expected") > 1, "expected twice").when(F.col("observed") > 1, "observed twice")
    return both.select(*keys, fault.alias("fault")).filter("fault is not null")


def by_task_type(tasks: DataFrame) -> DataFrame:
    """Tasks, successes, rates and mean process score of each task type; tasks: task_type, success, process_score."""
    return tasks.groupBy("task_type").agg(F.count("*").alias("tasks"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("process_score").alias("process_score"))


def response_quality(edges: DataFrame, nodes: DataFrame, details: DataFrame) -> DataFrame:
    """Nodes, relationships, details, detail_coverage and causal_density of each request.

    edges: request_id, source, target, semantic_class; nodes and details: request_id, node_id. Ends that are empty are
    no nodes; ratios over nothing are 0.
    """
    ends = edges.withColumn("end", F.explode(F.array("source", "target"))).filter(F.col("end") != "").groupBy("request_id").agg(F.count_distinct("end").alias("relation_nodes"))
    causal = F.col("semantic_class").isin(*scalars.DENSITY_CLASSES)
    counts = edges.groupBy("request_id").agg(F.count("*").alias("relationships"), F.count_if(causal).alias("causal"))
    n = nodes.groupBy("request_id").agg(F.count_distinct("node_id").alias("nodes"))
    d = details.groupBy("request_id").agg(F.count_distinct("node_id").alias("details"))
    every = n.join(counts, "request_id", "full_outer").join(ends, "request_id", "left").join(d, "request_id", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return every.select("request_id", "nodes", "relationships", "relation_nodes", "details", ratio("details", "nodes").alias("detail_coverage"), ratio("causal", "relationships").alias("causal_density"))


def ref_differences(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """K2: the keys and sorted arrays missing and extra of references (ref_id) that only one side has; equal rows count once."""
    a = expected.select(*keys, "ref_id").distinct().withColumn("expected", F.lit(True))
    b = observed.select(*keys, "ref_id").distinct().withColumn("observed", F.lit(True))
    both = a.join(b, [*keys, "ref_id"], "full_outer")
    only = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col("ref_id"))))
    return both.groupBy(*keys).agg(only("observed").alias("missing"), only("expected").alias("extra"))


def cross_tabs(runs: DataFrame, by: list[list[str]], hits: list[str]) -> DataFrame:
    """For each list of dimensions in `by`, the runs of each of its cells and how many have each flag of hits.

    One pass: all groupings share an expand and an aggregate with a partial step. Dimensions that a grouping leaves out are
    null, and `level` says which those are, so that a null value of a dimension is told apart.
    """
    dims = sorted({d for g in by for d in g})
    out = runs.groupingSets([[F.col(d) for d in g] for g in by], *(F.col(d) for d in dims)).agg(F.count("*").alias("runs"), *(F.count_if(F.col(h)).alias(h) for h in hits), F.grouping_id().alias("bits"))
    names = F.filter(F.array(*(F.when((F.col("bits").bitwiseAND(1 << (len(dims) - 1 - i))) == 0, F.lit(d)) for i, d in enumerate(dims))), lambda x: x.isNotNull())
    return out.select(F.array_join(names, ",").alias("level"), *dims, "runs", *hits)


def controlled(runs: DataFrame, factor: str, high: str, low: str, same: list[str], hits: list[str]) -> DataFrame:
    """For each cell of the dimensions that are held the same, runs and hit rates with the factor high and low, and
    their difference; cells with runs of one side alone say nothing and are left out."""
    side = {"high": F.col(factor) == high, "low": F.col(factor) == low}
    n = [F.count_if(c).alias(f"n_{s}") for s, c in side.items()]
    k = [F.count_if(c & F.col(h)).alias(f"{h}_{s}") for h in hits for s, c in side.items()]
    cells = runs.filter(F.col(factor).isin(high, low)).groupBy(*same).agg(*n, *k).filter("n_high > 0 and n_low > 0")
    gains = [(F.col(f"{h}_high") / F.col("n_high") - F.col(f"{h}_low") / F.col("n_low")).alias(f"{h}_gain") for h in hits]
    return cells.select(*same, "n_high", "n_low", *gains)


def cost_of_success(runs: DataFrame, by: list[str], success: str, tokens: str) -> DataFrame:
    """Tokens spent for each success, of all runs of a cell; null without a success."""
    hit = F.count_if(F.col(success))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), hit.alias("successes"), F.when(hit > 0, F.sum(tokens) / hit).alias("tokens_per_success"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the two sides do not have equally often, with by how much more often the left one has them.

    Multisets are compared by one aggregate of signed counts over both, which sees nulls as equal; empty for equal sides.
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("side")).unionByName(right.select(*columns, F.lit(-1).alias("side")))
    return both.groupBy(*columns).agg(F.sum("side").alias("more")).filter("more <> 0")
