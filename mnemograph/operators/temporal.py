"""Temporal selection over positions (T1 to T13), what is known at a step (T15, T16, W1, K17): every request of a batch in one plan.

positions: about, dimension, scope_id, ref_id, axis, key. requests: request_id, about, axis, key (the cursor).
An empty or missing key gives no position. Requests without a match give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.functions import scalars

#: Axes in the order in which positions sort.
TIME, SEQUENCE, RANK, REF = 0, 1, 2, 3
#: Rows that a move returns where a request names no number.
GOTO_LIMIT, STEP_LIMIT, NEAR_BEFORE, NEAR_AFTER = 50, 5, 2, 2


def positions(entries: DataFrame) -> DataFrame:
    """A position for each axis that an entry has, by reference where it has none.

    The time axis takes the first known of occurred_at, valid_from, observed_at and ingested_at.
    """
    have = set(entries.columns)
    times = [scalars.time_key(F.col(c)) for c in ("occurred_at", "valid_from", "observed_at", "ingested_at") if c in have]
    padded = lambda c: F.lpad(F.col(c).cast("string"), 10, "0") if c in have else F.lit(None).cast("string")
    axis = lambda n, key: F.struct(F.lit(n).alias("axis"), key.alias("key"))
    known = F.filter(F.array(axis(TIME, F.coalesce(*times) if times else F.lit(None).cast("string")), axis(SEQUENCE, padded("sequence")), axis(RANK, padded("rank"))), lambda p: p["key"].isNotNull())
    found = F.when(F.size(known) > 0, known).otherwise(F.array(axis(REF, F.col("ref_id"))))
    scoped = entries.filter((F.trim("dimension") != "") & (F.trim("scope_id") != ""))
    return scoped.select("about", "dimension", "scope_id", "ref_id", F.explode(found).alias("p")).select("about", "dimension", "scope_id", "ref_id", "p.axis", "p.key")


def order() -> list[Column]:
    """The total order of positions."""
    return [F.col(c) for c in ("axis", "key", "dimension", "scope_id", "ref_id")]


def cursor_of_refs(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requests (request_id, about, ref_id) with the smallest position of their reference; axis is null if it has none."""
    least = found.groupBy("about", "ref_id").agg(F.min(F.struct("axis", "key", "dimension", "scope_id")).alias("p"))
    return requests.join(least, ["about", "ref_id"], "left").select("request_id", "about", F.col("p.axis").alias("axis"), F.col("p.key").alias("key"))


def _met(found: DataFrame, requests: DataFrame, where: Column) -> DataFrame:
    cursor = requests.select("request_id", "about", "axis", F.col("key").alias("cursor"))
    return found.join(cursor, ["about", "axis"]).filter(where)


def where(direction: str) -> Column:
    """Which positions of a cursor's axis lie in a direction."""
    return {"goto": F.col("key") <= F.col("cursor"), "rewind": F.col("key") < F.col("cursor"), "forward": F.col("key") > F.col("cursor")}[direction]


def move(found: DataFrame, requests: DataFrame, direction: str, limit: int | None = None) -> DataFrame:
    """Goto (to the cursor, with it), rewind (before it) or forward (behind it): the nearest positions, in order."""
    most = limit or (GOTO_LIMIT if direction == "goto" else STEP_LIMIT)
    keys = order() if direction == "forward" else [c.desc() for c in order()]
    near = _met(found, requests, where(direction)).withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy(*keys))).filter(F.col("nth") <= most)
    return near.drop("cursor", "nth")


def near(found: DataFrame, requests: DataFrame, before: int = NEAR_BEFORE, after: int = NEAR_AFTER) -> DataFrame:
    """The last positions before the cursor, all at it and the first behind it."""
    side = F.when(F.col("key") < F.col("cursor"), -1).when(F.col("key") > F.col("cursor"), 1).otherwise(0)
    met = _met(found, requests, F.lit(True)).withColumn("side", side)
    # One pass in order: so far behind a position another side begins, or so far before it another side ends.
    w = Window.partitionBy("request_id").orderBy("side", *order())
    last = (F.col("side") == -1) & (F.coalesce(F.lead("side", before).over(w), F.lit(1)) >= 0)
    first = (F.col("side") == 1) & (F.coalesce(F.lag("side", after).over(w), F.lit(-1)) <= 0)
    return met.withColumn("near", last | first | (F.col("side") == 0)).filter("near").drop("cursor", "near", "side")


def refs(selected: DataFrame) -> DataFrame:
    """Each reference once, at its first position, numbered from 1."""
    place = F.min(F.struct(*order())).alias("p")
    once = selected.groupBy("request_id", "ref_id").agg(place)
    return once.select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("p")).cast("long").alias("place"), "ref_id")


def page(found: DataFrame, requests: DataFrame, direction: str, limit: int | None = None) -> DataFrame:
    """Returned, total, has_more and next_cursor of a move."""
    total = _met(found, requests, where(direction)).groupBy("request_id").agg(F.count_distinct("ref_id").alias("total"))
    got = refs(move(found, requests, direction, limit))
    end = F.max_by("ref_id", "place") if direction == "forward" else F.min_by("ref_id", "place")
    shown = got.groupBy("request_id").agg(F.count("*").alias("returned"), end.alias("end"))
    more = F.col("total") > F.col("returned")
    return total.join(shown, "request_id").select("request_id", "returned", "total", more.alias("has_more"), F.when(more, F.col("end")).alias("next_cursor"))


def coverage(selected: DataFrame) -> DataFrame:
    """References and scopes of each dimension that a request's positions have."""
    return selected.groupBy("request_id", "dimension").agg(F.count_distinct("ref_id").alias("refs"), F.count_distinct("scope_id").alias("scopes"))


def by_dimension(found: DataFrame, mode: str, kinds: list[str]) -> DataFrame:
    """ALL, ONLY or EXCEPT these dimensions."""
    return {"all": found, "only": found.filter(F.col("dimension").isin(*kinds)), "except": found.filter(~F.col("dimension").isin(*kinds))}[mode]


def by_about(found: DataFrame, abouts: DataFrame) -> DataFrame:
    """positions whose scope names one of the abouts; a scope that names none is dropped."""
    keyed = found.withColumn("scope_about", scalars.scope_about(F.col("scope_id")))
    return keyed.join(abouts.select(F.col("about").alias("scope_about")).distinct(), "scope_about", "left_semi").drop("scope_about")


def by_scope(found: DataFrame, scopes: list[str]) -> DataFrame:
    """positions of these scopes, named in full or by their dimension; no scopes leave all."""
    return found.filter(F.col("scope_id").isin(*scopes) | F.coalesce(scalars.scope_dimension(F.col("scope_id")).isin(*scopes), F.lit(False))) if scopes else found


def first_known(steps: DataFrame) -> DataFrame:
    """Task, ref_id and the step that first wrote it; steps: task, step, ref_id."""
    return steps.groupBy("task", "ref_id").agg(F.min("step").alias("first"))


def _known(steps: DataFrame, asked: DataFrame) -> DataFrame:
    """Task, step and known of the steps of asked (task, step)."""
    new = first_known(steps).groupBy("task", F.col("first").alias("step")).agg(F.count("*").alias("new"))
    every = new.select("task", "step").union(asked.select("task", "step")).distinct().join(new, ["task", "step"], "left").fillna({"new": 0})
    before = Window.partitionBy("task").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    summed = every.select("task", "step", F.coalesce(F.sum("new").over(before), F.lit(0)).alias("known"))
    return summed.join(asked.select("task", "step").distinct(), ["task", "step"], "left_semi")


def known_at(steps: DataFrame) -> DataFrame:
    """Task, step and how many references were written in earlier steps: a running sum of those first written there.

    The references themselves are first_known with first < step; no step lists them, so rows stay as many as steps.
    """
    return _known(steps, steps)


def leak_check(steps: DataFrame, observed: DataFrame, answers: DataFrame) -> DataFrame:
    """Unexpected, missing, leaked answer and clean of each task and step with a known or an observed reference.

    steps, observed: task, step, ref_id; answers: task, step, ref_id of the expected answer. A reference is allowed where
    an earlier step has written it. Missing ones are counted, not listed: those known less those observed.
    """
    keys = ["task", "step"]
    seen = observed.select(*keys, "ref_id").distinct().join(first_known(steps), ["task", "ref_id"], "left")
    judged = seen.join(answers.select(*keys, "ref_id").distinct().withColumn("w", F.lit(True)), [*keys, "ref_id"], "left")
    allowed = F.coalesce(F.col("first") < F.col("step"), F.lit(False))
    got = judged.groupBy(*keys).agg(F.count_if(~allowed).alias("unexpected"), F.count_if(allowed).alias("hits"), F.coalesce(F.bool_or("w"), F.lit(False)).alias("leaked"))
    asked = _known(steps, steps.select(*keys).union(observed.select(*keys)))
    both = asked.join(got, keys, "left").fillna({"unexpected": 0, "hits": 0, "leaked": False})
    shown = both.filter("known > 0 or unexpected + hits > 0")
    return shown.select(*keys, "unexpected", (F.col("known") - F.col("hits")).alias("missing"), "leaked", (F.col("unexpected") == 0).alias("clean"))


def as_of(facts: DataFrame, asks: DataFrame) -> DataFrame:
    """request_id, key, at and ref, the latest fact of the key before `at`; null if none is known.

    facts: key, at, ref; asks: request_id, key, at. Both are sorted together by key and time, and a running last value
    passes the facts on; so there is no range join, and a row of either is read once. Of facts at one time the largest
    ref is the last; a fact at the very time of an ask is not known yet.
    """
    both = facts.select("key", "at", F.lit(1).alias("kind"), "ref", F.lit(None).alias("request_id")).unionByName(asks.select("key", "at", F.lit(0).alias("kind"), F.lit(None).alias("ref"), "request_id"))
    w = Window.partitionBy("key").orderBy("at", "kind", F.col("ref").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("ref", F.last("ref", ignorenulls=True).over(w))
    return known.filter("kind = 0").select("request_id", "key", "at", "ref")


def fact_scores(facts: DataFrame, asks: DataFrame, observed: DataFrame) -> DataFrame:
    """What each ask's answer did with the facts known at its time: unexpected, missing, clean and current.

    facts: key, at, ref; asks: request_id, key, at; observed: request_id, ref. A reference is allowed if a fact of the
    ask's key has it at an earlier time; clean without any other; current if the latest known fact is among the observed.
    """
    times = facts.groupBy("key", "ref").agg(F.min("at").alias("first"))
    steps = times.select(F.col("key").alias("task"), F.col("first").alias("step"), F.col("ref").alias("ref_id"))
    counted = _known(steps, asks.select(F.col("key").alias("task"), F.col("at").alias("step")))
    seen = observed.select("request_id", "ref").distinct().join(asks, "request_id").join(times, ["key", "ref"], "left")
    allowed = F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    got = seen.groupBy("request_id").agg(F.count_if(~allowed).alias("unexpected"), F.count_if(allowed).alias("hits"))
    last = as_of(facts, asks).join(observed.select("request_id", "ref").distinct().withColumn("seen", F.lit(True)), ["request_id", "ref"], "left").select("request_id", "key", "at", "ref", F.coalesce("seen", F.lit(False)).alias("current"))
    out = last.join(got, "request_id", "left").fillna({"unexpected": 0, "hits": 0}).join(counted.select(F.col("task").alias("key"), F.col("step").alias("at"), "known"), ["key", "at"])
    return out.select("request_id", F.col("ref").alias("latest"), "unexpected", (F.col("known") - F.col("hits")).alias("missing"), (F.col("unexpected") == 0).alias("clean"), "current")


def coordinates(selected: DataFrame) -> DataFrame:
    """Each reference's distinct coordinates (axis, key, dimension, scope_id), in order."""
    every = F.array_sort(F.collect_set(F.struct("axis", "key", "dimension", "scope_id")))
    return selected.groupBy("request_id", "ref_id").agg(every.alias("coordinates"))


def missing_positions(found: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and missing: whether the request's subject has no position on the cursor's axis."""
    have = found.select("about", "axis").distinct().withColumn("here", F.lit(True))
    return requests.join(have, ["about", "axis"], "left").select("request_id", F.col("here").isNull().alias("missing"))


def about_roots(roots: Column, current: Column) -> Column:
    """the distinct roots that are not blank, in order, the current one before the others."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(roots, lambda x: F.trim(x)), lambda x: x != "")))
    at = F.trim(F.coalesce(current, F.lit("")))
    return F.when(F.array_contains(clean, at), F.concat(F.array(at), F.filter(clean, lambda x: x != at))).otherwise(clean)


def requested_scopes(requests: DataFrame) -> DataFrame:
    """request_id and the scopes that a selection asks for, by their full names.

    requests: request_id, current, mode (all, only, except), scope_mode (current, abouts, all), and arrays dimensions,
    abouts, roots and scope_ids. Named scopes win: each is resolved under each about, those of other abouts fall out,
    and the rest is distinct and sorted. Without any, only the mode "only" asks for scopes: its dimensions under its
    abouts, distinct and sorted too.
    """
    abouts = F.when(F.col("scope_mode") == "current", F.array("current")).when(F.col("scope_mode") == "abouts", F.col("abouts")).otherwise(F.col("roots"))

    def under(about: Column, scope: Column) -> Column:
        named = scalars.scope_about(scope)
        return F.when(named.isNull() & (F.trim(scope) != ""), scalars.dimension_identity(about, F.trim(scope))).when(named == about, scalars.dimension_identity(about, scalars.scope_dimension(scope)))

    named = F.array_sort(F.array_distinct(F.flatten(F.transform(abouts, lambda a: F.array_compact(F.transform("scope_ids", lambda s: under(a, s)))))))
    kinds = F.filter("dimensions", lambda d: F.trim(d) != "")
    ordered = lambda x: F.array_sort(F.array_distinct(x))
    asked = F.array_distinct(F.flatten(F.transform(ordered(abouts), lambda a: F.transform(ordered(F.transform(kinds, lambda d: F.trim(d))), lambda d: scalars.dimension_identity(a, d)))))
    none = F.expr("cast(array() as array<string>)")
    scopes = F.when(F.size("scope_ids") > 0, named).when(F.col("mode") == "only", asked).otherwise(none)
    return requests.select("request_id", F.coalesce(scopes, none).alias("scopes"))
