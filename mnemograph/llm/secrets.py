"""Operator 8 (native): secret spans in texts, by patterns and by sliding-window Shannon entropy.

Everything is one projection of built-in functions: no shuffle, no Python on the executors. A pattern's matches come
from regexp_extract_all and the pieces between them from split, so that positions are running sums of code points.

Entropy: a candidate is a maximal run of a character class, with digits or without. A window slides over it by one
character; the sum of c log2 c over the counts of its characters changes by those of the character that enters and of
the one that leaves. A candidate whose best window reaches the class's bits is a span of kind `entropy`, unless an allow-list
pattern matches the candidate or a pattern's span covers part of it. A candidate of so few characters that no window
can reach the bits is not slid over.

Null texts are empty: no spans. doc_id may be null or repeat: a row in, a row out. Matches of a kind never overlap;
spans of different kinds may, and each stays. Very long texts and runs take time in proportion to their length. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Kind:
    """A pattern of secrets; group holds what must have `least` characters at least."""

    name: str
    pattern: str
    group: int
    least: int


@dataclass(frozen=True)
class EntropyClass:
    """Runs of these characters, `least` long at least, and the bits that the best window must reach."""

    characters: str
    least: int
    window: int
    bits: float


KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
ENTROPY = (EntropyClass("A-Fa-f0-9", 24, 24, 3.0), EntropyClass("A-Za-z0-9+/_=-", 20, 20, 3.7))
#: Candidates that are not secrets: UUIDs, dates and times, digits alone, and names of files or hosts in lower case with a number.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9][0-9/_=+-]*$",
    r"^[a-z]*(?:[-_/][a-z]+)*[-_/]?[0-9]{1,4}$",
)


def _folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str, part: int = 64) -> Column:
    """Outputs (of type out) of a fold whose step returns the next state and an output; in parts, so that no long array is copied at each step."""
    none = F.expr(f"cast(array() as array<{out}>)")

    def one(acc: Column, x: Column) -> Column:
        state, made = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(made)).alias("out"))

    def many(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return common.bound(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / part).cast("int"))), lambda k: F.slice(x, k * part + 1, F.lit(part)))
        return F.aggregate(parts, F.struct(start.alias("state"), F.expr(f"cast(array() as array<array<{out}>>)").alias("out")), many, lambda acc: F.flatten(acc["out"]))

    return common.bound(items, whole)


_SPAN = "struct<start:int,end:int,raw:string,value:string>"


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, raw, value) of the matches whose group is long enough."""
    p = F.lit(pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("value"),
        F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, p, F.lit(0)))).alias("gap"),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("raw"), x["value"].alias("value"))

    kept = F.filter(_folded(found, F.lit(0), step, _SPAN), lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def best_window_bits(s: Column, window: int, part: int = 256) -> Column:
    """Highest Shannon entropy, in bits a character, of the windows of an ASCII string; 0 if it is shorter.

    The string is read in parts that overlap by a window, since the place of a character in a long string is found by
    counting. In a part, the window moves by a character; counts of the two characters that change, taken in what the
    windows before and after have in common, change the sum of c log2 c.
    """
    parts = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{part}}}"), F.lit(0))
    overlapping = lambda ps: F.transform(ps, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(ps, i + 1), 1, window - 1), F.lit(""))))

    def gain(c: Column, shared: Column) -> Column:
        n = F.length(shared) - F.length(F.replace(shared, c, F.lit("")))
        return (n + 1) * F.log2(n + 1) - F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))

    def best(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            shared = F.substring(x, F.greatest(F.lit(1), i - window + 1), F.least(i - 1, F.lit(window - 1)))
            gone = F.when(i > window, gain(F.substring(x, i - window, F.lit(1)), shared)).otherwise(F.lit(0.0))
            total = acc["total"] - gone + gain(F.substring(x, i, F.lit(1)), shared)
            bits = F.log2(F.lit(float(window))) - total / window
            return F.struct(total.alias("total"), F.when(i >= window, F.greatest(acc["most"], bits)).otherwise(acc["most"]).alias("most"))

        start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("most"))
        return F.aggregate(F.sequence(F.lit(1), F.length(x)), start, step, lambda acc: acc["most"])

    return F.array_max(F.transform(common.bound(parts, overlapping), best))


def _placed(spans: Column, place: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _entropy_spans(text: Column, base: Column, classes: tuple[EntropyClass, ...], allowed: tuple[str, ...]) -> Column:
    def secret(c: EntropyClass) -> Callable[[Column], Column]:
        def check(x: Column) -> Column:
            ok = ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            for a in allowed:
                ok = ok & ~x["raw"].rlike(a)
            ok = ok & (F.size(F.array_distinct(F.split(x["raw"], ""))) >= 2.0**c.bits - 1e-9)
            return F.when(ok, best_window_bits(x["raw"], c.window) >= c.bits).otherwise(F.lit(False))

        return check

    groups = [F.filter(_matches(text, f"[{c.characters}]{{{c.least},}}", 0, c.least), secret(c)) for c in classes]
    spans = _placed(F.concat(*groups), len(KINDS), "entropy")
    return F.array_distinct(spans)


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, classes: tuple[EntropyClass, ...] = ENTROPY, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with `base` and `spans`: arrays of (start, place, end, kind), code points, end exclusive, by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [_placed(_matches(text, k.pattern, k.group, k.least), i, k.name) for i, k in enumerate(kinds)]
    based = docs.withColumn("base", F.array_sort(F.concat(*found)))
    return based.withColumn("spans", F.array_sort(F.concat("base", _entropy_spans(text, F.col("base"), classes, allowed))))


def written_spans(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", block: int = 1024) -> Column:
    """The text with each span, or group of spans that overlap, replaced by a mark.

    A place in a long string is found by counting, so the text is cut into blocks once, and what lies between two spans is
    taken from theirs: a span costs a block, wherever it stands.
    """

    def cut(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            i, j = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
            head = F.substring(F.get(blocks, i), (a % block + 1).cast("int"), F.least(F.lit(block) - a % block, b - a).cast("int"))
            middle = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            tail = F.when(j > i, F.substring(F.get(blocks, j), F.lit(1), (b % block).cast("int")))
            return F.concat(F.coalesce(head, F.lit("")), middle, F.coalesce(tail, F.lit("")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            piece = F.concat(between(at, x["start"]), F.lit(mark))
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, piece).otherwise(F.lit(""))

        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(_folded(spans, F.lit(0), step, "string"), ""), between(last, F.length(text)))

    return F.when(F.size(spans) > 0, common.bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), cut)).otherwise(text)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.texts(common.table(spark, sf_dir, "documents")))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k.name) for k in KINDS),
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.col("spans")).alias("spans"),
        count("entropy"),
    )
