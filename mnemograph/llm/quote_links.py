"""Operator 5 (native): replies found by the quotes in messages, and conversations in reply order without quotes.

A line's quote level is the number of > marks that open it. Consecutive lines of one level are a passage. The whole of
a passage, and each of its lines of eight characters or more, is normalised (lower case, letters and digits only, one
space) and hashed; so are each message's own text and lines. The first turn of a conversation that has a quoted hash is
the original. A message replies to the latest original among its passages of the lowest level, or else to the last
turn of its conversation before it. In the order (reply_to, turn), nulls first, every message stands behind the one it
replies to; a message's position is its place in that order, from 1, by a window over its conversation.

Null and empty texts have no lines, no quotes and an empty body. A null conv_id or turn links to nothing, and a null
conv_id is no conversation: it has no position. Rows that
repeat a turn are each returned, and are one original; of originals with one hash the first turn counts. A text of any
length is one row, and takes time in proportion to its lines. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_QUOTED = r"(?m)^[ \t]*>"
#: A line that introduces a quote: someone wrote something on some date.
_ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """messages with lines (array of level and text), body and passages (array of level and text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = lambda line: F.regexp_extract(line, r"^((?:[ \t]*>)+)", 1)
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "").alias("text")))

    none = F.expr("cast(array() as array<struct<level:int,text:string>>)")
    has = text.rlike(_QUOTED)

    def runs(xs: Column) -> Column:
        level = lambda i: F.get(xs, i)["level"]
        first = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (level(i) != level(F.greatest(i - 1, F.lit(0)))))
        joined = lambda a, b: F.array_join(F.transform(F.slice(xs, a + 1, b - a), lambda x: x["text"]), "\n")
        passage = lambda at: lambda a, k: common.bound(F.coalesce(F.get(at, k + 1), F.size(xs)), lambda b: F.struct(level(a).alias("level"), F.when(level(a) > 0, joined(a, b)).otherwise("").alias("text")))
        return F.filter(common.bound(first, lambda at: F.transform(at, passage(at))), lambda x: x["level"] > 0)

    own = F.array_join(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["text"].rlike(_ATTRIBUTION)), lambda x: x["text"]), "\n")
    return (
        messages.withColumn("lines", F.when(has, lines).otherwise(none))
        .withColumn("passages", F.when(has, common.bound(F.col("lines"), runs)).otherwise(none))
        .withColumn("body", F.when(has, F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(text))
        .drop("lines")
    )


def _units(text: Column) -> Column:
    """Hashes of the normalised text and of each of its normalised lines that is long enough."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), _normal), lambda x: F.length(x) >= 8)
    whole = F.filter(F.array(_normal(text)), lambda x: F.length(x) > 0)
    return F.array_distinct(F.transform(F.concat(whole, lines), lambda x: F.xxhash64(x)))


def _gaps(read: DataFrame) -> DataFrame:
    """conv_id, turn and before (the last turn before it, or null) where that is not the number before the turn."""
    turns = read.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = turns.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return before.filter("not (before <=> case when turn > 0 then turn - 1 end)").withColumn("gap", F.lit(True))


def link_replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, quote_levels, linked, reply_to of every message."""
    read = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = parse(read).drop("text")
    quoting = parsed.filter(F.size("passages") > 0)
    quotes = quoting.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", F.col("turn").alias("quoting"), "p.level", F.explode(_units(F.col("p.text"))).alias("unit"))
    wanted = quotes.select("conv_id", "unit").distinct()
    origins = (
        parsed.select("conv_id", "turn", F.explode(_units(F.col("body"))).alias("unit"))
        .groupBy("conv_id", "unit")
        .agg(F.min("turn").alias("origin"))
        .join(wanted, ["conv_id", "unit"], "left_semi")
    )
    found = (
        quotes.join(origins, ["conv_id", "unit"])
        .filter("origin < quoting")
        .groupBy("conv_id", F.col("quoting").alias("turn"))
        .agg(F.max(F.struct((-F.col("level")).alias("near"), "origin")).alias("m"))
        .select("conv_id", "turn", F.col("m.origin").alias("origin"))
    )
    levels = F.coalesce(F.array_max(F.transform("passages", lambda x: x["level"])), F.lit(0)).cast("long")
    # Only messages that quote can be linked; the others take no part in the join.
    linked = parsed.filter(F.size("passages") > 0).join(found, ["conv_id", "turn"], "left").withColumn("quote_levels", levels)
    plain = parsed.filter(F.size("passages") == 0).withColumns({"origin": F.lit(None).cast("long"), "quote_levels": F.lit(0).cast("long")})
    # Turns without gaps need no join: the side of the gaps is small or empty.
    every = plain.unionByName(linked).join(common.sized(_gaps(read)), ["conv_id", "turn"], "left")
    before = F.when(F.col("gap"), F.col("before")).when(F.col("conv_id").isNotNull() & (F.col("turn") > 0), F.col("turn") - 1)
    return every.select("conv_id", "turn", "role", "body", "quote_levels", F.col("origin").isNotNull().alias("linked"), F.coalesce("origin", before).alias("reply_to"))


def in_reply_order(linked: DataFrame, tie: str) -> DataFrame:
    """linked (conv_id, turn, reply_to) with position: the place in the conversation's reply order; of one turn's rows by `tie`."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("reply_to"), F.asc_nulls_first("turn"), tie)
    placed = linked.filter("conv_id is not null").withColumn("position", F.row_number().over(order).cast("long"))
    return placed.unionByName(linked.filter("conv_id is null").withColumn("position", F.lit(None).cast("long")))


def chat_text(role: Column, body: Column) -> Column:
    """A message in chat form: its role in a tag, then its body."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), body, F.lit("\n"))


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_replies(common.table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", "reply_to", "linked", "quote_levels", F.length("body").cast("long").alias("n_chars"), F.sha2(chat_text(F.col("role"), F.col("body")), 256).alias("chat_sha256"))


#: Every message of the tables without quotes replies to the turn before it.
OP5_SQL = """
SELECT conv_id, turn, role, CASE WHEN turn > 0 THEN turn - 1 END AS reply_to, false AS linked, CAST(0 AS BIGINT) AS quote_levels,
  CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
  sha256('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10)) AS chat_sha256
FROM conversations
"""


def op5_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_replies(common.table(spark, sf_dir, "conversations"))
    said = linked.select("conv_id", "turn", "reply_to", F.sha2(chat_text(F.col("role"), F.col("body")), 256).alias("chat_sha256"))
    return in_reply_order(said, "chat_sha256")


#: As above; the turns of the tables have no gaps.
OP5_ORDER_SQL = """
WITH said AS (
  SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS reply_to,
    sha256('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10)) AS chat_sha256
  FROM conversations)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY reply_to NULLS FIRST, turn NULLS FIRST, chat_sha256) AS position FROM said
"""
