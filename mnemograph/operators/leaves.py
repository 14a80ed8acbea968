"""Leaves of JSON values of any shape, by variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def property_text(value: Column) -> Column:
    """A variant as a property: null is empty, text stays as it is, numbers and truth values as written, others as JSON."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | (kind == "VOID"), "").when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def trimmed_answer(text: Column) -> Column:
    """A candidate answer without quotes around it, a leading `Answer:`, a final point and what follows `Confidence:`."""
    bare = F.trim(F.regexp_replace(F.trim(text), '^"+|"+$', ""))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, "^(Answer:)+", "")), r"\.+$", ""))
    return F.when(F.contains(bare, F.lit("Confidence:")), F.trim(F.substring_index(bare, "Confidence:", 1))).otherwise(bare)


#: A text (with the colon behind it, if it is a member's name), number or word of a JSON text without white space.
_TOKEN = r'"(?:[^"\\]++|\\.)*+":?|[^\[\]{},"]++'


def meaningful(values: DataFrame) -> DataFrame:
    """Id, place and leaf of the distinct texts and numbers in a JSON value (id, json), in the order in which they
    first occur; members of objects are in the order of their keys.

    Null, truth values, and texts that are empty, - or N/A are no leaves; what is no JSON has none. A variant's text has the
    members in order and no white space, so its leaves stand in it in their order, at any depth: each value is parsed once,
    and one pattern takes the tokens. Values of one id are taken together, by the number of a leaf's token.
    """
    whole = values.select("id", F.to_json(F.try_parse_json("json")).alias("whole"))
    nested = F.col("whole").startswith("[") | F.col("whole").startswith("{")
    found = whole.select("id", nested.alias("nested"), F.posexplode(F.regexp_extract_all("whole", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    found = found.filter(~F.col("token").endswith('":') & ~F.col("token").isin("null", "true", "false"))
    token, text = F.col("token"), F.col("token").startswith('"')
    inner = F.substring(token, F.lit(2), F.length("token") - 2)
    said = F.when(token.contains("\\"), F.try_variant_get(F.parse_json("token"), "$", "string")).otherwise(inner)
    # Most texts have nothing that trimmed_answer takes away. A part's number is written as it is by itself.
    leaf = F.when(text, F.when(token.rlike(r'[.:\\]|^" | "$'), trimmed_answer(said)).otherwise(inner)).when(F.col("nested") & token.contains("."), F.to_json(F.parse_json("token"))).otherwise(token)
    kept = found.select("id", F.struct("pos", leaf.alias("leaf")).alias("x"), text.alias("text"))
    kept = kept.filter(~(F.col("text") & F.col("x.leaf").isin("", "-", "N/A")))
    once = kept.groupBy("id", F.col("x.leaf").alias("leaf")).agg(F.min("x.pos").alias("pos"))
    return once.select("id", F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("long").alias("place"), "leaf")
