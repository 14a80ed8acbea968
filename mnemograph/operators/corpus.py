"""Corpora, chunks, runs and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def iso_date(x: Column) -> Column:
    """`2023/05/20 (Sat) 02:21` as `2023-05-20T02:21:00Z`; other texts are null."""
    p = r"^(\d{4})/(\d{2})/(\d{2})\s+\(\w+\)\s+(\d{2}):(\d{2})$"
    g = lambda i: F.regexp_extract(x, p, i)
    return F.when(x.rlike(p), F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), g(4), F.lit(":"), g(5), F.lit(":00Z")))


def chunks(text: Column, most: int = 1800) -> Column:
    """Numbered fact lines if there are two or more, else paragraphs if there are, else words packed to so many characters."""
    facts = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+\s*\..+$"))
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.length(last) + 1 + F.length(w) <= most
        return F.when(F.size(acc) == 0, F.array(w)).when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(acc, F.array(w)))

    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    packed = F.aggregate(words, F.expr("cast(array() as array<string>)"), lambda a, w: F.when(F.size(a) == 0, F.array(w)).otherwise(step(a, w)))
    return F.when(F.size(facts) >= 2, facts).when(F.size(paragraphs) >= 2, paragraphs).otherwise(packed)


#: Words of a question that name an operation, in the order in which they are tried.
OPERATIONS = (("difference", ("difference", "more than", "less than", "how many days", "between")), ("average", ("average", "mean")), ("max_by", ("most", "highest", "largest", "latest")), ("count", ("how many", "number of")), ("sum", ("total", "sum", "how much", "altogether")))


def operation(question: Column) -> Column:
    """K4: the operation that a question asks for; unknown without any of the words."""
    low, out = F.lower(question), F.lit("unknown")
    for name, words in reversed(OPERATIONS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def anonymous(refs: DataFrame) -> DataFrame:
    """row_id, ref and its alias: references of a row numbered by their first place (place)."""
    first = refs.groupBy("row_id", "ref").agg(F.min("place").alias("place"))
    return first.select("row_id", "ref", F.concat(F.lit("ref_"), F.row_number().over(Window.partitionBy("row_id").orderBy("place", "ref")).cast("string")).alias("alias"))


def run_inventory(refs: DataFrame) -> DataFrame:
    """Run and how many references name it; references of no run are under null."""
    run = F.nullif(F.regexp_extract("ref", r"run:(.*?):task_type", 1), F.lit(""))
    return refs.groupBy(run.alias("run")).agg(F.count("*").alias("refs"))


def ref_audit(inventory: DataFrame, observed: DataFrame) -> DataFrame:
    """Ref and fault: foreign if it was observed and is not in the inventory, missing the other way round."""
    a, b = inventory.select("ref").distinct(), observed.select("ref").distinct()
    return b.join(a, "ref", "left_anti").select("ref", F.lit("foreign").alias("fault")).union(a.join(b, "ref", "left_anti").select("ref", F.lit("missing")))


def policy_rates(predictions: DataFrame) -> DataFrame:
    """Predictions, valid share, tool accuracy among the valid and exact accuracy among those with the right tool."""
    valid = F.col("predicted_tool").isNotNull()
    tool = valid & (F.col("predicted_tool") == F.col("tool"))
    exact = tool & (F.col("predicted_args") == F.col("args"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rate = lambda a, b: F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0))
    return predictions.groupBy("mode").agg(F.count("*").alias("predictions"), rate(valid, F.lit(True)).alias("valid_rate"), rate(tool, valid).alias("tool_rate"), rate(exact, tool).alias("exact_rate"))


def lifecycle(events: DataFrame) -> DataFrame:
    """One row for each entry with the time of each kind of event, and its last one."""
    kinds = ("start", "read", "llm", "dry_run", "commit", "verify")
    return events.groupBy("entry").agg(*(F.max(F.when(F.col("kind") == k, F.col("at"))).alias(f"{k}_at") for k in kinds), F.max_by("kind", "at").alias("state"))
