"""Queries of interpretation, derivation and evaluation over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.functions import scalars
from mnemograph.functions import spans
from mnemograph.operators import evaluate, interpret
from mnemograph.sources import views

from .registry import query


def _line_ref():
    return F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey")


_LINES = "SELECT 'line:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS ref_id, * FROM lineitem"


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts such as: Paid $1,200.50 for hardware and another 30 EUR for shipping."""
    line = views.spread(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), cents % 100)
    return line.select(_line_ref().alias("ref_id"), F.concat(F.lit("Paid $"), price, F.lit(" for part "), F.col("l_partkey").cast("string"), F.lit(" and another "), F.col("l_quantity").cast("long").cast("string"), F.lit(" EUR for shipping. See `$5` and https://example.org/p?a=$7.")).alias("text"))


@query(
    "money_mentions",
    f"""WITH l AS ({_LINES}), m AS (
  SELECT ref_id, 0 AS nth, 'USD' AS currency, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor FROM l
  UNION ALL SELECT ref_id, 1, 'EUR', CAST(l_quantity AS BIGINT) * 100 FROM l)
SELECT ref_id, CAST(nth AS BIGINT) AS nth, currency, amount_minor FROM m""",
)
def money_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.money(_paid(spark, sf_dir)).select("ref_id", "nth", "currency", "amount_minor")


@query("date_mentions", "SELECT 'order:' || o_orderkey AS ref_id, CAST(n AS BIGINT) AS nth, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders, range(3) r(n)")
def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.concat(F.lit("Ordered on "), F.date_format(d, "yyyy-MM-dd"), F.lit(", billed "), F.date_format(d, "MMMM d, yyyy"), F.lit(" and booked "), F.date_format(d, "M/d/yyyy"), F.lit("."))
    return interpret.dates(views.table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("ref_id"), text.alias("text"))).select("ref_id", "nth", F.col("date").cast("string").alias("date"))


@query("url_mentions", "SELECT CAST(page_id AS VARCHAR) AS ref_id, CAST(0 AS BIGINT) AS nth, regexp_replace(url, '[.,;:!?)]+$', '') AS url FROM pages WHERE regexp_matches(url, '^https?://')")
def url_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    return interpret.urls(p.select(F.col("page_id").cast("string").alias("ref_id"), F.concat(F.lit("See "), F.col("url"), F.lit(").")).alias("text")))


#: Texts that take every state of the scan, by the order's number modulo their count; {k} is the number.
_SCANNED = (
    "Cost \\$5 then $x_{k}$ and $$a+{k}",
    "Paid $5 and $6 today, on 2024-03-0{d}.",
    "`${k}` then ```py\nx = $1$\n``` end",
    "See https://e.org/{k}?a=$1$). Or http://x.y/{k}!",
    "\\(a < {k}\\) and \\[b\\] or $12,5$",
    "open ```never closed ${k}$",
    "${k}+1$ `tick and 30 EUR",
    "plain text {k}",
)
#: What is to be found in them: kind and raw of the spans.
_SPANS = (
    (("math", "$x_{k}$"), ("math", "$$a+{k}")),
    (),
    (("inline_code", "`${k}`"), ("fenced_code", "```py\nx = $1$\n```")),
    (("url", "https://e.org/{k}?a=$1$"), ("url", "http://x.y/{k}")),
    (("math", "\\(a < {k}\\)"), ("math", "\\[b\\]"), ("math", "$12,5$")),
    (("fenced_code", "```never closed ${k}$"),),
    (("math", "${k}+1$"),),
    (),
)
#: Reader, number in the text, raw and value of the mentions.
_MENTIONS = (
    (("currency", 0, "$5", "USD 5.00"), ("math", 0, "$x_{k}$", "inline_dollar:x_{k}"), ("math", 1, "$$a+{k}", "display_dollar:a+{k}")),
    (("currency", 0, "$5", "USD 5.00"), ("currency", 1, "$6", "USD 6.00"), ("date", 0, "2024-03-0{d}", "2024-03-0{d}")),
    (("source_code", 0, "${k}", "unknown"), ("source_code", 1, "x = $1$", "python")),
    (("url", 0, "https://e.org/{k}?a=$1$", "https://e.org/{k}?a=$1$"), ("url", 1, "http://x.y/{k}", "http://x.y/{k}")),
    (("math", 0, "\\(a < {k}\\)", "inline_paren:a < {k}"), ("math", 1, "\\[b\\]", "display_bracket:b"), ("math", 2, "$12,5$", "inline_dollar:12,5")),
    (("source_code", 0, "", "never"),),
    (("currency", 0, "30 EUR", "EUR 30.00"), ("math", 0, "${k}+1$", "inline_dollar:{k}+1")),
    (),
)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select("o_orderkey")
    text = F.get(F.array(*map(F.lit, _SCANNED)), (F.col("o_orderkey") % len(_SCANNED)).cast("int"))
    return o.select(F.col("o_orderkey").cast("string").alias("ref_id"), F.replace(F.replace(text, F.lit("{k}"), F.col("o_orderkey").cast("string")), F.lit("{d}"), (F.col("o_orderkey") % 9 + 1).cast("string")).alias("text"))


def _rows_sql(found: tuple) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({n}, {nth}, {', '.join(map(quoted, row))})" for n, rows in enumerate(found) for nth, row in enumerate(rows))


_MADE = "replace(replace({0}, '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{d}}', CAST(o_orderkey % 9 + 1 AS VARCHAR))"


@query("protected_spans", f"SELECT CAST(o_orderkey AS VARCHAR) AS ref_id, CAST(nth AS INTEGER) AS nth, kind, {_MADE.format('raw')} AS raw FROM orders JOIN (VALUES {_rows_sql(_SPANS)}) v(n, nth, kind, raw) ON o_orderkey % {len(_SCANNED)} = n")
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scanned(spark, sf_dir).select("ref_id", F.posexplode(spans.protected(F.col("text"))).alias("nth", "span"))
    return found.select("ref_id", "nth", "span.kind", "span.raw")


@query("evidence_mentions", f"SELECT CAST(o_orderkey AS VARCHAR) AS ref_id, reader, CAST(m AS BIGINT) AS nth, {_MADE.format('raw')} AS raw, {_MADE.format('value')} AS value FROM orders JOIN (VALUES {_rows_sql(_MENTIONS)}) v(n, nth, reader, m, raw, value) ON o_orderkey % {len(_SCANNED)} = n")
def evidence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all readers find in the same texts."""
    return interpret.read(_scanned(spark, sf_dir)).drop("place")


@query("source_code_mentions", "SELECT CAST(p_partkey AS VARCHAR) AS ref_id, CAST(nth AS BIGINT) AS nth, language, replace(body, '{k}', CAST(p_partkey AS VARCHAR)) AS body FROM part, (VALUES (0, 'sql', 'select p_name from part where p_partkey = {k}'), (1, 'python', 'def f(x)')) v(nth, language, body)")
def source_code_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ref_id"), F.concat(F.lit("Run:\n```sql\nselect p_name from part where p_partkey = "), F.col("p_partkey").cast("string"), F.lit("\n```\nthen `def f(x)`.")).alias("text"))
    return interpret.code(p)


_DATED = """d AS (SELECT o_custkey AS c, o_orderkey AS k, epoch_us(o_orderdate) // 86400000000 AS day, floor(o_totalprice) AS price, o_orderpriority = '5-LOW' AS out FROM orders)"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a question about its orders: a day or an amount in each sentence; low priorities are excluded."""
    o = views.table(spark, sf_dir, "orders")
    day, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.floor("o_totalprice").cast("long").cast("string")
    text = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("It was placed on "), day, F.lit("."))).otherwise(F.concat(F.lit("They paid $"), price, F.lit(" for it.")))
    operation = F.when(F.col("o_custkey") % 4 == 0, "difference").when(F.col("o_custkey") % 4 == 3, "sum").when(F.col("o_custkey") % 4 == 2, "sum").otherwise("max_by")
    out = F.when(F.col("o_orderpriority") == "5-LOW", "exclude").otherwise("include")
    by = Window.partitionBy("o_custkey", out).orderBy("o_orderdate", "o_orderkey")
    last = Window.partitionBy("o_custkey", out).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    role = F.when(F.row_number().over(last) == 1, "minuend").when(F.row_number().over(by) == 1, "subtrahend")
    return o.select(F.col("o_custkey").alias("request_id"), operation.alias("operation"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("ref_id"), text.alias("text"), out.alias("label"), role.alias("role"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("entity"))


@query(
    "derived_from_texts",
    f"""WITH {_DATED}
SELECT c AS request_id, CASE c % 4 WHEN 0 THEN 'difference' WHEN 1 THEN 'max_by' ELSE 'sum' END AS operation,
  CASE c % 4 WHEN 0 THEN CASE WHEN count(*) > 1 THEN arg_max(day, (day, k)) - min(day) END WHEN 2 THEN NULL WHEN 1 THEN max(price) ELSE sum(price) END AS number,
  CASE WHEN c % 4 = 1 THEN 'order ' || arg_max(k, (price, k)) END AS answer,
  CASE WHEN c % 4 = 2 OR c % 4 = 0 AND count(*) = 1 THEN 'unknown' ELSE 'derived' END AS status
FROM d WHERE NOT out GROUP BY c""",
)
def derived_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from the amounts and dates in texts; a sum of dates has none."""
    return interpret.derive(interpret.operands(_fragments(spark, sf_dir)))


@query(
    "operand_partition",
    f"""WITH {_DATED}
SELECT c AS request_id, coalesce(string_agg('order:' || k, ',' ORDER BY k) FILTER (NOT out), '') AS included, coalesce(string_agg('order:' || k, ',' ORDER BY k) FILTER (out), '') AS excluded FROM d GROUP BY c""",
)
def operand_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.partitioned(interpret.operands(_fragments(spark, sf_dir))).select("request_id", F.array_join("included", ",").alias("included"), F.array_join("excluded", ",").alias("excluded"))


def _operands(spark: SparkSession, sf_dir: str, operation: str) -> DataFrame:
    """Two lines of an order can have one ord where part keys reach a million; they keep the order of the table."""
    line = views.table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("request_id"), F.lit(operation).alias("operation"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_linenumber") == 1, "minuend").when(F.col("l_linenumber") == 2, "subtrahend").alias("role"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("entity"), F.lit("money:USD").alias("kind"), F.col("l_quantity").alias("value"), views.place(line).alias("place"))


_OPERANDS = "o AS (SELECT 'order:' || l_orderkey AS request_id, l_linenumber AS line, l_linenumber * 1000000 + l_partkey AS ord, 'part:' || l_partkey AS entity, l_quantity AS value FROM lineitem)"


def _derived(name: str, operation: str, number: str, text: str, having: str = "derived"):
    sql = f"WITH {_OPERANDS} SELECT request_id, '{operation}' AS operation, {number} AS number, {text} AS answer, {having} AS status FROM o GROUP BY request_id"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return interpret.derive(_operands(spark, sf_dir, operation)).withColumn("number", F.round("number", 6))

    run.__name__ = name
    return run


_derived("derive_sum", "sum", "round(sum(value), 6)", "CAST(NULL AS VARCHAR)", "'derived'")
_derived("derive_average", "average", "round(avg(value), 6)", "CAST(NULL AS VARCHAR)", "'derived'")
_derived("derive_count", "count", "CAST(count(DISTINCT entity) AS DOUBLE)", "CAST(NULL AS VARCHAR)", "'derived'")
_derived("derive_max_by", "max_by", "max(value)", "arg_max(entity, (value, ord))", "'derived'")
_derived("derive_list", "list", "CAST(NULL AS DOUBLE)", "string_agg(entity, ', ' ORDER BY ord)", "'derived'")
_DIFFERENCE = "CASE WHEN count(*) FILTER (line = 1) > 0 AND count(*) FILTER (line = 2) > 0 THEN max(value) FILTER (line = 1) - max(value) FILTER (line = 2) WHEN count(*) = 2 THEN arg_min(value, ord) - arg_max(value, ord) END"
_derived("derive_difference", "difference", f"round({_DIFFERENCE}, 6)", "CAST(NULL AS VARCHAR)", f"CASE WHEN ({_DIFFERENCE}) IS NULL THEN 'unknown' ELSE 'derived' END")


# Scalar functions.


@query("relation_canonicalise", "SELECT DISTINCT l_returnflag AS raw, CASE l_returnflag WHEN 'R' THEN 'contradicts' WHEN 'A' THEN 'depends_on' ELSE 'records' END AS canonical FROM lineitem")
def relation_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("l_returnflag") == "R", " Conflicts-With ").when(F.col("l_returnflag") == "A", "Depends On").otherwise("RECORDS")
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("raw"), scalars.relation_type(raw).alias("canonical")).distinct()


@query("dimension_identity", "SELECT DISTINCT 'about:user:' || user_id || ':dimension:' || event_type AS scope_id, 'user:' || user_id AS about, event_type AS dimension FROM events")
def dimension_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scope_id")
    return views.entries(spark, sf_dir).select("scope_id", scalars.scope_about(s).alias("about"), scalars.scope_dimension(s).alias("dimension")).distinct()


@query("content_hash", "SELECT c_custkey, sha256(c_name || c_mktsegment) AS content_hash FROM customer")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey", scalars.content_hash(F.col("c_name"), F.col("c_mktsegment")).alias("content_hash"))


@query("answer_normalise", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) AS answer, p_type <> '' AS matches FROM part")
def answer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return views.table(spark, sf_dir, "part").select("p_partkey", scalars.answer(text).alias("answer"), scalars.answers_match(F.concat(F.lit("The "), F.col("p_type")), F.concat(F.col("p_type"), F.lit("."))).alias("matches"))


@query("ref_segments", "SELECT DISTINCT p_type, regexp_replace(substr(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 1, 80), '-+$', '') AS segment FROM part")
def ref_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_type", scalars.segment(F.col("p_type")).alias("segment")).distinct()


# Evaluation.


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), F.col("label").alias("grp"), F.col("embedding").alias("v"))


_TOPK = """
WITH q AS (SELECT vec_id AS query, label AS grp, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id AS ref, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings e ON e.label = q.grp AND e.vec_id <> q.query),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ref) AS place FROM s) WHERE place <= 5)"""


@query("cosine_topk", _TOPK + " SELECT query, place, ref, score FROM top")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    q = v.filter("ref % 50 = 0").select(F.col("ref").alias("query"), "grp", "v")
    return evaluate.candidates(v, q, 5).withColumn("score", F.round("score", 9))


@query(
    "recall_at_k",
    _TOPK + ", gold AS (SELECT query, vec_id AS ref FROM q JOIN embeddings e ON e.label = q.grp AND e.vec_id <> q.query AND e.vec_id % 7 = 0), g AS (SELECT query, count(*) AS gold FROM gold GROUP BY 1), h AS (SELECT t.query, count(*) AS hits FROM top t JOIN gold USING (query, ref) GROUP BY 1) SELECT query, gold, coalesce(hits, 0) AS hits, CASE WHEN hits = gold THEN 'full' WHEN hits > 0 THEN 'partial' ELSE 'missing' END AS outcome FROM g LEFT JOIN h USING (query)",
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    q = v.filter("ref % 50 = 0").select(F.col("ref").alias("query"), "grp", "v")
    gold = q.select("query", "grp").join(v.select("ref", "grp"), "grp").filter("ref <> query AND ref % 7 = 0").select("query", "ref")
    return evaluate.recall(evaluate.candidates(v, q, 5), gold)


@query(
    "scope_validation",
    """WITH a AS (SELECT DISTINCT user_id AS u, event_type AS s FROM events), f AS (SELECT DISTINCT user_id AS u, event_type AS s FROM events WHERE value > 10 UNION SELECT DISTINCT user_id, 'audit' FROM events WHERE user_id % 5 = 0),
j AS (SELECT coalesce(a.u, f.u) AS u, coalesce(a.s, f.s) AS s, a.s IS NULL AS extra, f.s IS NULL AS missing FROM a FULL JOIN f ON a.u = f.u AND a.s = f.s)
SELECT 'user:' || u AS request_id, NOT bool_or(extra OR missing) AS allowed, coalesce(string_agg(s, ',' ORDER BY s) FILTER (missing), '') AS missing, coalesce(string_agg(s, ',' ORDER BY s) FILTER (extra), '') AS extra FROM j GROUP BY u""",
)
def scope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    of = lambda df, s: df.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("request_id"), s.alias("scope"))
    return evaluate.scope_validation(of(e, F.col("event_type")), of(e.filter("value > 10"), F.col("event_type")).union(of(e.filter("user_id % 5 = 0"), F.lit("audit"))))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem")
    return line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).select(F.col("l_orderkey").alias("task"), F.when(F.col("l_orderkey") % 2 == 0, "final").otherwise("every").alias("task_type"), F.col("l_linenumber").alias("step"), (F.col("q") > 20).alias("success"))


_RUNS = "runs AS (SELECT l_orderkey AS task, CASE WHEN l_orderkey % 2 = 0 THEN 'final' ELSE 'every' END AS task_type, l_linenumber AS step, max(l_quantity) > 20 AS success FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("task_scorecard", f"WITH {_RUNS} SELECT task, task_type, count(*) AS subtasks, round(avg(CAST(success AS INTEGER)), 6) AS progress, CASE WHEN task_type = 'final' THEN arg_max(success, step) ELSE bool_and(success) END AS success FROM runs GROUP BY 1, 2")
def task_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.task_scores(_runs(spark, sf_dir), ("final",)).withColumn("progress", F.round("progress", 6))


@query("sr_at_depth", f"WITH {_RUNS} SELECT step, count(*) AS runs, round(avg(CAST(success AS INTEGER)), 6) AS rate FROM runs GROUP BY 1")
def sr_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.at_depth(_runs(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query("failure_classes", "SELECT CASE WHEN l_discount > 0.09 THEN 'temporal_leak' WHEN l_tax < 0.01 THEN 'evidence_not_observed' WHEN l_returnflag = 'N' THEN 'no_answer' WHEN l_quantity < 25 THEN 'wrong_answer' ELSE 'success' END AS class, count(*) AS runs FROM lineitem GROUP BY 1")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluate.failure_class(F.col("l_discount") <= 0.09, F.col("l_tax") >= 0.01, F.col("l_returnflag") != "N", F.col("l_quantity") >= 25)
    return views.table(spark, sf_dir, "lineitem").groupBy(c.alias("class")).agg(F.count("*").alias("runs"))


@query(
    "wilson_ci",
    """WITH s AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS h FROM labels JOIN documents USING (doc_id) GROUP BY 1),
p AS (SELECT lang, n, h / n AS p, 1 + 3.8416 / n AS base, h / n + 3.8416 / (2 * n) AS m, 1.96 * sqrt((h / n) * (1 - h / n) / n + 3.8416 / (4.0 * n * n)) AS w FROM s)
SELECT lang, n, round(p, 6) AS rate, round(greatest(0, (m - w) / base), 6) AS low, round(least(1, (m + w) / base), 6) AS high FROM p""",
)
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    got = joined.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("h"))
    p, low, high = evaluate.wilson(F.col("h"), F.col("n"))
    return got.select("lang", "n", F.round(p, 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("policy_delta", "WITH b AS (SELECT o_orderkey AS s, o_orderstatus = 'F' AS c FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS s, o_totalprice > 100000 AS c FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(a.s, b.s) AS step_id, CASE WHEN a.c IS NULL THEN 'removed' WHEN b.c IS NULL THEN 'added' WHEN a.c AND NOT b.c THEN 'fixed' WHEN NOT a.c AND b.c THEN 'regressed' ELSE 'same' END AS verdict FROM b FULL JOIN a ON a.s = b.s")
def policy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    before = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("step_id"), (F.col("o_orderstatus") == "F").alias("correct"))
    return evaluate.policy_delta(before, o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("step_id"), (F.col("o_totalprice") > 100000).alias("correct")))


@query("duplicate_cap", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 3")
def duplicate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long").cast("string"))
    return evaluate.capped(line, ["l_returnflag", "l_linestatus", "q"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "l_partkey")


@query("train_eval_overlap", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def train_eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return evaluate.overlap(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), ["text"]).select("doc_id")


@query("latency_by_action", "SELECT event_type AS action, count(*) AS calls, round(avg(value), 6) AS mean_ms, max(value) AS most_ms FROM events GROUP BY 1")
def latency_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("value").alias("ms"))
    return evaluate.latency(e).withColumn("mean_ms", F.round("mean_ms", 6))


@query("probe_growth", "SELECT l_linenumber AS step, l_returnflag AS tool, min(l_suppkey) AS least, max(l_suppkey) AS most, CAST(sum(CAST(l_quantity AS BIGINT)) // count(*) AS BIGINT) AS mean_ms, count(*) AS probes FROM lineitem GROUP BY 1, 2")
def probe_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.growth(views.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("tool"), F.col("l_suppkey").alias("refs"), F.col("l_quantity").cast("long").alias("ms")))


@query("seed_variance", "WITH r AS (SELECT l_returnflag AS condition, l_linenumber AS seed, avg(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) AS rate FROM lineitem GROUP BY 1, 2) SELECT condition, round(avg(rate), 9) AS mean, round(var_pop(rate), 9) AS variance, count(*) AS seeds FROM r GROUP BY 1")
def seed_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition"), F.col("l_linenumber").alias("seed"), (F.col("l_quantity") > 20).alias("success"))
    return evaluate.variance(runs).withColumns({c: F.round(c, 9) for c in ("mean", "variance")})


@query("leak_audit", "SELECT doc_id AS ref_id, p AS pattern FROM documents, (VALUES ('(?i)licen[sc]e'), ('AKIA[A-Z0-9]+')) v(p) WHERE regexp_matches(text, p)")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), "text")
    return evaluate.forbidden(d, ["(?i)licen[sc]e", "AKIA[A-Z0-9]+"])


@query("argmax_class", "SELECT user_id AS request_id, arg_max(i, (s, -i)) AS idx FROM (SELECT user_id, CAST(event_id % 6 AS INTEGER) AS i, max(value) AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return evaluate.argmax(e.groupBy(F.col("user_id").alias("request_id"), (F.col("event_id") % 6).cast("int").alias("idx")).agg(F.max("value").alias("score")))
