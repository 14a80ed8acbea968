"""Queries of answers read back: what supports them, how they came about, and what calls may do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.operators import interpret, readers
from mnemograph.sources import views

from .registry import query

# Each order has an answer: its lines are evidence, relations and reasons.
_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
_LINES = f"lines AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)}) AS n, {', '.join(_LINE)} FROM lineitem)"
_LINES_OF = {"source": "CASE WHEN l_linestatus = 'F' THEN 'supplier:' || l_suppkey END", "part": "'part:' || l_partkey", "text": "CASE WHEN l_linenumber = 6 THEN '  ' ELSE ' ' || l_linestatus || l_returnflag END"}
#: Lines of answers that a task gets: a line makes up to three items, with texts.
ANSWER_LINES = 100_000


def _text(x: str) -> Column:
    return F.col(x).cast("string")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, question_ref, question and content, which has been JSON on its way.

    Lines meet by the request, so that what is asked of a request later needs no other shuffle; only their columns are sent.
    """
    request = F.concat(F.lit("order:"), _text("l_orderkey")).alias("request_id")
    lines = views.dealt(views.table(spark, sf_dir, "lineitem").select(request, *_LINE), "request_id", rows=views.table(spark, sf_dir, "lineitem").count(), most=ANSWER_LINES)
    part, flag = F.concat(F.lit("part:"), _text("l_partkey")), F.col("l_returnflag")
    said = F.when(F.col("l_linenumber") == 6, "  ").otherwise(F.concat(F.lit(" "), "l_linestatus", "l_returnflag"))
    source = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("supplier:"), _text("l_suppkey")))
    rel = F.when(flag == "A", F.when(F.col("l_linenumber") % 2 == 0, "supports").otherwise("contributes-to")).when(flag == "R", F.when(F.col("l_linenumber") % 3 == 0, "follows").otherwise("Corrects")).otherwise("records")
    line = F.struct(
        *_LINE,
        F.struct(F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("line:"), _text("l_linenumber"))).alias("id"), said.alias("text"), source.alias("source"), F.when(flag != "N", F.array(F.lit("odd"), part)).alias("supports")).alias("e"),
        F.struct(part.alias("from"), F.col("request_id").alias("to"), rel.alias("rel"), F.when(flag == "N", "structural").otherwise("evidential").alias("class"), F.when(flag == "R", F.col("l_linestatus")).alias("why"), said.alias("evidence"), F.col("l_linenumber").alias("sequence")).alias("p"),
        F.struct(F.col("l_returnflag").alias("claim"), F.when(F.col("l_linestatus") == "O", part).alias("ref"), said.alias("evidence")).alias("b"),
    )
    lines = lines.groupBy("request_id").agg(F.sort_array(F.collect_list(line)).alias("x"))
    json = F.to_json(F.struct(F.struct(F.col("x.e").alias("evidence"), F.col("x.p").alias("path")).alias("proof"), F.col("x.b").alias("because")))
    return lines.select("request_id", F.replace("request_id", F.lit("order:"), F.lit("question:")).alias("question_ref"), F.lit("which?").alias("question"), readers.content(json).alias("content"))


def _placed(found: DataFrame) -> DataFrame:
    return found.select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("ord")).cast("long").alias("place"), "ref_id", "text", "source")


_FRAGMENTS = """, first AS (SELECT o, ref_id, text, min(ord) AS ord, arg_min_null(source, ord) AS source FROM items GROUP BY ALL)
SELECT 'order:' || o AS request_id, row_number() OVER (PARTITION BY o ORDER BY ord) AS place, ref_id, text, source FROM first"""


@query(
    "answer_fragments",
    f"""WITH {_LINES}, items AS (
  SELECT DISTINCT o, 0 AS ord, 'question:' || o AS ref_id, 'which?' AS text, NULL AS source FROM lines
  UNION ALL SELECT o, n, coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN 'line:' || l_linenumber END, {_LINES_OF['source']}, 'proof:evidence'), {_LINES_OF['text']}, {_LINES_OF['source']} FROM lines
  UNION ALL SELECT o, 1000 + n, CASE WHEN l_linestatus = 'O' THEN {_LINES_OF['part']} ELSE 'because:evidence' END, {_LINES_OF['text']}, NULL FROM lines)""" + _FRAGMENTS,
)
def answer_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(readers.fragments(_answers(spark, sf_dir)))


@query(
    "turn_fragments",
    f"""WITH {_LINES}, items AS (
  SELECT DISTINCT o, 0 AS ord, 'question:' || o AS ref_id, 'which?' AS text, NULL AS source FROM lines
  UNION ALL SELECT o, n, CASE WHEN l_returnflag <> 'N' THEN {_LINES_OF['part']} ELSE coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN 'line:' || l_linenumber END, {_LINES_OF['source']}, 'proof:evidence') END, trim({_LINES_OF['text']}), {_LINES_OF['source']} FROM lines WHERE l_linenumber <> 6
  UNION ALL SELECT o, 1000 + n, {_LINES_OF['part']}, trim({_LINES_OF['text']}), NULL FROM lines WHERE l_returnflag = 'A' AND l_linenumber % 2 = 0 AND l_linenumber <> 6
  UNION ALL SELECT o, 2000 + n, {_LINES_OF['part']}, trim({_LINES_OF['text']}), NULL FROM lines WHERE l_linestatus = 'O' AND l_linenumber <> 6)""" + _FRAGMENTS,
)
def turn_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(readers.fragments(_answers(spark, sf_dir), "^part:[0-9]+$"))


@query(
    "evidence_snippets",
    f"""WITH {_LINES}, items AS (
  SELECT o, n AS ord, CASE WHEN l_returnflag <> 'N' THEN {_LINES_OF['part']} WHEN l_linenumber % 3 <> 0 THEN 'line:' || l_linenumber ELSE 'proof:evidence' END AS ref_id, trim({_LINES_OF['text']}) AS text, {_LINES_OF['source']} AS source, NULL AS sequence, 'proof_evidence' AS relation, NULL AS why FROM lines
  UNION ALL SELECT o, 1000 + n, {_LINES_OF['part']}, trim({_LINES_OF['text']}), NULL, l_linenumber, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'supports' ELSE 'contributes-to' END WHEN 'R' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'follows' ELSE 'Corrects' END ELSE 'records' END, CASE WHEN l_returnflag = 'R' THEN l_linestatus END FROM lines
  UNION ALL SELECT o, 2000 + n, CASE WHEN l_linestatus = 'O' THEN {_LINES_OF['part']} ELSE l_returnflag END, trim({_LINES_OF['text']}), NULL, NULL, 'because', l_returnflag FROM lines)
SELECT 'order:' || o AS request_id, ref_id, text, first(source ORDER BY ord) FILTER (source IS NOT NULL) AS source, CAST(coalesce(first(sequence ORDER BY ord) FILTER (sequence IS NOT NULL), 0) AS BIGINT) AS sequence,
  first(relation ORDER BY ord) FILTER (relation IS NOT NULL) AS relation, first(why ORDER BY ord) FILTER (why IS NOT NULL) AS why FROM items WHERE text <> '' GROUP BY o, ref_id, text""",
)
def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.snippets(_answers(spark, sf_dir), "^part:").fillna({"sequence": 0})


@query(
    "relation_summaries",
    f"""WITH {_LINES}, p AS (
  SELECT o, n, l_partkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'supports' ELSE 'contributes-to' END WHEN 'R' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'follows' ELSE 'Corrects' END ELSE 'records' END AS rel,
    CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE trim({_LINES_OF['text']}) END AS why,
    l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS focus FROM lines),
c AS (SELECT *, bool_or(focus) OVER (PARTITION BY o) AS focused FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) AS k FROM c WHERE rel IN ('contributes-to', 'Corrects') AND (focus OR NOT focused)),
l AS (SELECT o, string_agg('- rel=' || rel || ' class=evidential confidence=unknown sequence=' || l_linenumber || ' from=part:' || l_partkey || ' to=order:' || o || ' why=' || why, chr(10) ORDER BY n) AS lines FROM r WHERE k <= 3 GROUP BY o),
t AS (SELECT o, count(*) AS total, count(*) FILTER (rel = 'records') AS structural, count(*) FILTER (rel = 'supports') AS support_only, count(*) FILTER (rel IN ('contributes-to', 'Corrects')) AS rich FROM p GROUP BY o)
SELECT 'order:' || o AS request_id, total, structural, support_only, rich,
  'Graph relation summary: total=' || total || ' structural=' || structural || ' support_only=' || support_only || ' rich_operand_relations=' || rich || '.' || chr(10) ||
  CASE WHEN rich = 0 THEN '{readers._NONE_RICH}' WHEN lines IS NULL THEN '{readers._USE_RICH}' || chr(10) || '{readers._NONE_NEAR}' ELSE '{readers._USE_RICH}' || chr(10) || '{readers._NEAR}' || chr(10) || lines END AS summary
FROM t LEFT JOIN l USING (o)""",
)
def relation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 with a focus on large parts and three lines at most."""
    line = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), _text("l_orderkey")).alias("request_id"), F.col("l_partkey").alias("p_partkey"))
    large = views.table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey")
    focus = line.join(large, "p_partkey").select("request_id", F.concat(F.lit("part:"), _text("p_partkey")).alias("ref_id"))
    return readers.relation_context(_answers(spark, sf_dir), focus, 3)


@query(
    "prompt_order",
    f"""WITH {_LINES}, t AS (
  SELECT o, n, CASE o % 4 WHEN 0 THEN 'How many dollars did I spend?' WHEN 1 THEN 'What is the AMOUNT?' WHEN 2 THEN 'Where are my keys?' ELSE 'Who?' END AS q,
    CASE l_returnflag WHEN 'A' THEN 'it took $ and luck' WHEN 'R' THEN 'it COST ' || l_quantity::INT || ' in all' ELSE CASE WHEN l_linestatus = 'O' THEN 'no' ELSE 'day ' || l_linenumber END END AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'User' ELSE 'assistant' END AS r FROM lines),
p AS (SELECT *, 20 * regexp_matches(s, '[0-9]')::INT + 20 * (contains(s, '$') OR contains(lower(s), ' cost '))::INT
  + 40 * (o % 4 IN (0, 1) AND (contains(s, '$') OR contains(lower(s), 'cost')))::INT + 50 * (o % 4 IN (0, 2) AND r = 'User')::INT + 10 * (o % 4 = 0 AND regexp_matches(s, '[0-9]'))::INT AS priority FROM t)
SELECT 'order:' || o AS request_id, n AS rank, priority, row_number() OVER (PARTITION BY o ORDER BY priority DESC, n) AS place FROM p""",
)
def prompt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)).cast("long")
    kind = F.col("l_orderkey") % 4
    question = F.when(kind == 0, "How many dollars did I spend?").when(kind == 1, "What is the AMOUNT?").when(kind == 2, "Where are my keys?").otherwise("Who?")
    flag = F.col("l_returnflag")
    text = F.when(flag == "A", "it took $ and luck").when(flag == "R", F.concat(F.lit("it COST "), F.col("l_quantity").cast("int").cast("string"), F.lit(" in all"))).otherwise(F.when(F.col("l_linestatus") == "O", "no").otherwise(F.concat(F.lit("day "), _text("l_linenumber"))))
    turns = line.select(F.concat(F.lit("order:"), _text("l_orderkey")).alias("request_id"), n.alias("rank"), question.alias("question"), text.alias("text"), F.when(F.col("l_linenumber") % 2 == 0, "User").otherwise("assistant").alias("role"))
    return readers.prompt_order(turns).select("request_id", "rank", "priority", "place")


@query(
    "exact_answers",
    f"""WITH {_LINES}, k AS (SELECT o, n, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS kind, l_partkey % 50 AS v FROM lines),
f AS (
  SELECT o, list_reduce(list({{'kind': kind, 'v': v, 'waits': false, 'out': []::VARCHAR[]}} ORDER BY n), lambda s, x: CASE
    WHEN x.kind = 3 THEN s
    WHEN s.waits THEN {{'kind': 9, 'v': x.v, 'waits': false, 'out': list_append(s.out, CASE x.kind WHEN 0 THEN 'Exact answer:' WHEN 1 THEN 'the exact ANSWER: ' || x.v ELSE 'line ' || x.v END)}}
    WHEN x.kind = 0 THEN {{'kind': 9, 'v': x.v, 'waits': true, 'out': s.out}}
    WHEN x.kind = 1 THEN {{'kind': 9, 'v': x.v, 'waits': false, 'out': list_append(s.out, x.v::VARCHAR)}}
    ELSE s END, {{'kind': 9, 'v': 0::BIGINT, 'waits': false, 'out': []::VARCHAR[]}}).out AS out FROM k GROUP BY o),
u AS (SELECT o, unnest(out) AS answer, generate_subscripts(out, 1) AS i FROM f),
d AS (SELECT o, answer, min(i) AS i FROM u GROUP BY ALL)
SELECT o AS id, row_number() OVER (PARTITION BY o ORDER BY i) AS place, answer FROM d""",
)
def exact_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 over a text for each order: bare labels, labelled values, other lines and blank ones."""
    flag, value = F.col("l_returnflag"), (F.col("l_partkey") % 50).cast("string")
    said = F.when(flag == "R", "* **Exact answer:**").when(flag == "A", F.concat(F.lit("- the exact ANSWER: `"), value, F.lit("`."))).when(F.col("l_linestatus") == "O", F.concat(F.lit("line "), value)).otherwise("  ")
    lines = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*_LINE, said.alias("said")))).alias("x"))
    return readers.exact_answers(lines.select("id", F.array_join(F.transform("x", lambda x: x["said"]), "\n").alias("text")))


@query(
    "labelled_answers",
    f"""WITH {_LINES}, s AS (
  SELECT o, o % 7 AS op, n, l_returnflag <> 'R' AS inc, (o // 7) % 2 = 0 AS dist, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS v, CASE WHEN l_linenumber < 6 THEN 'part ' || l_partkey % 3 END AS e,
    CASE n WHEN 1 THEN 'minuend' WHEN 2 THEN 'subtrahend' END AS role FROM lines),
c AS (SELECT *, coalesce(v, 1) AS w, row_number() OVER (PARTITION BY o, e, inc AND dist AND coalesce(v, 1) = 1 AND e IS NOT NULL ORDER BY n) AS again FROM s),
k AS (SELECT *, inc AND NOT (dist AND w = 1 AND e IS NOT NULL AND again > 1) AS counted FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY o, e, counted AND e IS NOT NULL ORDER BY n) AS nth FROM k),
g AS (
  SELECT o, any_value(op) AS op, count(*) FILTER (inc) AS included, count(*) FILTER (NOT inc) AS excluded, count(*) FILTER (inc AND v IS NULL) AS blank, sum(v) FILTER (inc) AS total, coalesce(sum(w) FILTER (counted), 0) AS cnt,
    count(*) FILTER (inc AND role = 'minuend') AS a, count(*) FILTER (inc AND role = 'subtrahend') AS b, sum(v) FILTER (inc AND role = 'minuend') - sum(v) FILTER (inc AND role = 'subtrahend') AS gap,
    count(*) FILTER (inc AND v IS NOT NULL) AS valued, arg_max_null(e, {{'v': v, 'n': n}}) FILTER (inc AND v IS NOT NULL) AS top, max(v) FILTER (inc) AS most,
    count(*) FILTER (counted AND e IS NOT NULL AND nth = 1) AS names, string_agg(e, ', ' ORDER BY n) FILTER (counted AND e IS NOT NULL AND nth = 1) AS name_list, string_agg(e, ', ' ORDER BY n) FILTER (inc AND e IS NOT NULL) AS list FROM m GROUP BY o),
r AS (SELECT *, CASE WHEN op IN (0, 1) AND included = 0 THEN 'no included operand' WHEN op IN (0, 1) AND blank > 0 THEN 'an included operand has no value' WHEN op IN (2, 3) AND (a <> 1 OR b <> 1) THEN 'not one minuend and one subtrahend'
    WHEN op IN (2, 3) AND gap IS NULL THEN 'an included operand has no value' WHEN op = 4 AND valued = 0 THEN 'no included operand has a value' WHEN op = 4 AND top IS NULL THEN 'the largest has no name' WHEN op = 5 AND list IS NULL THEN 'no included operand has a name' END AS error FROM g),
x AS (SELECT *, CASE WHEN error IS NULL THEN CASE op WHEN 0 THEN total WHEN 1 THEN total / included WHEN 2 THEN abs(gap) WHEN 3 THEN gap WHEN 4 THEN most WHEN 6 THEN cnt END END AS number FROM r),
y AS (SELECT *, CASE WHEN abs(round(number) - number) < 1e-6 THEN CAST(CAST(round(number) AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.4f', number), '0+$', ''), '\\.$', '') END AS said FROM x)
SELECT 'order:' || o AS request_id, ['sum', 'average', 'difference', 'difference', 'max_by', 'list', 'count'][op + 1] AS operation,
  CASE WHEN error IS NULL THEN CASE op WHEN 0 THEN '$' || said WHEN 1 THEN said || ' kg' WHEN 2 THEN said || ' days' WHEN 3 THEN said WHEN 4 THEN top WHEN 5 THEN list ELSE CASE WHEN names BETWEEN 2 AND 12 THEN said || ': ' || name_list ELSE said END END END AS answer, number, included, excluded, error FROM y""",
)
def labelled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation over the lines of orders, some without a value or a name, returned ones excluded."""
    line = views.table(spark, sf_dir, "lineitem")
    request = F.concat(F.lit("order:"), _text("l_orderkey")).alias("request_id")
    op, distinct = F.col("l_orderkey") % 7, F.floor(F.col("l_orderkey") / 7) % 2 == 0
    name = F.get(F.array(*(F.lit(x) for x in ("sum", "average", "difference", "difference", "max-by", "list", " Count "))), op.cast("int"))
    unit = F.get(F.array(*(F.lit(x) for x in ("USD", "kg", "days", "none", "USD", "USD"))), op.cast("int"))
    question = F.concat(F.when(op == 2, "How long").otherwise("How much"), F.when(distinct, " for different parts?").otherwise("?"))
    dealt = views.dealt(line.select("l_orderkey", *_LINE), "l_orderkey", most=ANSWER_LINES)
    questions = dealt.select("l_orderkey").distinct().select(request, question.alias("question"), name.alias("operation"), unit.alias("unit"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)).cast("long")
    entity = F.when(F.col("l_linenumber") < 6, F.concat(F.lit("part "), (F.col("l_partkey") % 3).cast("string")))
    rows = dealt.withColumn("n", n).select(request, F.col("n").alias("ord"), F.lit("line").alias("ref_id"), F.when(F.col("l_returnflag") == "R", "exclude").otherwise("include").alias("label"), F.when(F.col("n") == 1, " Minuend").when(F.col("n") == 2, "subtrahend").alias("role"), entity.alias("entity"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("value"))
    return readers.labelled_answers(questions, rows)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, tool and arguments: a call for each event, some beyond the limits."""
    e = views.table(spark, sf_dir, "events")
    size, odd, kind = F.col("event_id") % 90, F.col("user_id") % 3 == 0, F.col("event_type")
    limit = F.struct(size.alias("entries"), (size * 200).alias("tokens"))
    cursor = F.struct(F.when(odd, "event:1").alias("ref"), F.when(~odd | (size == 7), size).alias("sequence"))
    near = F.to_json(F.struct(cursor.alias("around"), limit.alias("limit"), F.struct((size % 9).alias("before_entries")).alias("window"), F.struct(F.when(odd, "only").otherwise("all").alias("mode"), F.lit("abouts").alias("scope")).alias("dimensions")))
    trace = F.to_json(F.struct(F.lit("a").alias("from"), F.when(size > 3, "b").alias("to"), F.struct((size * 200).alias("tokens")).alias("budget"), F.struct((size * 4).alias("entries"), F.when(odd, "c").alias("cursor")).alias("page")))
    inspect = F.to_json(F.struct(F.lit("x").alias("ref"), F.struct(F.when(size > 3, odd).alias("raw")).alias("include")))
    call = F.when(kind == "click", F.struct(F.lit("kernel_near").alias("tool"), near.alias("arguments"))).when(kind == "view", F.struct(F.lit("kernel_trace").alias("tool"), trace.alias("arguments"))).otherwise(F.struct(F.lit("kernel_inspect").alias("tool"), inspect.alias("arguments")))
    return e.select("event_id", call["tool"].alias("tool"), call["arguments"].alias("arguments"))


@query(
    "bounded_calls",
    """WITH e AS (SELECT event_id, event_type AS k, event_id % 90 AS s, user_id % 3 = 0 AS odd FROM events)
SELECT event_id, CASE k WHEN 'click' THEN s BETWEEN 1 AND 64 AND s * 200 <= 16000 AND (odd AND s <> 7 OR NOT odd) WHEN 'view' THEN s > 3 AND s BETWEEN 1 AND 80 AND s * 4 <= 256 ELSE s > 3 AND NOT odd END AS bounded FROM e""",
)
def bounded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("event_id", readers.bounded_call(F.col("tool"), F.col("arguments")).alias("bounded"))


@query(
    "capability_coverage",
    """WITH e AS (SELECT event_type AS k, event_id % 90 AS s, user_id % 3 = 0 AS odd FROM events),
seen AS (
  SELECT 'tool:kernel_' || CASE k WHEN 'click' THEN 'near' WHEN 'view' THEN 'trace' ELSE 'inspect' END AS capability FROM e
  UNION SELECT CASE WHEN odd THEN 'cursor:ref' ELSE 'cursor:sequence' END FROM e WHERE k = 'click'
  UNION SELECT CASE WHEN odd THEN 'dimensions.mode:only' ELSE 'dimensions.mode:all' END FROM e WHERE k = 'click'
  UNION SELECT 'dimensions.scope:abouts' FROM e WHERE k = 'click'
  UNION SELECT CASE WHEN odd THEN 'trace.page:continue' ELSE 'trace.page:first' END FROM e WHERE k = 'view'
  UNION SELECT 'window:expand' FROM e WHERE k = 'click' AND (s % 9 > 6 OR s > 12)
  UNION SELECT 'window:shrink' FROM e WHERE k = 'click' AND (s % 9 < 6 OR s < 12)
  UNION SELECT 'inspect.raw:false' FROM e WHERE k NOT IN ('click', 'view') AND s > 3 AND NOT odd),
required AS (""" + " UNION ALL ".join(f"SELECT '{g}' AS grp, unnest({list(c)}) AS capability" for g, c in readers.CAPABILITIES.items()) + """),
j AS (SELECT grp, capability, capability IN (SELECT capability FROM seen) AS hit FROM required)
SELECT grp, count(*) FILTER (hit) AS covered, count(*) AS total, count(*) FILTER (hit) * 100.0::DOUBLE / count(*) AS percent, coalesce(string_agg(capability, ',' ORDER BY capability) FILTER (NOT hit), '') AS missing FROM j GROUP BY ROLLUP (grp)""",
)
def capability_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    action = F.concat(F.lit('{"type":"tool_call","tool":"'), "tool", F.lit('","arguments":'), "arguments", F.lit("}"))
    required = spark.createDataFrame([(g, c) for g, cs in readers.CAPABILITIES.items() for c in cs], "grp string, capability string")
    return readers.coverage(required, readers.observed_capabilities(calls.select(action.alias("action")))).withColumn("missing", F.array_join("missing", ","))


@query(
    "memory_properties",
    """WITH e AS (SELECT event_id, event_id % 5 AS k, event_type AS t FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'type=' || t WHEN 1 THEN 'other=' || t ELSE '' END AS metadata, CASE k WHEN 0 THEN t WHEN 1 THEN 'late' END AS source FROM e""",
)
def memory_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by both names, with a number in it, cut off or missing; sources that are there, late, blank or missing."""
    e = views.table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 5)
    pair = lambda name: F.concat(F.lit(f'{{"{name}":"'), "event_type", F.lit('"}'))
    k = F.col("k")
    properties = F.map_filter(
        F.create_map(
            F.lit("metadata"), F.when(k == 0, pair("type")).when(k == 1, pair("old")).when(k == 2, F.col("props")).when(k == 3, F.substring(pair("cut"), 1, 6)),
            F.lit("payload_metadata"), F.when(k == 1, pair("other")),
            F.lit("source"), F.when(k == 0, F.col("event_type")).when(k == 2, F.lit(" ")),
            F.lit("payload_source"), F.when(k < 3, F.lit("late")),
        ),
        lambda name, value: value.isNotNull(),
    )
    text = F.array_join(F.transform(F.map_entries(readers.memory_metadata(properties)), lambda m: F.concat_ws("=", m["key"], m["value"])), ",")
    return e.select("event_id", text.alias("metadata"), readers.memory_source(properties).alias("source"))


@query(
    "reconstruction_scores",
    """SELECT o_orderkey, (CAST(o_orderstatus <> 'P' AS INT) + CAST(o_totalprice > 100000 AS INT) + CAST(c_custkey IS NOT NULL AS INT)) / 3 AS explanation, CAST(coalesce(c_mktsegment = 'BUILDING', false) AS INT) / 1 AS detail
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20""",
)
def reconstruction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what an order should say is there, for orders whose customer may be out of reach."""
    c = views.table(spark, sf_dir, "customer").filter("c_nationkey < 20").select("c_custkey", "c_mktsegment")
    cases = views.table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    checks = {"explanation": [F.col("o_orderstatus") != "P", F.col("o_totalprice") > 100000, F.col("c_custkey").isNotNull()], "detail": [F.col("c_mktsegment") == "BUILDING"]}
    return readers.check_scores(cases, checks).select("o_orderkey", "explanation", "detail")


@query(
    "question_derivations",
    f"""WITH {_LINES.replace('l_quantity FROM', 'l_quantity, l_shipdate FROM').replace('l_quantity) AS n', 'l_quantity, l_shipdate) AS n')},
g AS (
  SELECT o, count(*) AS n, sum(l_quantity) AS total, first(l_quantity ORDER BY n) - last(l_quantity ORDER BY n) AS gap, max(l_quantity) AS most, max(l_shipdate)::DATE AS late, min(l_shipdate)::DATE AS early FROM lines GROUP BY o),
a AS (
  SELECT o, n, 'currency' AS reader, CASE o % 5 WHEN 0 THEN 'sum' WHEN 1 THEN 'difference' WHEN 2 THEN 'max_by' WHEN 3 THEN 'sum' END AS operation,
    CASE o % 5 WHEN 0 THEN total WHEN 1 THEN CASE WHEN n = 2 THEN gap END WHEN 2 THEN most WHEN 3 THEN total END AS number, CASE WHEN o % 5 = 2 THEN '$' || most::INT END AS answer FROM g
  UNION ALL SELECT o, n, 'date', CASE o % 5 WHEN 1 THEN 'difference' WHEN 3 THEN 'max_by' END, CASE o % 5 WHEN 1 THEN late - early WHEN 3 THEN late - DATE '1970-01-01' END, CASE WHEN o % 5 = 3 THEN late::VARCHAR END FROM g)
SELECT 'order:' || o AS request_id, reader, operation, CASE WHEN operation IS NULL THEN 0 ELSE n END AS operands, CASE WHEN n >= 2 THEN number END AS number, CASE WHEN n >= 2 THEN answer END AS answer,
  CASE WHEN operation IS NULL THEN 'not asked' WHEN n < 2 THEN 'too few operands' WHEN number IS NULL THEN 'unknown' ELSE 'derived' END AS status FROM a""",
)
def question_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: five questions over the amounts and dates that an order's lines tell."""
    line = views.table(spark, sf_dir, "lineitem")
    o, request = F.col("l_orderkey") % 5, F.concat(F.lit("order:"), _text("l_orderkey")).alias("request_id")
    asked = ("How much was SPENT in total?", "How long was it, and what is the difference?", "Which was the most expensive?", "What is the latest budget?", "Who?")
    questions = line.select("l_orderkey").distinct().select(request, F.get(F.array(*(F.lit(q) for q in asked)), o.cast("int")).alias("question"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE, "l_shipdate"))
    text = F.concat(F.lit("paid $"), F.col("l_quantity").cast("int").cast("string"), F.lit(" on "), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return interpret.answers_of(questions, line.select(request, n.alias("ord"), text.alias("text")))
