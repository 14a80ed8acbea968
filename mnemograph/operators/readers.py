"""What readers are given and what they answer: fragments, snippets and relations of answers, prompts, answers by label, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from mnemograph.functions import scalars
from mnemograph.operators import leaves
from mnemograph.operators.ingest import _struct
from mnemograph.sources import views

#: The content of an answer: what supports it (proof.evidence), the relations it came by (proof.path) and its reasons (because).
CONTENT = _struct(
    proof=_struct(evidence=T.ArrayType(_struct("id", "text", "source", supports=T.ArrayType(T.StringType()))), path=T.ArrayType(_struct("from", "to", "rel", "class", "why", "evidence", "confidence", sequence=T.LongType()))),
    because=T.ArrayType(_struct("claim", "ref", "evidence")),
)
_ITEM = T.ArrayType(_struct("ref_id", "text", "source", "relation", "why", sequence=T.LongType()))
_WHITE = r"^\s+|\s+$"


#: Ends of a line that are no white space to a pattern; white space before one at a text's end goes too.
_ENDS = ("\x85", "\u2028", "\u2029")


def _trimmed(x: Column) -> Column:
    """x without white space at its ends, by the pattern only where that does more than a plain trim."""
    odd = x.endswith(_ENDS[0]) | x.endswith(_ENDS[1]) | x.endswith(_ENDS[2])
    return F.when(odd, F.regexp_replace(x, _WHITE, "")).otherwise(F.trim(x, F.lit(" \t\n\x0b\f\r")))


def _item(ref: Column, text: Column, source: Column | None = None, sequence: Column | None = None, relation: Column | None = None, why: Column | None = None) -> Column:
    parts = {"ref_id": ref, "text": text, "source": source, "sequence": sequence, "relation": relation, "why": why}
    return F.struct(*((F.lit(None) if parts[f.name] is None else parts[f.name]).cast(f.dataType).alias(f.name) for f in _ITEM.elementType.fields))


def _listed(*lists: Column) -> Column:
    """The lists behind each other; a null list is empty."""
    return F.concat(*(F.coalesce(x.cast(_ITEM), F.array().cast(_ITEM)) for x in lists))


def content(text: Column) -> Column:
    """The content of an answer in JSON; null for what is no JSON."""
    return F.from_json(text, CONTENT)


def fragments(answers: DataFrame, turn: str | None = None) -> DataFrame:
    """K6: request_id, ord, ref_id, text and source of the distinct fragments (by ref and text) of each answer, in the order
    of their first occurrence; the source is the first one's.

    answers: request_id, question_ref, question, content (CONTENT). The question is the first fragment; evidence follows,
    then reasons. Without `turn` evidence goes by its id, its source or a name for all, reasons by their ref or another
    name. With `turn`, a pattern of the references of turns, evidence goes by every turn that it supports, and by its id
    only if it supports none; relations that support an answer add the evidence of the turns they come from, and reasons
    that name no turn are left out; texts are trimmed, blank ones left out.
    """
    evidence, path, because = F.col("content.proof.evidence"), F.col("content.proof.path"), F.col("content.because")
    asked = F.array(_item(F.col("question_ref"), F.col("question")))
    named = lambda e: F.coalesce(e["id"], e["source"], F.lit("proof:evidence"))
    if turn is None:
        said = F.transform(evidence, lambda e: _item(named(e), e["text"], e["source"]))
        paths = F.array().cast(_ITEM)
        reasons = F.transform(because, lambda r: _item(F.coalesce(r["ref"], F.lit("because:evidence")), r["evidence"]))
    else:
        is_turn = lambda x: F.coalesce(x.rlike(turn), F.lit(False))
        turns = lambda e: F.filter(F.coalesce(e["supports"], F.array().cast("array<string>")), is_turn)
        said = F.flatten(F.transform(evidence, lambda e: F.transform(F.when(F.size(turns(e)) > 0, turns(e)).otherwise(F.array(named(e))), lambda ref: _item(ref, _trimmed(e["text"]), e["source"]))))
        support = F.filter(path, lambda p: p["rel"].isin("supports", "supports_answer") & is_turn(p["from"]))
        paths = F.transform(support, lambda p: _item(p["from"], _trimmed(p["evidence"])))
        reasons = F.transform(F.filter(because, lambda r: is_turn(r["ref"])), lambda r: _item(r["ref"], _trimmed(r["evidence"])))
    found = F.filter(_listed(said, paths, reasons), lambda i: i["text"].isNotNull() & ((i["text"] != "") | F.lit(turn is None)))
    every = answers.select("request_id", F.posexplode(F.concat(asked, found)).alias("ord", "item"))
    first = every.groupBy("request_id", F.col("item.ref_id").alias("ref_id"), F.col("item.text").alias("text")).agg(F.min("ord").cast("long").alias("ord"), F.min_by("item.source", "ord").alias("source"))
    return first.select("request_id", "ord", "ref_id", "text", "source")


def snippets(answers: DataFrame, known: str = ".") -> DataFrame:
    """K7: request_id, ref_id, text, source, sequence, relation and why of the distinct snippets (by ref and text) of each
    answer (request_id, content): its evidence, then the evidence of its path, then its reasons. Of equal snippets each
    column has the first value that is not null.

    known: a pattern of references that may stand for a text. Evidence goes by the first such it supports, or its id; a
    relation by its source or its target if they are such. Texts are trimmed, blank ones left out.
    """
    real = lambda x: F.coalesce(x.rlike(known) & ~x.contains(" ") & (F.octet_length(x) <= 400), F.lit(False))
    said = F.transform("content.proof.evidence", lambda e: _item(F.coalesce(F.get(F.filter(e["supports"], real), F.lit(0)), e["id"], F.lit("proof:evidence")), _trimmed(e["text"]), e["source"], relation=F.lit("proof_evidence")))
    paths = F.transform("content.proof.path", lambda p: _item(F.when(real(p["from"]), p["from"]).when(real(p["to"]), p["to"]).otherwise("proof:path"), _trimmed(p["evidence"]), sequence=F.when(p["sequence"] >= 0, p["sequence"]), relation=p["rel"], why=p["why"]))
    reasons = F.transform("content.because", lambda r: _item(F.coalesce(r["ref"], r["claim"], F.lit("because:evidence")), _trimmed(r["evidence"]), relation=F.lit("because"), why=r["claim"]))
    every = answers.select("request_id", F.posexplode(F.filter(_listed(said, paths, reasons), lambda i: i["text"] != "")).alias("ord", "item"))
    first = lambda c: F.min_by(f"item.{c}", F.when(F.col(f"item.{c}").isNotNull(), F.col("ord"))).alias(c)
    return every.groupBy("request_id", F.col("item.ref_id").alias("ref_id"), F.col("item.text").alias("text")).agg(*(first(c) for c in ("source", "sequence", "relation", "why")))


#: Relation types that hold a graph together, that only support, and that say how a value enters an answer.
STRUCTURAL = ("contains", "contains_entry", "has_dimension", "has_evidence", "member_of", "records", "scoped_to")
SUPPORT = ("supports", "supports_answer")
OPERAND = ("contributes_to", "excluded_from", "checked_against", "derived_from", "restates", "corrects", "component_of", "total_of", "same_event_as", "same_entity_as", "qualifies_as", "matches_requirement")
#: What a summary of relations says.
_NONE_RICH = "No rich operand relations are present. Treat the graph as retrieval/provenance only for duplicate, total, correction, and operand-inclusion decisions."
_USE_RICH = "Use rich operand relations to decide inclusion, exclusion, duplicate/restatement, correction, component/total, and question-item matching before computing."
_NONE_NEAR = "Rich relations exist, but none directly touch the retrieved/plugin evidence refs in this prompt."
_NEAR = "Rich relation signals touching retrieved/plugin refs:"


def relation_family(rel: Column, semantic_class: Column) -> Column:
    """K8: structural, support, operand or other; a structural class goes before the type."""
    name = scalars.relation_type(rel)
    return F.when((F.trim(semantic_class) == "structural") | name.isin(*STRUCTURAL), "structural").when(name.isin(*SUPPORT), "support").when(name.isin(*OPERAND), "operand").otherwise("other")


def _signal(r: Column) -> Column:
    """A line of a summary."""
    known = lambda c: F.coalesce(r[c].cast("string"), F.lit("unknown"))
    short = lambda x, n: scalars.truncated(_trimmed(F.regexp_replace(x, r"\s+", " ")), n)
    sequence = F.coalesce(F.when(r["sequence"] >= 0, r["sequence"]).cast("string"), F.lit("unknown"))
    why = F.coalesce(r["why"], r["evidence"], F.lit(""))
    parts = {"- rel=": known("rel"), " class=": known("class"), " confidence=": known("confidence"), " sequence=": sequence, " from=": short(known("from"), 180), " to=": short(known("to"), 180), " why=": short(why, 320)}
    return F.concat(*(x for name, value in parts.items() for x in (F.lit(name), value)))


def relation_context(answers: DataFrame, focus: DataFrame, most: int = 40) -> DataFrame:
    """K8: request_id, total, structural, support_only, rich and summary of the relations on each answer's path.

    focus: request_id, ref_id of what a prompt shows. The summary lists the first `most` operand relations, in the order
    of the path, that have a focus at one end; all do where a request has none. An answer without a path has null counts
    and no summary, as has one whose content is null. Answer and focus of a request meet in one row, by one join.
    """
    refs = focus.groupBy("request_id").agg(F.collect_set("ref_id").alias("refs"))
    rows = answers.select("request_id", F.col("content.proof.path").alias("path")).join(refs, "request_id", "left")
    text = lambda x: F.coalesce(x, F.lit(""))
    family = F.transform("path", lambda r: F.struct(r.alias("r"), relation_family(text(r["rel"]), text(r["class"])).alias("family")))
    rows = rows.select("request_id", "refs", family.alias("path"))
    count = lambda name: F.size(F.filter("path", lambda x: x["family"] == name))
    held = lambda x: F.coalesce(F.array_contains("refs", x), F.lit(False))
    near = F.filter("path", lambda x: (x["family"] == "operand") & (F.col("refs").isNull() | held(x["r"]["from"]) | held(x["r"]["to"])))
    lines = F.array_join(F.transform(F.slice(near, 1, most), lambda x: _signal(x["r"])), "\n")
    has = F.col("path").isNotNull()
    counts = {"total": F.size("path"), "structural": count("structural"), "support_only": count("support"), "rich": count("operand")}
    rows = rows.select("request_id", *(F.when(has, c.cast("long")).alias(n) for n, c in counts.items()), F.when(has, lines).alias("lines"))
    head = F.concat(F.lit("Graph relation summary: total="), F.col("total").cast("string"), F.lit(" structural="), F.col("structural").cast("string"), F.lit(" support_only="), F.col("support_only").cast("string"), F.lit(" rich_operand_relations="), F.col("rich").cast("string"), F.lit(".\n"))
    tail = F.when(F.col("rich") == 0, _NONE_RICH).when(F.col("lines") == "", f"{_USE_RICH}\n{_NONE_NEAR}").otherwise(F.concat(F.lit(f"{_USE_RICH}\n{_NEAR}\n"), "lines"))
    return rows.select("request_id", *counts, F.concat(head, tail).alias("summary"))


#: Words of questions about money, of texts about it, and of questions about one's own past.
_MONEY_ASKED = ("money", "spent", "spend", "expense", "cost", "amount", "raise")
_MONEY_SAID = ("$", " dollar", " cost ", " spent ")
_MONEY_NAMED = ("$", "dollar", "cost")
_OWN = (" i ", " me ", " my ")


def prompt_priority(question: Column, text: Column, role: Column) -> Column:
    """How early a turn is put in a prompt, more first: digits, money, and a user's own words for a question about them."""
    q, t = F.lower(question), F.lower(text)
    holds = lambda x, words: F.greatest(*(F.contains(x, F.lit(w)) for w in words))
    digit = t.rlike("[0-9]")
    own = holds(q, _OWN) | q.startswith("how many") | q.startswith("how much")
    parts = ((digit, 20), (holds(t, _MONEY_SAID), 20), (holds(q, _MONEY_ASKED) & holds(t, _MONEY_NAMED), 40), (own & (F.lower(role) == "user"), 50), (F.contains(q, F.lit("how many")) & digit, 10))
    total = F.lit(0)
    for rule, points in parts:
        total = total + F.when(rule, points).otherwise(0)
    return total


def prompt_order(turns: DataFrame) -> DataFrame:
    """Turns (request_id, rank, question, text, role) with priority and place: by priority, then rank."""
    w = Window.partitionBy("request_id").orderBy(F.desc("priority"), "rank")
    return turns.withColumn("priority", prompt_priority(F.col("question"), F.col("text"), F.col("role"))).withColumn("place", F.row_number().over(w).cast("long"))


def exact_answers(texts: DataFrame) -> DataFrame:
    """Id, place and answer of the distinct answers behind `Exact answer:` in texts (id, text), in order.

    A line counts without list marks, stars and backticks; a label with nothing behind it takes the next line that is not
    blank, whatever that holds. So in a stretch of lines of bare labels every second one is an answer, and so is the
    first line behind a stretch of an odd number. Ids are each a text's own.
    """
    label = "exact answer:"
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    bare = _trimmed(F.regexp_replace(F.regexp_replace(_trimmed(F.col("line")), "^[-* ]+", ""), "[*`]", ""))
    lines = lines.select("id", "n", bare.alias("line")).filter("line <> ''")
    at = F.locate(label, F.translate("line", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    behind = F.when(at > 0, _trimmed(F.substring(F.col("line"), at + len(label), F.lit(2**30))))
    whole = Window.partitionBy("id").orderBy("n")
    steps = lines.withColumns({"behind": behind, "i": F.row_number().over(whole)}).withColumn("empty", F.coalesce(F.col("behind") == "", F.lit(False)))
    steps = steps.withColumn("start", F.coalesce(F.max(F.when(~F.col("empty"), F.col("i"))).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = (F.col("i") - F.col("start") - 1) % 2 == 1  # bare labels from the last other line on: one waits, the next is taken
    said = F.when(taken, F.col("line")).otherwise(F.nullif("behind", F.lit("")))
    answers = steps.select("id", "i", leaves.trimmed_answer(said).alias("answer")).filter("answer <> ''")
    once = answers.groupBy("id", "answer").agg(F.min("i").alias("i"))
    return once.select("id", F.row_number().over(Window.partitionBy("id").orderBy("i")).cast("long").alias("place"), "answer")


#: Words that ask for different things, words of a name that do not tell things apart, and units of time.
_DISTINCT = "different|distinct|unique|types? of|kinds? of"
_LIGHT = ("a", "an", "the", "new", "old")
_TIME = ("day", "days", "week", "weeks", "month", "months", "hour", "hours")
_LONG = "how long|how many (days|weeks|months|hours)"
_OPERATIONS = ("sum", "count", "average", "difference", "max_by", "list", "unknown")
_LABELS = ("include", "exclude", "context")


def entity_key(entity: Column) -> Column:
    """A name for comparison, without articles, new and old."""
    return F.array_join(F.filter(F.split(scalars.answer(entity), " "), lambda w: ~w.isin(*_LIGHT)), " ")


def number_text(value: Column, unit: Column) -> Column:
    """A number with up to four places and its unit; dollars go before it."""
    places = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), "0+$", ""), r"\.$", "")
    text = F.when(F.abs(F.round(value) - value) < 1e-6, F.round(value).cast("long").cast("string")).otherwise(places)
    u = F.coalesce(_trimmed(unit), F.lit(""))
    return F.when(u.isin("USD", "$", "dollars"), F.concat(F.lit("$"), text)).when(u.isin("", "none", "unknown"), text).otherwise(F.concat_ws(" ", text, u))


#: Operands that a task gets.
OPERANDS = 100_000


def labelled_answers(questions: DataFrame, operands: DataFrame) -> DataFrame:
    """request_id, operation, answer, number, included, excluded and error of the operation that a reader chose over
    the operands that it labelled; answer and number are null where there is an error.

    questions: request_id, question, operation, unit. operands: request_id, ord, ref_id, label, role, entity, value (may be
    null). Operands labelled include count. A count adds values, one where there is none; if the question asks for different
    things, of operands of value one with the same name only the first. Two to twelve distinct names follow the count. A
    difference needs one minuend and one subtrahend; a length of time is never negative. max_by names the last of equal
    largest values.
    """
    q = F.lower("question")
    op = F.lower(_trimmed(F.col("operation")))
    asked = questions.select("request_id", "unit", F.when(op.isin("max-by", "argmax"), "max_by").otherwise(op).alias("operation"), F.coalesce(q.rlike(_DISTINCT), F.lit(False)).alias("distinct"), F.coalesce(q.rlike(_LONG) & F.lower(_trimmed(F.col("unit"))).isin(*_TIME), F.lit(False)).alias("long"))
    n = operands.count()
    rows = views.dealt(operands, "request_id", rows=n, most=OPERANDS).join(asked.select("request_id", "distinct"), "request_id")
    entity = F.nullif(_trimmed(F.col("entity")), F.lit(""))
    rows = rows.select("request_id", "ord", "distinct", F.lower(_trimmed(F.col("label"))).alias("label"), F.lower(_trimmed(F.col("role"))).alias("role"), entity.alias("entity"), F.coalesce(entity_key(F.col("entity")), F.lit("")).alias("key"), F.col("value").cast("double").alias("value"), F.coalesce("value", F.lit(1.0)).cast("double").alias("weight"))
    rows = rows.withColumn("in", F.coalesce(F.col("label") == "include", F.lit(False)))
    # How many such operands come before one of the same name; both windows are one sort.
    before = Window.partitionBy("request_id", "key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda rule: F.coalesce(F.count_if(rule).over(before), F.lit(0)) > 0
    single = F.col("in") & F.col("distinct") & (F.col("weight") == 1.0) & (F.col("key") != "")
    rows = rows.withColumn("single", single)
    rows = rows.withColumn("counted", F.col("in") & ~(F.col("single") & earlier(F.col("single"))))
    rows = rows.withColumn("named", F.col("counted") & F.col("entity").isNotNull())
    rows = rows.withColumn("name", F.when(F.col("named") & ~earlier(F.col("named")), F.col("entity")))
    of = lambda c, rule: F.when(rule, F.col(c))
    included, minuend, subtrahend = F.col("in"), F.col("in") & (F.col("role") == "minuend"), F.col("in") & (F.col("role") == "subtrahend")
    in_order = lambda c, rule: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(rule & F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("x"))))), lambda x: x["x"]), ", ")
    got = rows.groupBy("request_id").agg(
        F.count_if(included).alias("included"),
        F.count_if(F.col("label") == "exclude").alias("excluded"),
        F.count_if(~F.coalesce(F.col("label").isin(*_LABELS), F.lit(False))).alias("strange"),
        F.count_if(included & F.col("value").isNull()).alias("blank"),
        F.sum(of("value", included)).alias("total"),
        F.sum(of("weight", F.col("counted"))).alias("count"),
        F.count_if(minuend).alias("minuends"),
        F.count_if(subtrahend).alias("subtrahends"),
        (F.sum(of("value", minuend)) - F.sum(of("value", subtrahend))).alias("gap"),
        F.max_by(F.struct("entity", "value"), F.when(included & F.col("value").isNotNull(), F.struct("value", "ord"))).alias("top"),
        F.count("name").alias("names"),
        in_order("name", F.col("counted")).alias("name_list"),
        in_order("entity", included).alias("list"),
    )
    every = asked.join(got, "request_id", "left").fillna(0, ["included", "excluded", "strange", "blank", "minuends", "subtrahends", "names"]).fillna(0.0, ["count"])
    o = F.col("operation")
    is_ = lambda *names: o.isin(*names)
    error = (
        F.when(~F.coalesce(is_(*_OPERATIONS), F.lit(False)), "unsupported operation")
        .when(F.col("strange") > 0, "unsupported label")
        .when(is_("sum", "average") & (F.col("included") == 0), "no included operand")
        .when(is_("sum", "average") & (F.col("blank") > 0), "an included operand has no value")
        .when(is_("difference") & ((F.col("minuends") != 1) | (F.col("subtrahends") != 1)), "not one minuend and one subtrahend")
        .when(is_("difference") & F.col("gap").isNull(), "an included operand has no value")
        .when(is_("max_by") & F.col("top").isNull(), "no included operand has a value")
        .when(is_("max_by") & F.col("top.entity").isNull(), "the largest has no name")
        .when(is_("list") & (F.coalesce("list", F.lit("")) == ""), "no included operand has a name")
    )
    number = F.when(is_("sum"), F.col("total")).when(is_("average"), F.col("total") / F.col("included")).when(is_("count"), F.col("count")).when(is_("difference"), F.when(F.col("long"), F.abs("gap")).otherwise(F.col("gap"))).when(is_("max_by"), F.col("top.value"))
    every = every.withColumns({"error": error, "number": F.when(error.isNull(), number)})
    base = number_text(F.col("number"), F.col("unit"))
    text = F.when(is_("max_by"), F.col("top.entity")).when(is_("list"), F.col("list")).when(is_("unknown"), "UNKNOWN").when(is_("count") & F.col("names").between(2, 12), F.concat(base, F.lit(": "), "name_list")).otherwise(base)
    return every.select("request_id", "operation", F.when(F.col("error").isNull(), text).alias("answer"), "number", "included", "excluded", "error")


def _kind(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x), F.lit(""))


def _part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str) -> Column:
    """The text at a path; null if there is none or it is no text."""
    return F.when(_kind(_part(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def _whole(value: Column, path: str) -> Column:
    """The whole number at a path, 0 or more; null if there is none."""
    number = F.when(_kind(_part(value, path)) == "BIGINT", F.try_variant_get(value, path, "long"))
    return F.when(number >= 0, number)


def _truth(value: Column, path: str) -> Column:
    return F.when(_kind(_part(value, path)) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


#: Limits of calls, by the path of the argument.
_ENTRIES, _TOKENS, _DEPTH, _PAGE, _LINKS = 64, 16_000, 8, 256, 32
_INGEST = {"dimensions": (1, 64), "entries": (1, 256), "relations": (0, 512), "evidence": (0, 512)}


def bounded_call(tool: Column, arguments: Column) -> Column:
    """Whether a call of a tool (arguments: JSON) stays under the limits of its kind; other tools never do, nor does
    what is no JSON object. The shape of a write's arguments is judged with its plan (writing.plans)."""
    value = F.try_parse_json(arguments)
    under = lambda path, most: F.coalesce(_whole(value, path) <= most, F.lit(True))
    within = lambda path, most: F.coalesce(_whole(value, path).between(1, most), F.lit(False))
    has = lambda path: _text(value, path).isNotNull()
    size = lambda path: F.when(_kind(_part(value, path)).startswith("ARRAY"), F.size(F.try_variant_get(value, path, "array<variant>")))

    def cursor(name: str) -> Column:
        at = lambda key: _part(value, f"$.{name}.{key}").isNotNull().cast("int")
        text = lambda key: F.coalesce(_text(value, f"$.{name}.{key}") != "", F.lit(False))
        some = text("ref") | text("time") | F.coalesce(_whole(value, f"$.{name}.sequence") > 0, F.lit(False))
        return (at("ref") + at("time") + at("sequence") == 1) & some

    budget = under("$.budget.tokens", _TOKENS)
    deep = budget & under("$.budget.depth", _DEPTH)
    limits = under("$.limit.entries", _ENTRIES) & under("$.limit.tokens", _TOKENS) & budget
    parts = None
    for name, (least, most) in _INGEST.items():
        good = F.coalesce(size(f"$.memory.{name}").between(least, most), F.lit(False))
        parts = good if parts is None else parts & good
    rules = {
        "kernel_wake": F.coalesce(_text(value, "$.about") != "", F.lit(False)) & deep & under("$.depth", _DEPTH),
        "kernel_near": within("$.limit.entries", _ENTRIES) & within("$.limit.tokens", _TOKENS) & deep & under("$.window.before_entries", _ENTRIES) & under("$.window.after_entries", _ENTRIES) & cursor("around"),
        "kernel_trace": has("$.from") & has("$.to") & within("$.budget.tokens", _TOKENS) & under("$.budget.depth", _DEPTH) & under("$.page.entries", _PAGE),
        "kernel_inspect": has("$.ref") & F.coalesce(~_truth(value, "$.include.raw"), F.lit(False)),
        "kernel_goto": cursor("at") & limits,
        "kernel_rewind": cursor("from") & limits,
        "kernel_forward": cursor("from") & limits,
        "kernel_ask": budget,
        "kernel_write_memory": F.coalesce(_truth(value, "$.options.strict"), F.lit(False)) & _truth(value, "$.options.dry_run").isNotNull() & under("$.options.sequence", 2**32 - 1) & F.coalesce(size("$.connect_to").between(1, _LINKS), F.lit(False)),
        "kernel_ingest": _truth(value, "$.dry_run").isNotNull() & parts,
    }
    out = F.lit(False)
    for name, rule in rules.items():
        out = F.when(tool == name, rule).otherwise(out)
    return F.coalesce(out & _kind(value).startswith("OBJECT"), F.lit(False))


#: What can be seen of calls.
_READS = ("wake", "ask", "near", "goto", "rewind", "forward", "trace", "inspect")
_WRITES = ("ingest", "write_memory")
CAPABILITIES = {
    "tool": tuple(f"tool:kernel_{t}" for t in _READS) + ("tool:stop",),
    "cursor": ("cursor:ref", "cursor:time", "cursor:sequence"),
    "dimensions": ("dimensions.mode:all", "dimensions.mode:only", "dimensions.mode:except", "dimensions.scope:current_about", "dimensions.scope:abouts", "dimensions.scope:all_abouts"),
    "pagination": ("trace.page:first", "trace.page:continue"),
    "window_policy": ("window:expand", "window:shrink", "window:stop_sufficient"),
    "security": ("inspect.raw:false",),
}


def observed_capabilities(actions: DataFrame) -> DataFrame:
    """Capability and times: in how many actions (JSON: type, tool, arguments) each can be seen."""
    # Equal actions are counted before they are parsed, and each is parsed once.
    actions = actions.groupBy("action").agg(F.count("*").alias("n")).select(F.try_parse_json("action").alias("action"), "n")
    a = F.col("action")
    kind, tool = _text(a, "$.type"), _text(a, "$.tool")
    call = kind.isin("tool_call", "stop") & tool.isNotNull()
    name = F.regexp_replace(tool, "^kernel_", "")
    cursor_at = F.when(name == "near", "around").when(name == "goto", "at").when(name.isin("rewind", "forward"), "from")

    def cursor(key: str) -> Column:
        out = F.lit(None).cast("boolean")
        for place in ("around", "at", "from"):
            out = F.when(cursor_at == place, _part(a, f"$.arguments.{place}.{key}").isNotNull()).otherwise(out)
        return F.coalesce(out, F.lit(False))

    mode, scope = _text(a, "$.arguments.dimensions.mode"), _text(a, "$.arguments.dimensions.scope")
    before, entries = _whole(a, "$.arguments.window.before_entries"), _whole(a, "$.arguments.limit.entries")
    page, more = _part(a, "$.arguments.page").isNotNull(), _part(a, "$.arguments.page.cursor").isNotNull()
    seen = [
        F.when(kind == "stop", "tool:stop"),
        F.when(kind == "stop", "window:stop_sufficient"),
        F.when(call & tool.isin(*(f"kernel_{t}" for t in _READS + _WRITES)), F.concat(F.lit("tool:"), tool)),
        F.when(call & mode.isin("all", "only", "except"), F.concat(F.lit("dimensions.mode:"), mode)),
        F.when(call & scope.isin("current_about", "abouts", "all_abouts"), F.concat(F.lit("dimensions.scope:"), scope)),
        F.when(call, F.when(cursor("ref"), "cursor:ref").when(cursor("time"), "cursor:time").when(cursor("sequence"), "cursor:sequence")),
        F.when(call & (name == "trace") & page, F.when(more, "trace.page:continue").otherwise("trace.page:first")),
        F.when(call & (name == "inspect") & ~_truth(a, "$.arguments.include.raw"), "inspect.raw:false"),
        F.when(call & ((before > 6) | (entries > 12)), "window:expand"),
        F.when(call & ((before < 6) | (entries < 12)), "window:shrink"),
    ]
    return actions.select(F.explode(F.array_compact(F.array(*seen))).alias("capability"), "n").groupBy("capability").agg(F.sum("n").alias("times"))


def coverage(required: DataFrame, observed: DataFrame) -> DataFrame:
    """Grp, covered, total, percent and missing (in order) of required capabilities (grp, capability) among observed ones
    (capability, times); the row whose grp is null is over all, and there alone where nothing is required, with 100 percent."""
    seen = observed.filter("times > 0").select("capability").distinct().withColumn("seen", F.lit(True))
    rows = required.select("grp", "capability").distinct().join(seen, "capability", "left").fillna({"seen": False})
    out = rows.rollup("grp").agg(F.grouping("grp").alias("whole"), F.count_if("seen").alias("covered"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(~F.col("seen"), F.col("capability")))).alias("missing"))
    if required.isEmpty():
        out = required.agg(F.lit(None).cast("string").alias("grp"), F.count("*").alias("covered"), F.count("*").alias("total"), F.array().cast("array<string>").alias("missing"))
    return out.select("grp", "covered", "total", F.when(F.col("total") == 0, 100.0).otherwise(F.col("covered") * 100.0 / F.col("total")).alias("percent"), "missing")


def check_scores(cases: DataFrame, checks: dict[str, list[Column]]) -> DataFrame:
    """Cases with, for each name, the share of its checks that hold; a check that is null does not."""
    share = lambda rules: sum((F.coalesce(r.cast("int"), F.lit(0)) for r in rules), F.lit(0)) / F.lit(len(rules))
    return cases.select("*", *(share(rules).alias(name) for name, rules in checks.items() if rules))


def memory_metadata(properties: Column) -> Column:
    """The metadata that a node's properties hold as a JSON object of texts; empty if it is no such."""
    text = F.coalesce(F.try_element_at(properties, F.lit("payload_metadata")), F.try_element_at(properties, F.lit("metadata")))
    pairs = F.from_json(text, "map<string,variant>")
    plain = F.forall(F.map_values(pairs), lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.coalesce(F.when(plain, F.transform_values(pairs, lambda k, v: F.try_variant_get(v, "$", "string"))), F.create_map().cast("map<string,string>"))


def memory_source(properties: Column) -> Column:
    """Where a node's memory is from: source, or payload_source where that is not there; null if it is blank."""
    own = F.coalesce(F.try_element_at(properties, F.lit("source")), F.try_element_at(properties, F.lit("payload_source")))
    return F.when(_trimmed(own) != "", own)
