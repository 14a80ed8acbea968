"""Typed values found in evidence texts (X3 to X14) and answers derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemograph.functions import spans

#: Currencies by sign and by word.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
WORDS = {"usd": "USD", "dollar": "USD", "dollars": "USD", "eur": "EUR", "euro": "EUR", "euros": "EUR", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "jpy": "JPY", "yen": "JPY"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_AMOUNT = r"[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?"
_MONEY = rf"([$€£¥])[ ]?({_AMOUNT})|(?<![\w.,])({_AMOUNT})[ ]+(?i:({'|'.join(sorted(WORDS, key=len, reverse=True))}))(?!\w)|(?<!\w)(?i:(usd|eur|gbp|jpy))[ ]+({_AMOUNT})"
def amount(raw: Column) -> Column:
    """A number; commas alone with two digits or fewer behind the last are a decimal comma."""
    comma = raw.rlike(r"^[0-9]+,[0-9]{1,2}$")
    return F.when(comma, F.replace(raw, F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit(""))).try_cast("double")


def money(fragments: DataFrame) -> DataFrame:
    """ref_id, nth, raw, currency, amount, amount_minor of amounts with a currency's sign, code or word."""
    found = fragments.select("ref_id", F.posexplode(F.regexp_extract_all(spans.prose(F.col("text")), F.lit(_MONEY), F.lit(0))).alias("nth", "raw"))
    number = F.regexp_extract("raw", _AMOUNT, 0)
    name = F.trim(F.replace("raw", number, F.lit("")))
    names = F.create_map(*(F.lit(x) for pair in {**SIGNS, **WORDS}.items() for x in pair))
    value = amount(number)
    return found.select("ref_id", F.col("nth").cast("long").alias("nth"), "raw", F.get(F.array(names[F.lower(name)]), F.lit(0)).alias("currency"), value.alias("amount"), F.round(value * 100).cast("long").alias("amount_minor"))


def dates(fragments: DataFrame) -> DataFrame:
    """ref_id, nth, raw, date; a date that no calendar has is null."""
    name = "|".join(m for month in MONTHS for m in (month, month[:3])) + "|sept"
    iso, us = r"(?<![\d/-])(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?![\d/-])", r"(?<![\d/-])(\d{1,2})/(\d{1,2})/(\d{4})(?![\d/-])"
    long_a, long_b = rf"(?i)\b({name})\.? (\d{{1,2}}),? (\d{{4}})\b", rf"(?i)\b(\d{{1,2}}) ({name})\.? (\d{{4}})\b"
    found = fragments.select("ref_id", F.posexplode(F.regexp_extract_all(spans.prose(F.col("text")), F.lit(f"{iso}|{us}|{long_a}|{long_b}"), F.lit(0))).alias("nth", "raw"))
    part = lambda p, g: F.regexp_extract("raw", p, g)
    month = lambda x: F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.lower(F.substring(x, 1, 3))).cast("string")
    text = (
        F.when(F.col("raw").rlike(iso), F.concat_ws("-", part(iso, 1), F.lpad(part(iso, 2), 2, "0"), F.lpad(part(iso, 3), 2, "0")))
        .when(F.col("raw").rlike(us), F.concat_ws("-", part(us, 3), F.lpad(part(us, 1), 2, "0"), F.lpad(part(us, 2), 2, "0")))
        .when(F.col("raw").rlike(long_a), F.concat_ws("-", part(long_a, 3), F.lpad(month(part(long_a, 1)), 2, "0"), F.lpad(part(long_a, 2), 2, "0")))
        .otherwise(F.concat_ws("-", part(long_b, 3), F.lpad(month(part(long_b, 2)), 2, "0"), F.lpad(part(long_b, 1), 2, "0")))
    )
    return found.select("ref_id", F.col("nth").cast("long").alias("nth"), "raw", text.try_cast("date").alias("date"))


def _spans(fragments: DataFrame, kind: str) -> DataFrame:
    """ref_id, nth and span of the spans of a kind, counted within it."""
    return fragments.select("ref_id", F.posexplode(F.filter(spans.protected(F.col("text")), lambda x: x["kind"].endswith(kind))).alias("nth", "span")).withColumn("nth", F.col("nth").cast("long"))


def urls(fragments: DataFrame) -> DataFrame:
    """ref_id, nth, url."""
    return _spans(fragments, "url").select("ref_id", "nth", F.col("span.raw").alias("url"))


#: Notations of mathematics by their opening mark.
NOTATIONS = {"$$": "display_dollar", "\\(": "inline_paren", "\\[": "display_bracket", "$": "inline_dollar"}


def math(fragments: DataFrame) -> DataFrame:
    """ref_id, nth, raw, notation and expression, what stands between the marks; the closing one may be missing."""
    raw = F.col("span.raw")
    notation = expression = None
    for opening, name in NOTATIONS.items():
        closing = {"\\(": "\\)", "\\[": "\\]"}.get(opening, opening)
        body = F.substring(raw, len(opening) + 1, 2**30)
        inner = F.trim(F.when(body.endswith(closing), F.left(body, F.length(body) - len(closing))).otherwise(body))
        here = raw.startswith(opening)
        notation = F.when(here, name) if notation is None else notation.when(here, name)
        expression = F.when(here, inner) if expression is None else expression.when(here, inner)
    return _spans(fragments, "math").select("ref_id", "nth", raw.alias("raw"), notation.alias("notation"), expression.alias("expression"))


def code(fragments: DataFrame) -> DataFrame:
    """ref_id, nth, language, body of fenced and inline code; without a name at the fence, a guess by its words."""
    found = _spans(fragments, "code")
    fence, content = r"^```[ \t]*[`{}.]*([A-Za-z0-9+#_-]*)", r"(?s)^```[^\n]*\n(.*?)(?:```)?$"
    fenced = F.col("span.kind") == "fenced_code"
    named = F.lower(F.regexp_extract("span.raw", fence, 1))
    alias = F.create_map(*(F.lit(x) for pair in (("py", "python"), ("rs", "rust"), ("js", "javascript"), ("ts", "typescript"), ("sh", "bash"), ("shell", "bash")) for x in pair))
    body = F.when(fenced, F.regexp_replace(F.regexp_extract("span.raw", content, 1), r"^\s+|\s+$", "")).otherwise(F.regexp_replace("span.raw", "^`|`$", ""))
    guess = F.when(body.rlike(r"\bdef \w+\(|\bimport \w+"), "python").when(body.rlike(r"\bfn \w+\(|\blet mut\b"), "rust").when(body.rlike(r"(?i)\bselect\b.+\bfrom\b"), "sql").when(body.rlike(r"^\s*[{\[]"), "json").otherwise("unknown")
    return found.select("ref_id", "nth", F.when(fenced & (named != ""), F.coalesce(F.try_element_at(alias, named), named)).otherwise(guess).alias("language"), body.alias("body"))


def _reader(name: str, find: Callable[[DataFrame], DataFrame], raw: str, value: Callable[[], Column]) -> tuple[str, Callable]:
    return name, lambda fragments: find(fragments).select("ref_id", "nth", F.col(raw).alias("raw"), value().alias("value"))


def default_readers() -> list[tuple]:
    """Amounts, dates, code, mathematics and URLs."""
    return [
        _reader("currency", money, "raw", lambda: F.concat_ws(" ", "currency", F.format_string("%.2f", "amount"))),
        _reader("date", dates, "raw", lambda: F.col("date").cast("string")),
        _reader("source_code", code, "body", lambda: F.col("language")),
        _reader("math", math, "raw", lambda: F.concat_ws(":", "notation", "expression")),
        _reader("url", urls, "url", lambda: F.col("url")),
    ]


def read(fragments: DataFrame, readers: list[tuple] | None = None) -> DataFrame:
    """Place and name of the reader, ref_id, nth, raw and value of all mentions that the readers find in fragments
    (ref_id, text), each in its own way. A reader is a name and a function of fragments; names must differ."""
    readers = default_readers() if readers is None else readers
    names = [name for name, _ in readers]
    if not names or len(set(names)) < len(names):
        raise ValueError(f"readers need names of their own: {names}")
    out = None
    for place, (name, find) in enumerate(readers):
        found = find(fragments).select(F.lit(place).alias("place"), F.lit(name).alias("reader"), "ref_id", "nth", "raw", "value")
        out = found if out is None else out.unionByName(found)
    return out


def operands(fragments: DataFrame) -> DataFrame:
    """The amounts and dates of labelled fragments as operands: request_id, operation, ord, ref_id, label, role,
    entity, kind and value.

    fragments: request_id, operation, ord (their place), ref_id (theirs alone), text, label, and role and entity, which
    may be null. An amount has the kind of its currency, a date its days since 1970 as value; amounts come first. What has
    no value is no operand.
    """
    own = fragments.select("request_id", "operation", "ord", "ref_id", "label", "role", "entity")
    text = fragments.select("ref_id", "text")
    amounts = money(text).select("ref_id", "nth", F.concat(F.lit("money:"), "currency").alias("kind"), F.col("amount").alias("value"))
    days = dates(text).select("ref_id", (F.col("nth") + 500_000).alias("nth"), F.lit("date").alias("kind"), F.unix_date("date").cast("double").alias("value"))
    found = amounts.unionByName(days).filter("value is not null")
    return own.join(found, "ref_id").withColumn("ord", F.col("ord") * 1_000_000 + F.col("nth")).select("request_id", "operation", "ord", "ref_id", "label", "role", "entity", "kind", "value")


def partitioned(rows: DataFrame) -> DataFrame:
    """request_id and the references of a request's operands that count (included) and that do not (excluded), each
    once, in the order of their first operand; every label but exclude counts."""
    out = F.coalesce(F.col("label") == "exclude", F.lit(False))
    first = rows.groupBy("request_id", "ref_id", out.alias("out")).agg(F.min("ord").alias("ord"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "ref_id")))), lambda x: x["ref_id"])
    return first.groupBy("request_id").agg(listed(~F.col("out")).alias("included"), listed(F.col("out")).alias("excluded"))


def derive(operands: DataFrame) -> DataFrame:
    """One answer for each request of operands (request_id, operation, ord, role, entity, kind, value, and label
    where some are excluded, which then do not count).

    sum and average need one kind, which is not dates; the difference of two dates is in days; count takes distinct entities; difference takes the minuend less the subtrahend, or
    the first of exactly two less the second; max_by names the entity of the largest value, the last of equal ones;
    list joins entities in order, those of equal ord by place, if operands have one. status tells why there is no answer.
    """
    if "label" in operands.columns:
        operands = operands.filter(F.coalesce(F.col("label") != "exclude", F.lit(True)))
    return _derived(operands).drop("operands")


def _derived(operands: DataFrame) -> DataFrame:
    """derive, with the number of a request's operands; one aggregate, without a row for each distinct value."""
    name = F.coalesce(F.nullif(F.lower(F.trim("entity")), F.lit("")), F.col("ord").cast("string"))
    at = ["ord", "place"] if "place" in operands.columns else ["ord"]
    got = operands.groupBy("request_id", "operation").agg(
        F.count("*").alias("n"),
        F.min("kind").alias("kind"),
        F.max("kind").alias("last_kind"),
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
        F.size(F.collect_set(name)).alias("names"),
        F.max(F.when(F.col("role") == "minuend", F.col("value"))).alias("a"),
        F.max(F.when(F.col("role") == "subtrahend", F.col("value"))).alias("b"),
        F.min_by("value", "ord").alias("first"),
        F.max_by("value", "ord").alias("second"),
        F.max_by(F.struct("entity", "value"), F.struct("value", "ord")).alias("top"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*at, "entity"))), lambda x: x["entity"]), ", ").alias("list"),
    )
    op, one_kind = F.col("operation"), F.coalesce(F.col("kind") == F.col("last_kind"), F.lit(False))
    summable = one_kind & (F.col("kind") != "date")
    pair = F.col("a").isNotNull() & F.col("b").isNotNull()
    number = (
        F.when((op == "sum") & summable, F.col("total"))
        .when((op == "average") & summable, F.col("mean"))
        .when(op == "count", F.col("names").cast("double"))
        .when((op == "difference") & one_kind & pair, F.col("a") - F.col("b"))
        .when((op == "difference") & one_kind & (F.col("n") == 2), F.col("first") - F.col("second"))
        .when((op == "max_by") & one_kind, F.col("top.value"))
    )
    text = F.when((op == "max_by") & one_kind, F.col("top.entity")).when(op == "list", F.col("list"))
    status = F.when(number.isNotNull() | text.isNotNull(), "derived").when(~one_kind, "mixed kinds").otherwise("unknown")
    return got.select("request_id", "operation", F.col("n").alias("operands"), number.alias("number"), text.alias("answer"), status.alias("status"))


#: What a question about amounts, or about dates, must hold to ask for an operation, in the order tried, and
#: the operands that an operation needs.
MONEY_ASKED = {"max_by": ("highest-priced", "highest priced", "most expensive", "max price"), "sum": ("total", "combined", "sum", "spent", "budget", "cost altogether"), "difference": ("difference", "how much more", "how much less")}
DATES_ASKED = {"max_by": ("latest", "most recent", "current"), "difference": ("how long", "elapsed", "duration", "how many days", "how many weeks", "days between", "weeks between", "months between", "time between")}
NEEDED = 2


def asked(question: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """K4: the operation that a question asks for, by the first of the words that it holds; null without any."""
    low, out = F.lower(question), F.lit(None).cast("string")
    for name, some in reversed(words.items()):
        out = F.when(F.greatest(*(F.contains(low, F.lit(w)) for w in some)), name).otherwise(out)
    return out


def answers_of(questions: DataFrame, fragments: DataFrame) -> DataFrame:
    """K4, K5: request_id, reader (currency, date), operation, operands, number, answer and status of each question over the
    amounts, and over the dates, in its fragments.

    questions: request_id, question; fragments: request_id, ord (each its own in a request), text. A question that asks for
    no operation is 'not asked', one with fewer than two values has 'too few operands'; others are derived (derive). The
    difference of dates is from the earliest to the latest; the largest value is named by its own text.
    """
    named = fragments.select(F.concat_ws(":", F.col("ord").cast("string"), "request_id").alias("ref_id"), "text")
    place = F.substring_index("ref_id", ":", 1).cast("long") * 1_000_000 + F.col("nth")
    owner = F.regexp_replace("ref_id", "^[0-9]+:", "")
    amounts = money(named).select(owner.alias("request_id"), place.alias("ord"), F.col("raw").alias("entity"), F.concat(F.lit("money:"), "currency").alias("kind"), F.col("amount").alias("value"))
    days = dates(named).select(owner.alias("request_id"), place.alias("ord"), F.col("date").cast("string").alias("entity"), F.lit("date").alias("kind"), F.unix_date("date").cast("double").alias("value"))
    out = None
    for reader, words, found in (("currency", MONEY_ASKED, amounts), ("date", DATES_ASKED, days)):
        wanted = questions.select("request_id", asked(F.col("question"), words).alias("operation"))
        values = found.filter("value is not null").join(wanted.filter("operation is not null"), "request_id")
        span = Window.partitionBy("request_id").orderBy("value", "ord")
        ends = F.when(F.lit(reader == "date") & (F.row_number().over(span) == 1), "subtrahend").when(F.lit(reader == "date") & (F.lead("ord").over(span).isNull()), "minuend")
        derived = _derived(values.withColumn("role", ends)).drop("operation")
        every = wanted.join(derived, "request_id", "left").fillna({"operands": 0})
        status = F.when(F.col("operation").isNull(), "not asked").when(F.col("operands") < NEEDED, "too few operands").otherwise(F.col("status"))
        good = F.col("operands") >= NEEDED
        part = every.select("request_id", F.lit(reader).alias("reader"), "operation", "operands", F.when(good, F.col("number")).alias("number"), F.when(good, F.col("answer")).alias("answer"), status.alias("status"))
        out = part if out is None else out.unionByName(part)
    return out
