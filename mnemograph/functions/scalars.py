"""Column functions: names, texts, times, hashes and vectors of the memory model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semantic classes in the order of their salience.
SALIENCE = ("causal", "motivational", "evidential", "constraint", "procedural", "structural")
#: Classes that count for explanatory density; tiers also count constraints.
DENSITY_CLASSES = ("causal", "motivational", "evidential")
TIER_CLASSES = (*DENSITY_CLASSES, "constraint")
#: Other names of relation types.
RELATION_ALIASES = {"conflicts": "contradicts", "conflicts_with": "contradicts", "conflict_with": "contradicts", "matches_question_item": "matches_requirement"}
#: Words that answers may differ in.
GLUE = ("a", "an", "and", "are", "is", "the")


def relation_type(x: Column, known: tuple[str, ...] = ()) -> Column:
    """The canonical relation type; one that is not known keeps its own spelling, trimmed."""
    folded = F.lower(F.translate(F.trim(x), "- ", "__"))
    named = F.coalesce(*(F.when(folded == a, b) for a, b in RELATION_ALIASES.items()), folded)
    return F.when(named.isin(*known), named).otherwise(F.trim(x)) if known else named


def dimension_identity(about: Column, dimension: Column) -> Column:
    """The id of a dimension inside the memory of one about."""
    return F.concat(F.lit("about:"), about, F.lit(":dimension:"), dimension)


_IDENTITY = r"^about:(?s)(.*?):dimension:(.*)$"


def scope_about(scope: Column) -> Column:
    """The about of a dimension identity; null if either side is blank or it is none."""
    a, d = F.trim(F.regexp_extract(scope, _IDENTITY, 1)), F.trim(F.regexp_extract(scope, _IDENTITY, 2))
    return F.when((a != "") & (d != ""), a)


def scope_dimension(scope: Column) -> Column:
    """The dimension of a dimension identity."""
    a, d = F.trim(F.regexp_extract(scope, _IDENTITY, 1)), F.trim(F.regexp_extract(scope, _IDENTITY, 2))
    return F.when((a != "") & (d != ""), d)


def truncated(x: Column, most: int = 80) -> Column:
    """S3: at most so many characters, and three points behind a cut."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def fragment(x: Column) -> Column:
    """White space of any kind is one space, curly quotes are straight."""
    plain = F.translate(x, "   ‘’“”", "   ''\"\"")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def answer(x: Column) -> Column:
    """An answer for comparison."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def without_glue(x: Column) -> Column:
    """A normalised answer without its glue words."""
    return F.array_join(F.filter(F.split(x, " "), lambda w: ~w.isin(*GLUE)), " ")


def answers_match(expected: Column, observed: Column) -> Column:
    """Equal, or one holds the other and both have two words or more; glue words may be left out."""

    def close(a: Column, b: Column) -> Column:
        long = (F.size(F.split(a, " ")) >= 2) & (F.size(F.split(b, " ")) >= 2)
        return (a != "") & (b != "") & ((a == b) | long & (F.contains(a, b) | F.contains(b, a)))

    a, b = answer(expected), answer(observed)
    return close(a, b) | close(without_glue(a), without_glue(b))


def segment(x: Column, most: int = 80) -> Column:
    """A reference's part: letters and digits in lower case, other runs as one hyphen."""
    folded = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(folded, "^-+", ""), 1, most), "-+$", "")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def time_key(ts: Column) -> Column:
    """A string that sorts as the time does; years before 1970 included."""
    micros = F.unix_micros(ts.cast("timestamp"))
    seconds = F.floor(micros / F.lit(1_000_000)).cast("long")
    nanos = F.pmod(micros, F.lit(1_000_000)) * 1000
    return F.format_string("unix:%012d:%09d", seconds + F.lit(100_000_000_000), nanos)


def time_of(key: Column) -> Column:
    """The time of a key, to the microsecond."""
    seconds = F.substring(key, 6, 12).cast("long") - F.lit(100_000_000_000)
    return F.timestamp_micros(seconds * 1_000_000 + F.floor(F.substring(key, 19, 9).cast("long") / 1000))


def decimal_text(x: Column) -> Column:
    """A whole number where it is one to a millionth, else two places."""
    return F.when(F.abs(F.round(x) - x) < 1e-6, F.round(x).cast("long").cast("string")).otherwise(F.format_string("%.2f", x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in double precision; null if one has no length or the lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def salience(semantic_class: Column) -> Column:
    """O3: rank of a semantic class, 0 first."""
    out = F.lit(len(SALIENCE))
    for i, name in reversed(list(enumerate(SALIENCE))):
        out = F.when(semantic_class == name, i).otherwise(out)
    return out


def soft_coverage(expected: Column, observed: Column) -> Column:
    """Share of the expected values that the observed text holds, both normalised; null without values."""
    text = answer(observed)
    leaves = F.filter(F.transform(expected, answer), lambda x: x != "")
    return F.when(F.size(leaves) > 0, F.size(F.filter(leaves, lambda x: F.contains(text, x))) / F.size(leaves))


def looks_like_identifier(x: Column) -> Column:
    """Eight characters or more without spaces, letters, digits, - and _ alone, with a digit."""
    compact = F.replace(x, F.lit(" "), F.lit(""))
    return (F.length(compact) >= 8) & compact.rlike("^[A-Za-z0-9_-]+$") & compact.rlike("[0-9]")


def text_contains_answer(text: Column, expected: Column) -> Column:
    """Whether a text is the expected answer, or holds it where that looks like an identifier."""
    wanted = answer(expected)
    found = answers_match(expected, text) | (looks_like_identifier(wanted) & F.contains(answer(text), wanted))
    return F.coalesce((F.trim(expected) != "") & found, F.lit(False))


def answer_hit(expected: Column, observed: Column) -> Column:
    """K3: whether the expected answer, normalised, stands in the observed one; an empty one never does."""
    wanted = answer(expected)
    return F.coalesce((wanted != "") & F.contains(answer(observed), wanted), F.lit(False))


def memory_id(key: Column) -> Column:
    """The id of the memory of an idempotency key."""
    return F.concat(F.lit("memory:"), F.regexp_replace(key, "^ingest:", ""))


def civil_day(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01; null for a day that does not exist."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.unix_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")).cast("long")


def fact_line(line: Column) -> Column:
    """Struct of the number before a line's first point and the whole line, trimmed; null if it does not begin so."""
    number = F.regexp_extract(line, r"^\s*(\d+)\s*\.(.*\S.*)$", 1)
    return F.when(number != "", F.struct(number.try_cast("long").alias("number"), F.trim(line).alias("text")))


def inline_math(body: Column) -> Column:
    """Whether what stands between two dollar signs reads as mathematics and not as an amount of money."""
    x = F.trim(body)
    likely = x.rlike(r"[\\=+\-*/^_{}<>]") | x.rlike(r"^[0-9.,\s]+$") | (x.rlike("^[A-Za-z0-9]+$") & x.rlike("[A-Za-z]"))
    return F.coalesce((x != "") & ~x.contains("\n") & (F.octet_length(x) <= 120) & likely, F.lit(False))


def canonical_json(text: Column) -> Column:
    """A JSON text without white space and with the keys of every object in order; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def short_hash(text: Column) -> Column:
    """Sixteen hexadecimal digits of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def entry_ref(about: Column, kind: Column, summary: Column) -> Column:
    """The reference of an entry that was given none: its summary as a segment, or a hash where nothing of it is left."""
    return F.concat(about, F.lit(":entry:"), kind, F.lit(":"), F.coalesce(F.nullif(segment(summary), F.lit("")), short_hash(summary)))


def idempotency_key(arguments: Column) -> Column:
    """A key of a call's arguments (JSON): the same whatever the order of their keys, and whether it is a dry run."""
    pair = "map<string,variant>"
    options = F.from_json(F.get_json_object(arguments, "$.options"), pair)
    plain = F.map_concat(F.map_filter(F.from_json(arguments, pair), lambda k, v: k != "options"), F.create_map(F.lit("options"), F.parse_json(F.to_json(F.map_filter(options, lambda k, v: k != "dry_run")))))
    whole = F.when(options.isNull(), canonical_json(arguments)).otherwise(canonical_json(F.to_json(plain)))
    return F.concat(F.lit("write:"), short_hash(whole))


def logical_digest(about: Column, memory: Column, provenance: Column) -> Column:
    """SHA-256 of what a caller said: about, memory and provenance (JSON; null if there is none), whatever the order of keys."""
    zero = F.lit("\x00")
    tail = F.coalesce(canonical_json(provenance.cast("string")), F.lit(""))
    return F.sha2(F.concat(about, zero, canonical_json(memory), zero, tail), 256)
