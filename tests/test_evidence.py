"""Literal cases of extraction, derivation and scorecards."""

import random

import pytest
from pyspark.sql import functions as F

from mnemograph.functions import spans
from mnemograph.operators import evaluate, interpret


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def texts(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "ref_id string, text string")


def test_money(spark):
    got = interpret.money(texts(spark, "Paid $1,200.50 for hardware and another 30 EUR for shipping.", "`$5` at https://x.org/$6 and 12,5 euros", None, ""))
    assert rows(got.select("ref_id", "currency", "amount", "amount_minor")) == [("0", "EUR", 30.0, 3000), ("0", "USD", 1200.5, 120050), ("1", "EUR", 12.5, 1250)]


def test_dates(spark):
    got = interpret.dates(texts(spark, "2024-01-05, 1/6/2024, Jan 7, 2024 and 8 February 2024", "2024-13-40", None))
    assert rows(got.select("ref_id", F.coalesce(F.col("date").cast("string"), F.lit("-")))) == [("0", "2024-01-05"), ("0", "2024-01-06"), ("0", "2024-01-07"), ("0", "2024-02-08"), ("1", "-")]


def test_spans_and_code(spark):
    t = texts(spark, "a `x` b ```py\ndef f(): pass\n``` and https://e.org/a). $$y$$")
    assert [(r.kind, r.raw) for r in t.select(F.explode(spans.protected(F.col("text"))).alias("s")).select("s.kind", "s.raw").collect()] == [("inline_code", "`x`"), ("fenced_code", "```py\ndef f(): pass\n```"), ("url", "https://e.org/a"), ("math", "$$y$$")]
    assert rows(interpret.code(t).select("language", "body")) == [("python", "def f(): pass"), ("unknown", "x")]


def test_derive(spark):
    data = [("r", op, o, role, e, "usd", v) for op in ("sum", "max_by", "difference", "count", "list") for o, role, e, v in ((1, "minuend", "A", 5.0), (2, "subtrahend", "b", 5.0), (3, None, "a", 2.0))] + [("s", "sum", 1, None, "A", "usd", 1.0), ("s", "sum", 2, None, "A", "eur", 1.0)]
    got = interpret.derive(spark.createDataFrame(data, "request_id string, operation string, ord int, role string, entity string, kind string, value double"))
    assert {(r.request_id, r.operation): (r.number, r.answer, r.status) for r in got.collect()} == {
        ("r", "sum"): (12.0, None, "derived"),
        ("r", "max_by"): (5.0, "b", "derived"),  # the last of equal values
        ("r", "difference"): (0.0, None, "derived"),
        ("r", "count"): (2.0, None, "derived"),
        ("r", "list"): (None, "A, b, a", "derived"),
        ("s", "sum"): (None, None, "mixed kinds"),
    }


@pytest.mark.parametrize("files", [1, 2])
def test_lines_of_equal_ord_are_listed_in_the_order_of_the_table(spark, tmp_path, files):
    """Line 2 of part 5 and line 1 of part 1,000,005 have one ord. One thread of DuckDB keeps such lines as it reads them."""
    import duckdb

    from mnemograph.plans import catalog

    first, second = [(1, 5, 2), (2, 1_000_005, 1), (3, 5, 2)], [(1, 1_000_005, 1), (2, 5, 2), (3, 9, 1), (4, 7, 3)]
    parts = [first + second] if files == 1 else [second, first]  # read by name, not by size
    duck = duckdb.connect(config={"threads": 1})
    (tmp_path / "lineitem.parquet").mkdir()
    for n, lines in enumerate(parts):
        values = ", ".join(map(str, lines))
        duck.execute(f"COPY (SELECT l_orderkey, l_partkey, l_linenumber, 1.0::DOUBLE AS l_quantity FROM (VALUES {values}) v(l_orderkey, l_partkey, l_linenumber)) TO '{tmp_path}/lineitem.parquet/part-{n}.parquet'")
    duck.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(duck.execute(f"SELECT request_id, answer FROM ({catalog.ORACLES['derive_list']})").fetchall())
    ends = ("part:5, part:1000005", "part:1000005, part:5")
    assert want[:2] == [("order:1", ends[files - 1]), ("order:2", ends[1] if files == 1 else ends[0])]
    assert rows(catalog.QUERIES["derive_list"](spark, str(tmp_path)).select("request_id", "answer")) == want


def test_wilson_and_verdict(spark):
    p, low, high = evaluate.wilson(F.lit(8), F.lit(10))
    got = spark.range(1).select(p, F.round(low, 4), F.round(high, 4), evaluate.verdict(F.lit(0.9), F.lit(0.8))).first()
    assert tuple(got) == (0.8, 0.4902, 0.9433, "SUPPORTED")
    zero = evaluate.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(*(F.coalesce(x, F.lit(-1.0)) for x in zero)).first()) == (0.0, 0.0, 0.0)


def by_characters(text):
    """The same spans, by looking at every place of the text for every kind."""
    space = lambda c: c in "\t\n\x0b\x0c\r \x85\xa0\u2003\u2028\u3000"

    def maths(body):
        x = body.strip()
        if not x or "\n" in x or len(x.encode()) > 120:
            return False
        alone = all(c.isascii() and c.isalnum() for c in x) and any(c.isalpha() for c in x)
        return any(c in "\\=+-*/^_{}<>" for c in x) or all(c in "0123456789.," or space(c) for c in x) or alone

    found = []
    for kind, rank, opening, closing in (("fenced_code", 0, "```", "```"), ("math", 1, "$$", "$$"), ("math", 1, "\\(", "\\)"), ("math", 1, "\\[", "\\]")):
        i = 0
        while i < len(text):
            if text[i : i + len(opening)] == opening:
                j = i + len(opening)
                while j < len(text) and text[j : j + len(closing)] != closing:
                    j += 1
                end = min(len(text), j + len(closing)) if j < len(text) else len(text)
                found.append((i, rank, end, kind))
                i = end
            else:
                i += 1
    i = 0
    while i < len(text):
        if text[i] == "`":
            if text[i : i + 3] == "```":
                i += 3
                continue
            j = next((j for j in range(i + 1, len(text)) if text[j] == "`"), None)
            if j is None:
                break
            found.append((i, 0, j + 1, "inline_code"))
            i = j
        i += 1
    i = 0
    while i < len(text):
        if text[i] == "$" and text[i : i + 2] != "$$" and not (i and text[i - 1] == "\\"):
            j = next((j for j in range(i + 1, len(text)) if text[j] == "$"), None)
            if j is None:
                break
            if maths(text[i + 1 : j]):
                found.append((i, 1, j + 1, "math"))
                i = j
        i += 1
    for prefix in ("https://", "http://"):
        i = 0
        while i < len(text):
            if text[i : i + len(prefix)] == prefix:
                j = i
                while j < len(text) and not space(text[j]):
                    j += 1
                while j > i and text[j - 1] in ".,;:!?)":
                    j -= 1
                found.append((i, 2, j, "url"))
                i = max(j, i + len(prefix))
            else:
                i += 1
    out = []
    for start, _, end, kind in sorted(found):
        if start < end and all(end <= a or b <= start for _, a, b, _ in out):
            out.append((kind, start, end, text[start:end]))
    return out


def test_spans_of_any_text(spark):
    rng = random.Random(7)
    parts = ["$", "$$", "`", "```", "\\", "\\(", "\\)", "\\[", "\\]", "https://a.b/c", "http://", "x", "5", "1,5", " ", "\n", "+", ").", "word", "é", "$5", "$x$"]
    data = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for text in data:
        assert spans.protected_spans(text) == by_characters(text), text
    df = spark.createDataFrame([(t,) for t in data[:200]] + [(None,)], "text string")
    got = df.select("text", spans.protected(F.col("text")).alias("s"), spans.prose(F.col("text")).alias("p")).collect()
    for r in got:
        want = by_characters(r.text or "")
        assert [tuple(s) for s in r.s] == want
        if not want:
            assert r.p == r.text


def test_composed_reader(spark):
    found = interpret.read(texts(spark, "Paid $5 + $6 on 2024-01-05, see https://e.org and `x = 1`", "$x+5$ is no amount, 6 EUR is"))
    assert sorted((r.place, r.reader, r.raw) for r in found.collect()) == [(0, "currency", "6 EUR"), (1, "date", "2024-01-05"), (2, "source_code", "x = 1"), (3, "math", "$5 + $"), (3, "math", "$x+5$"), (4, "url", "https://e.org")]
    twice = interpret.default_readers()[:1] * 2
    with pytest.raises(ValueError, match="names of their own"):
        interpret.read(texts(spark, "x"), twice)
