"""Operator 5 on planted quotes."""

import random
import re
import time

import duckdb

from mnemograph.llm import quote_links


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.turn): r for r in quote_links.link_replies(df).collect()}


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a table?\nPlease show the code."),
        (1, 1, "assistant", "Use the sort verb."),
        (1, 2, "user", "On Monday Ann wrote:\n> How do I sort  a TABLE?\nStill unclear."),
        (1, 3, "assistant", "> > How do I sort a table?\n> Still unclear.\n\nSee above."),
        (2, 0, "user", "> never said before\nHello"),
        (2, 1, "user", "plain > sign"),
    ]
    got = linked(spark, rows)
    assert [(got[1, t].reply_to, got[1, t].linked, got[1, t].quote_levels) for t in range(4)] == [(None, False, 0), (0, False, 0), (0, True, 1), (2, True, 2)]
    assert got[1, 2].body == "Still unclear." and got[1, 3].body == "See above."
    assert (got[2, 0].reply_to, got[2, 0].linked, got[2, 0].quote_levels, got[2, 0].body) == (None, False, 1, "Hello")
    assert (got[2, 1].body, got[2, 1].quote_levels, got[2, 1].reply_to) == ("plain > sign", 0, 0)


def test_order_puts_a_message_behind_its_original(spark):
    rows = [(1, t, "user", text) for t, text in enumerate(("the first thing", "the second thing", "> the first thing\nyes", "> the second thing\nno", "> yes\nah"))]
    got = linked(spark, rows)
    order = [t for _, t in sorted(((-1 if r.reply_to is None else r.reply_to), t) for (_, t), r in got.items())]
    assert all(order.index(r.reply_to) < order.index(t) for (_, t), r in got.items() if r.reply_to is not None)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "> a"), (1, None, "user", "> long enough line"), (1, 0, None, None), (1, 1, "user", ""), (1, 2, "user", ">" * 50 + " deep"), (3, 0, "user", "same line here"), (3, 0, "user", "same line here"), (3, 1, "user", "> same line here"), (4, 0, "user", "word\n" * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quote_links.link_replies(df.selectExpr("*", "1 as body", "2 as passages", "3 as level")).collect()
    assert len(got) == len(rows)
    assert next(r for r in got if r.conv_id == 3 and r.turn == 1).linked
    assert quote_links.link_replies(df.limit(0)).count() == 0


def test_sql(spark):
    d = duckdb.connect()
    d.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = sorted(d.execute(quote_links.OP5_SQL).fetchall(), key=str)
    got = quote_links.op5_quote_links(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == want
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_gaps_and_positions(spark):
    rows = [(1, 0, "user", "the first thing"), (1, 3, "user", "the second thing"), (1, 7, "user", "> the first thing\nyes"), (1, 8, "user", "no"), (2, 5, "user", "starts late"), (2, 5, "user", "again"), (2, 9, "user", "more"), (2, None, "user", "x"), (None, 4, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quote_links.in_reply_order(quote_links.link_replies(df), "body").collect()
    want = {"the first thing": (None, 1), "the second thing": (0, 2), "yes": (0, 3), "no": (7, 4), "x": (None, 1), "again": (None, 2), "starts late": (None, 3), "more": (5, 4), "y": (None, None)}
    assert {r.body: (r.reply_to, r.position) for r in got} == want and len(got) == len(rows)


def test_order_sql(spark):
    d = duckdb.connect()
    d.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = sorted(d.execute(quote_links.OP5_ORDER_SQL).fetchall(), key=str)
    assert sorted(map(tuple, quote_links.op5_reply_order(spark, "/root/testdata/sf0.001").collect()), key=str) == want


def passages(text):
    """Levels and texts of the quoted runs, and the body, by a plain loop over the lines."""
    runs, body = [], []
    for line in re.split("\r?\n", text):
        marks = re.match(r"^((?:[ \t]*>)*)", line)[0]
        level, rest = marks.count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
        if level == 0 and not re.match(quote_links._ATTRIBUTION.replace("(?i)", "(?i:") + ")", rest):
            body.append(rest)
    return [(n, "\n".join(x)) for n, x in runs if n], "\n".join(body).strip()


def test_nested_quotes_by_brute_force(spark):
    rng = random.Random(3)
    parts = ["> ", ">> ", "> > ", " >", "", "", "\t> "]
    words = ["alpha beta gamma", "delta", "", "On Monday, x wrote:", "epsilon zeta eta theta", "> no"]
    texts = ["\n".join(rng.choice(parts) + rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    texts = [t for t in texts if re.search(r"(?m)^[ \t]*>", t)]
    df = spark.createDataFrame(list(enumerate(texts)), "turn long, text string")
    for r in quote_links.parse(df).collect():
        runs, body = passages(texts[r.turn])
        assert [(p.level, p.text) for p in r.passages] == runs, texts[r.turn]
        assert r.body == body


def test_many_lines(spark):
    start = time.monotonic()
    quoted = "\n".join(f"> line number {i} of the quoted text" for i in range(100_000))
    steps = "\n".join(f"{'>' * (1 + i % 2)} line {i} here" for i in range(20_000))
    df = spark.createDataFrame([(1, 0, "u", "line number 7 of the quoted text"), (1, 1, "v", quoted + "\nanswer"), (1, 2, "u", steps)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quote_links.link_replies(df).collect()}
    assert got[1].linked and got[1].body == "answer" and got[2].quote_levels == 2
    assert time.monotonic() - start < 60
