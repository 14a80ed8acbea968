"""The command log against a plain loop, writers that race, and the write verb."""

import random

from pyspark.sql import functions as F

from mnemograph.functions import scalars
from mnemograph.operators import commands, ingest
from mnemograph.sources import logs

SCHEMA = "seq long, root string, role string, idempotency_key string, digest string, content_hash string, expected_revision long, expected_content_hash string"


def brute(rows, heads=None, keys=None):
    """(seq, outcome, revision) of rows in the order of seq; heads and keys are carried on."""
    heads, keys, out = {} if heads is None else heads, {} if keys is None else keys, []
    for seq, root, role, key, digest, content, asked, asked_hash in sorted(rows):
        revision, last = heads.get((root, role), (0, None))
        if key is not None and key in keys:
            first, at = keys[key]
            out.append((seq, "replayed", at) if first == digest else (seq, "key conflict", None))
        elif (asked is not None and asked != revision) or (asked_hash is not None and last is not None and asked_hash != last):
            out.append((seq, "revision conflict", None))
        else:
            heads[root, role] = revision + 1, content
            keys[key] = digest, revision + 1
            keys.pop(None, None)
            out.append((seq, "accepted", revision + 1))
    return sorted(out)


def some(rng, seqs):
    return [(s, rng.choice("ab"), rng.choice(["x", "y"]), rng.choice([None, "k1", "k2", "k3", "k4", f"k{s}"]), rng.choice("pq"), f"h{rng.randrange(3)}", rng.choice([None, None, rng.randrange(6)]), rng.choice([None, None, None, f"h{rng.randrange(3)}"])) for s in seqs]


def plain(df):
    return sorted((r.seq, r.outcome, r.revision) for r in df.collect())


def test_outcomes_across_aggregates(spark):
    rng = random.Random(1)
    for n in (0, 1, 12, 60):
        rows = some(rng, rng.sample(range(1000), n))
        assert plain(commands.outcomes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_commits_go_on_from_the_log(spark, tmp_path):
    rng = random.Random(2)
    ledger, heads, keys = logs.Ledger(spark, f"file://{tmp_path}/log"), {}, {}
    assert ledger.version() == 0 and ledger.read().count() == 0
    for start in (0, 100, 200):
        rows = some(rng, range(start, start + 25))
        assert plain(commands.commit(ledger, spark.createDataFrame(rows, SCHEMA))) == brute(rows, heads, keys)
    tops = {(r.root, r.role): r.n for r in ledger.read().groupBy("root", "role").agg(F.max("revision").alias("n"), F.count("*").alias("m")).filter("n = m").collect()}
    assert ledger.version() == 3 and tops == {k: n for k, (n, _) in heads.items()}


def test_a_writer_that_comes_second_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    one, two = logs.Ledger(spark, path), logs.Ledger(spark, path)
    ask = lambda seq: spark.createDataFrame([(seq, "r", "agent", None, None, f"h{seq}", 0, None)], SCHEMA)
    seen = two.version()
    assert plain(commands.commit(one, ask(1))) == [(1, "accepted", 1)]
    event = one.read()
    assert not two.append(event, seen) and two.version() == 1 and two.read().count() == 1
    (tmp_path / "log" / "commits" / f"{2:020d}").write_text('{"number": 2, "folder": "taken"}')
    real = two.version
    two.version = lambda: 1  # the other writer publishes after this one has looked
    assert not two.append(event, 1)
    two.version = real
    (tmp_path / "log" / "commits" / f"{2:020d}").unlink()
    assert plain(commands.commit(two, ask(2))) == [(2, "revision conflict", None)]


def test_an_empty_command_is_accepted_with_a_warning(spark):
    judged = spark.createDataFrame([(1, "accepted"), (2, "accepted"), (3, "revision conflict")], "seq long, outcome string")
    got = commands.warned(judged, spark.createDataFrame([(1, 0), (2, 4), (3, 0)], "seq long, changes long"))
    assert {r.seq: r.warnings for r in got.collect()} == {1: ["no changes supplied; update was accepted as a no-op"], 2: [], 3: []}


def memory(seq, about, entries, **more):
    at = [("work", None, None, None, None, None, None, seq, None)]
    return (seq, about, [("work", "kind", None)], [(i, "claim", t, at) for i, t in entries], [], [], more.get("key"), more.get("asked"))


def test_write(spark, tmp_path):
    ledger = logs.Ledger(spark, f"file://{tmp_path}/log")
    shape = ingest.MEMORY.simpleString()[len("struct<") : -1] + ",idempotency_key:string,expected_revision:bigint"
    rows = [memory(1, "a", [(None, "The First Claim!")], key="ingest:1"), memory(2, "a", [("e2", "two")], asked=5), memory(3, " ", [("e3", "three")]), memory(4, "a", [(None, "日本")], key="ingest:1"), memory(5, "b", [("e5", "five")])]
    df = spark.createDataFrame(rows, ",".join(x for x in [shape]))
    assert {r.outcome for r in commands.write(ledger, df, dry_run=True)[0].collect()} == {"valid", "invalid"} and ledger.version() == 0
    out, made = commands.write(ledger, df)
    got = {r.seq: r for r in out.collect()}
    assert {s: r.outcome for s, r in got.items()} == {1: "accepted", 2: "revision conflict", 3: "invalid", 4: "key conflict", 5: "accepted"}
    assert got[1].memory_id == "memory:1" and got[3].errors == ["about is blank"] and got[5].entries == 1
    assert {r.node_id for r in made.filter("op = 'node'").collect()} == {"a", "b", "about:a:dimension:work", "about:b:dimension:work", "a:entry:claim:the-first-claim", "e5"}
    again, more = commands.write(ledger, df)
    assert {r.seq: r.outcome for r in again.collect()} == {1: "replayed", 2: "revision conflict", 3: "invalid", 4: "key conflict", 5: "replayed"} and more.isEmpty()


def test_keys_and_digests(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    key = lambda x: value(scalars.idempotency_key(F.lit(x)))
    assert key('{"b": 1, "a": {"y": 2, "x": [3]}}') == key('{"a":{"x":[3],"y":2},"b":1}') != key('{"a":{"x":[3],"y":2},"b":2}')
    assert key('{"a": 1, "options": {"dry_run": true, "s": 1}}') == key('{"options": {"s": 1}, "a": 1}') != key('{"a": 1}')
    digest = lambda m, p=None: value(scalars.logical_digest(F.lit("a"), F.lit(m), F.lit(p)))
    assert digest('{"x": 1, "y": 2}') == digest('{"y":2,"x":1}') != digest('{"y":2,"x":1}', '{"s": 1}')
    assert value(scalars.entry_ref(F.lit("a"), F.lit("k"), F.lit("日本"))).startswith("a:entry:k:") and len(value(scalars.short_hash(F.lit("x")))) == 16
