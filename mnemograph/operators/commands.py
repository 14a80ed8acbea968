"""The command log: outcomes of commands against a log's heads, and writes that retry when another writer was first.

commands: seq, root, role, idempotency_key, digest (of what the caller said), content_hash (of the changes), and where
they ask for them expected_revision and expected_content_hash. An aggregate is a root with a role. Of two commands the one
with the smaller seq is first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from mnemograph.functions import scalars
from mnemograph.operators import ingest
from mnemograph.operators.graph import _kept as kept
from mnemograph.sources import logs

COMMAND = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("root", "role", "idempotency_key", "digest", "content_hash")]
    + [T.StructField("expected_revision", T.LongType()), T.StructField("expected_content_hash", T.StringType())]
)
_AGGREGATE = ["root", "role"]


def shaped(commands: DataFrame) -> DataFrame:
    """commands with the columns of COMMAND; one that is missing is null, a missing digest is the content hash."""
    have = set(commands.columns)
    columns = {f.name: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType) for f in COMMAND}
    columns["digest"] = F.coalesce(columns["digest"], columns["content_hash"])
    return commands.select(*(c.alias(n) for n, c in columns.items()))


def _judged(asked: DataFrame) -> DataFrame:
    """seq, outcome and revision of commands (COMMAND with from_revision and from_hash, what the log has for their
    aggregate, local: their key where no other aggregate uses it, and final: whether it is that key's last command).

    A command is judged by what the ones before it in its aggregate have left, so each aggregate is one ordered pass. It
    holds the revision and the hash of the last accepted command, and accepted local keys until their last command. No
    built-in window has such a state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aggregate = revision = last = None
        held: dict[str, tuple[str, int]] = {}
        for batch in batches:
            seqs, found, revisions = [], [], []
            for root, role, seq, expected, expected_hash, own, start, start_hash, key, digest, final in zip(*(c.to_pylist() for c in batch.columns)):
                if aggregate != (root, role):
                    aggregate, revision, last, held = (root, role), start, start_hash, {}
                first = held.get(key) if key is not None else None
                if first is not None:
                    outcome, at = ("replayed", first[1]) if first[0] == digest else ("key conflict", None)
                elif (expected is None or expected == revision) and (expected_hash is None or last is None or expected_hash == last):
                    revision, last = revision + 1, own
                    outcome, at = "accepted", revision
                    if key is not None:
                        held[key] = digest, revision
                else:
                    outcome, at = "revision conflict", None
                if final:
                    held.pop(key, None)
                seqs.append(seq)
                found.append(outcome)
                revisions.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(found, pa.string()), pa.array(revisions, pa.int64())], names=["seq", "outcome", "revision"])

    columns = [*_AGGREGATE, "seq", "expected_revision", "expected_content_hash", "content_hash", "from_revision", "from_hash", "local", "digest", "final"]
    dealt = asked.select(*columns).repartition(*_AGGREGATE).sortWithinPartitions(*_AGGREGATE, "seq")
    return dealt.mapInArrow(run, "seq long, outcome string, revision long")


def outcomes(commands: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """P5: seq, root, role, outcome and revision of each command, after all that is in the log.

    A key that the log has, or that an earlier command was accepted with, makes a command 'replayed' (same digest; with
    the revision of the first) or a 'key conflict'. Keys are not bound to an aggregate. Any other command is refused as a
    'revision conflict' unless its expected revision and content hash, where it has them, are the current ones, or
    'accepted' and raises the revision. A refused command leaves its key free. Where several aggregates use a key, which
    command owns it depends on outcomes elsewhere: passes over all commands are repeated until none changes; each settles
    at least the first command that was wrong. Passes are written to the checkpoint folder.
    """
    asked = shaped(commands)
    if log is None:
        based = asked.withColumns({"from_revision": F.lit(0).cast("long"), "from_hash": F.lit(None).cast("string")})
        known = None
    else:
        of_batch = log.join(asked.select(*_AGGREGATE).distinct(), _AGGREGATE, "left_semi")
        heads = of_batch.groupBy(*_AGGREGATE).agg(F.max("revision").alias("from_revision"), F.max_by("content_hash", "revision").alias("from_hash"))
        based = asked.join(heads, _AGGREGATE, "left").fillna({"from_revision": 0})
        known = log.filter("idempotency_key is not null").select("idempotency_key", F.coalesce("logical_digest", "content_hash").alias("first_digest"), F.col("revision").alias("first_revision"))
    based = kept(based)
    keyed = based.filter("idempotency_key is not null")
    if known is not None:
        stored = kept(keyed.join(known, "idempotency_key").select("seq", "first_digest", "first_revision"))
        open_ = kept(based.join(stored, "seq", "left_anti"))
    else:
        stored, open_ = None, based
    same_key = Window.partitionBy("idempotency_key")
    named = open_.filter("idempotency_key is not null").withColumns({"wide": F.min(F.struct(*_AGGREGATE)).over(same_key) != F.max(F.struct(*_AGGREGATE)).over(same_key), "final": F.max("seq").over(same_key) == F.col("seq")})
    every = kept(named.unionByName(open_.filter("idempotency_key is null"), allowMissingColumns=True).withColumn("local", F.when(~F.col("wide"), F.col("idempotency_key"))).fillna({"wide": False, "final": False}))
    wide = every.filter("wide").select("seq", "idempotency_key")
    refused = every.select("seq").limit(0)
    while True:
        # The owner of a wide key is its first command that the last pass has not refused; it and those before it are judged.
        owned = wide.join(refused.withColumn("lost", F.lit(True)), "seq", "left").groupBy("idempotency_key").agg(F.min(F.when(F.col("lost").isNull(), F.col("seq"))).alias("owner"))
        late = wide.join(owned, "idempotency_key").filter("seq > owner").select("seq")
        judged = kept(_judged(every.join(late, "seq", "left_anti")))
        now = judged.filter("outcome = 'revision conflict'").join(wide.select("seq"), "seq", "left_semi").select("seq")
        changed = now.join(refused, "seq", "left_anti").unionByName(refused.join(now, "seq", "left_anti"))
        if changed.isEmpty():
            break
        refused = now
    owners = judged.filter("outcome = 'accepted'").join(every.filter("wide"), "seq").select("idempotency_key", F.col("digest").alias("first_digest"), F.col("revision").alias("first_revision"))
    rest = wide.join(judged, "seq", "left_anti").join(owners, "idempotency_key").select("seq", "first_digest", "first_revision")
    repeats = rest if stored is None else rest.unionByName(stored)
    same = based.select("seq", "digest").join(repeats, "seq").withColumn("same", F.col("digest").eqNullSafe(F.col("first_digest")))
    again = same.select("seq", F.when(F.col("same"), "replayed").otherwise("key conflict").alias("outcome"), F.when(F.col("same"), F.col("first_revision")).alias("revision"))
    return asked.select("seq", *_AGGREGATE).join(judged.unionByName(again), "seq")


def commit(ledger: logs.Ledger, commands: DataFrame, payload: DataFrame | None = None, tries: int = 10) -> DataFrame:
    """V15, IO5: judges commands against the log, and appends the accepted ones, in one commit that is published once.

    If another writer has published in between, the commands are judged again against the log as it is then; so no two
    writers raise the same revision. payload: seq and payload of the events. Fails after so many lost races.
    """
    asked = kept(shaped(commands))
    for _ in range(tries):
        version = ledger.version()
        judged = kept(outcomes(asked, ledger.read(version) if version else None))
        accepted = judged.filter("outcome = 'accepted'").join(asked.drop(*_AGGREGATE), "seq")
        texts = accepted.join(payload, "seq", "left") if payload is not None else accepted.withColumn("payload", F.lit(None).cast("string"))
        events = texts.select(F.col("seq").alias("sequence"), "root", "role", "revision", "content_hash", "idempotency_key", "payload", F.col("digest").alias("logical_digest"))
        if ledger.append(events, version):
            return judged
    raise RuntimeError(f"another writer was first {tries} times")


def warned(judged: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcomes with warnings; an accepted command without changes (seq, changes) raised the revision and did nothing else."""
    empty = (F.col("outcome") == "accepted") & (F.coalesce("changes", F.lit(0)) == 0)
    text = F.when(empty, F.lit("no changes supplied; update was accepted as a no-op"))
    return judged.join(changes.select("seq", "changes"), "seq", "left").withColumn("warnings", F.array_compact(F.array(text))).drop("changes")


def write(ledger: logs.Ledger, memories: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """V1: outcomes of memories (ingest.MEMORY and idempotency_key, expected_revision where they have them) and the mutations
    of the accepted ones.

    Outcomes: seq, about, memory_id, outcome, revision, entries, relations, evidence, warnings, errors. A memory with
    faults (P7) is 'invalid' and asks for nothing; a dry run judges nothing and writes nothing ('valid'). An entry
    without an id gets one of its text, a memory without a key one of its contents (S13).
    """
    have = set(memories.columns)
    named = memories.withColumn("entries", F.transform("entries", lambda e: e.withField("id", F.coalesce(F.nullif(F.trim(e["id"]), F.lit("")), scalars.entry_ref(F.col("about"), e["kind"], e["text"])))))
    said = F.to_json(F.struct("about", "dimensions", "entries", "relations", "evidence"))
    key = F.coalesce(F.nullif(F.trim("idempotency_key"), F.lit("")) if "idempotency_key" in have else F.lit(None), scalars.idempotency_key(said))
    asked = F.col("expected_revision") if "expected_revision" in have else F.lit(None).cast("long")
    digest = scalars.logical_digest(F.col("about"), F.to_json(F.struct("dimensions", "entries", "relations", "evidence")), F.lit(None))
    judged = kept(ingest.faults(named).withColumns({"key": key, "digest": digest, "asked": asked}))
    sizes = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c) for c in ("entries", "relations", "evidence")]
    base = judged.select("seq", "about", scalars.memory_id(F.col("key")).alias("memory_id"), *sizes, "errors")
    good = judged.filter(F.size("errors") == 0)
    if dry_run:
        found = good.select("seq", F.lit("valid").alias("outcome"), F.lit(None).cast("long").alias("revision"))
        accepted = good.limit(0)
    else:
        commands = good.select("seq", F.col("about").alias("root"), F.lit("memory").alias("role"), F.col("key").alias("idempotency_key"), "digest", F.col("digest").alias("content_hash"), F.col("asked").alias("expected_revision"))
        found = commit(ledger, commands, good.select("seq", said.alias("payload"))).select("seq", "outcome", "revision")
        accepted = good.join(found.filter("outcome = 'accepted'").select("seq"), "seq", "left_semi")
    dry = F.lit("dry_run=true; validated memory without writing to the kernel") if dry_run else F.lit(None).cast("string")
    warnings = F.array_compact(F.array(dry))
    out = base.join(found, "seq", "left").withColumn("outcome", F.coalesce("outcome", F.lit("invalid")))
    return out.select("seq", "about", "memory_id", "outcome", "revision", "entries", "relations", "evidence", warnings.alias("warnings"), "errors"), ingest.mutations(accepted.select(*ingest.MEMORY.names))
