"""Event logs, bundles, snapshots, journals and corpora as files (IO5 to IO17)."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([T.StructField("sequence", T.LongType()), T.StructField("root", T.StringType()), T.StructField("role", T.StringType()), T.StructField("revision", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("idempotency_key", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("logical_digest", T.StringType())])
#: The bundle format that this version reads and writes.
FORMAT = 1


class Ledger:
    """IO5: a log whose batches are published one by one, each under the next version, so that a writer that has judged its
    batch against an older version can not add it.

    A batch's rows are written to a folder of their own, which no reader looks at before the version's manifest names it.
    The manifest is a small file made only if there is none of its number yet; the file system must refuse to create a
    file that exists, in one step, as HDFS does. A writer that fails on the way leaves a folder that is never named.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of published batches."""
        folder = self._at("commits")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0) if self._fs.exists(folder) else 0

    def read(self, version: int | None = None) -> DataFrame:
        """IO6: the events of the first so many versions, or of all."""
        last = self.version() if version is None else version
        if not last:
            return self.spark.createDataFrame([], LOG)
        names = self.spark.read.schema("number long, folder string").json([str(self._at(f"commits/{n:020d}")) for n in range(1, last + 1)])
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/data/{r.folder}" for r in names.collect()))

    def append(self, events: DataFrame, version: int) -> bool:
        """Publishes events as the batch after `version`; False, and nothing changes, if that batch is already there."""
        if self.version() != version:
            return False
        folder = uuid.uuid4().hex
        events.select([F.col(f.name).cast(f.dataType) for f in LOG]).write.parquet(f"{self.path}/data/{folder}")
        try:
            out = self._fs.create(self._at(f"commits/{version + 1:020d}"), False)
        except Py4JJavaError as error:
            if self._fs.exists(self._at(f"commits/{version + 1:020d}")):
                return False
            raise error
        out.write(bytearray(json.dumps({"number": version + 1, "folder": folder}).encode()))
        out.close()
        return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """IO6: a log without versions; callers order by sequence where they need an order."""
    return spark.read.schema(LOG).parquet(path)


def export_bundle(log: DataFrame, path: str) -> None:
    """IO7: JSON lines; the header is a file of its own in the same folder, with the number of events."""
    head = log.agg(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.count("*").alias("events"))).alias("value"))
    head.coalesce(1).write.text(f"{path}/header")
    log.select(F.to_json(F.struct(*LOG.names)).alias("value")).write.text(f"{path}/events")


def import_bundle(spark: SparkSession, path: str) -> DataFrame:
    """IO8: the events of a bundle; fails on another format, on broken lines, lost events and gaps in revisions."""
    head = spark.read.schema("format int, events long").option("mode", "FAILFAST").json(f"{path}/header").first()
    if head is None or head["format"] != FORMAT:
        raise ValueError(f"bundle format {head and head['format']}, not {FORMAT}")
    log = spark.read.schema(LOG).option("mode", "FAILFAST").json(f"{path}/events")
    if log.count() != head["events"]:
        raise ValueError("the bundle's events are not as many as its header says")
    gaps = log.groupBy("root", "role").agg(F.count("*").alias("n"), F.count_distinct("revision").alias("d"), F.min("revision").alias("a"), F.max("revision").alias("z")).filter("a <> 1 or z <> n or d <> n")
    if not gaps.isEmpty():
        raise ValueError("revisions have gaps or repeat")
    return log


def save_snapshot(bundles: DataFrame, path: str, ttl_seconds: int) -> None:
    """IO10: bundles (root, role, ...) with the time they expire."""
    bundles.withColumn("expires_at", F.current_timestamp() + F.make_dt_interval(secs=F.lit(ttl_seconds))).write.mode("append").partitionBy("role").parquet(path)


def live_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("expires_at") > F.current_timestamp())


def journal(entries: DataFrame, since=None, until=None, limit: int | None = None) -> DataFrame:
    """IO15: entries (at, seq) of a time range; with a limit the latest of them, oldest first."""
    if since is not None:
        entries = entries.filter(F.col("at") >= F.lit(since))
    if until is not None:
        entries = entries.filter(F.col("at") < F.lit(until))
    return entries.orderBy(F.desc("at"), F.desc("seq")).limit(limit).orderBy("at", "seq") if limit else entries


def retained(entries: DataFrame, most: int) -> DataFrame:
    """IO16: the latest entries of a journal, by a top-k that keeps no more than `most` in a task."""
    return entries.orderBy(F.desc("at"), F.desc("seq")).limit(most)


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """IO17: the same rows in fewer files."""
    spark.read.parquet(source).coalesce(files).write.parquet(target)


TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_answer", T.BooleanType())])
DIALOGUES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question_id", "question_type", "question", "answer", "question_date")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("haystack_session_ids", "haystack_dates", "answer_session_ids")]
    + [T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(TURN)))]
)


def dialogue_turns(spark: SparkSession, path: str) -> DataFrame:
    """IO14, P13: a row for each turn of each session of a dialogue corpus (a JSON array), with the session's date."""
    items = spark.read.schema(DIALOGUES).option("multiLine", True).json(path)
    sessions = items.select("question_id", "question_type", "question", "answer", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session", "s"))
    turns = sessions.select("question_id", "question_type", "question", "answer", "session", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return turns.select("question_id", "question_type", "question", "answer", "session", "session_id", "date", "turn", "t.role", "t.content", "t.has_answer")
