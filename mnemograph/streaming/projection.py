"""Projection streams: deduplicated, routed, folded and kept up to date (P4, P9, IO11 to IO13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mnemograph.operators import projection

ENVELOPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event_id", "correlation_id", "causation_id")]
    + [T.StructField("occurred_at", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("aggregate_id", "aggregate_type", "schema_version", "subject", "data")]
    + [T.StructField("seq", T.LongType())]
)


def events(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """IO11: a stream of envelopes from files; other sources give the same columns."""
    return spark.readStream.schema(ENVELOPE).format(form).load(path)


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once while its repeats come within the delay, so that state stays bounded."""
    return stream.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def project(stream: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each batch's mutations to a folder of its own, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        projection.mutations(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_model(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """Nodes, edges and details after all batches so far; replaying the log gives the same."""
    return projection.fold(spark.read.parquet(target).drop("batch"))


def _published(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the parts in a folder that were written to their end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    at = hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in names if "=" in n and fs.exists(hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def _state(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame | None:
    """The latest snapshot and the runs behind it, up to a batch or all: a row for each key in each of these parts."""
    below = lambda numbers: [n for n in numbers if upto is None or n <= upto]
    snapshots = below(_published(spark, f"{target}/snapshots"))
    last = snapshots[-1] if snapshots else -1
    parts = ([f"{target}/snapshots/upto={last}"] if snapshots else []) + [f"{target}/runs/batch={n}" for n in below(_published(spark, f"{target}/runs")) if n > last]
    return spark.read.parquet(*parts) if parts else None


def maintain(stream: DataFrame, target: str, checkpoint: str, every: int = 8, **trigger) -> StreamingQuery:
    """P9, IO13: a projection that goes on: keeps the folded state, and tells which roots each batch has changed.

    A batch is folded to the last mutation of each of its keys, a run of its own. After `every` batches the runs since the
    last snapshot are merged with it into the next one, so a read merges one snapshot and a few runs, and not the
    history. The larger seq wins wherever it comes, so late events and batches in any order give what a replay gives. A
    batch that runs again writes the same parts in the same places. Notices lie in outbound/batch=n, as JSON.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        projection.latest(projection.mutations(batch)).write.mode("overwrite").parquet(f"{target}/runs/batch={number}")
        run = spark.read.parquet(f"{target}/runs/batch={number}")
        model = projection.latest(_state(spark, target, number))
        projection.outbound(model, run).write.mode("overwrite").json(f"{target}/outbound/batch={number}")
        if number % every == every - 1:
            before = _state(spark, target, number - 1)  # not from the snapshot that a first try may have left
            merged = run if before is None else before.unionByName(run)
            projection.latest(merged).write.mode("overwrite").parquet(f"{target}/snapshots/upto={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintained(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """Nodes, edges and details of a maintained projection, as of its last whole batch."""
    state = _state(spark, target)
    if state is None:
        raise ValueError("no batch has been projected yet")
    return projection.fold(state)


def counted(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events of each subject in windows of event time; late ones count within the delay."""
    return stream.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", width).alias("w"), "subject").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "subject", "events")
