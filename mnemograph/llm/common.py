"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a side that a join may broadcast; larger sides are shuffled.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Has Spark cut the batches that it sends to Python by bytes too, where the session does not say how; texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most_bytes))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that the text operators read; any other columns are pruned from the scan."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir; where it is unset and the master is local, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        base = f"file://{tempfile.mkdtemp(prefix='mnemograph-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/mnemograph-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing that was written."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sized(df: DataFrame, payload: str = "0", limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast only if its rows, measured now, are within the limit; payload: SQL for a row's bytes besides its keys."""
    found = df.agg(F.count("*").alias("n"), F.sum(F.expr(payload)).alias("b")).first()
    return F.broadcast(df) if 32 * found.n + (found.b or 0) <= limit else df


def chunks(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about so many bytes each; a longer text stands alone."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    yield start, len(sizes)


_KEPT: dict[tuple, object] = {}


def forget() -> None:
    """Drops what this worker keeps of other stages than the task's; every Python task of an operator begins with it."""
    task = TaskContext.get()
    for key in [k for k in _KEPT if task is None or k[0] != task.stageId()]:
        del _KEPT[key]


def kept(make: Callable, *args: str) -> object:
    """make(*args), called once by a worker for all its tasks of a stage."""
    forget()
    task = TaskContext.get()
    key = (task.stageId() if task else None, make.__qualname__, *args)
    if key not in _KEPT:
        _KEPT[key] = make(*args)
    return _KEPT[key]


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], most_bytes: int = 2 << 20) -> Callable:
    """A function for mapInArrow that calls make() once in each task, and what it returns for each slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        f = make()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b in chunks(batch.column(at), most_bytes) if at >= 0 else [(0, batch.num_rows)]:
                yield f(batch.slice(a, b - a))
        pa.default_memory_pool().release_unused()  # the worker may stay for other tasks

    return run


#: An odd multiplier for polynomial hashes modulo 2^64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09 to 0x0D."""
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", _INVERSE, n + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words, in order."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + words[i : len(words) - k + 1 + i])
    return out
