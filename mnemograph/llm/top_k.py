"""Operator 2: exact top-k by inner product with a pivot table.

Vectors lie in blocks, each with the table of its vectors' distances to all pivots. For a query, the largest difference
of its own distance to a pivot and a vector's is a lower bound of the distance between the two, and with the two norms
an upper bound of the inner product. A block's vectors are evaluated in the order of that bound, until the next bound
is below the query's k-th best score so far. Every block of queries meets every block of vectors once; each meeting
leaves at most k rows a query, and a window over those gives the result.

Null vectors and those with a null, NaN or infinite component take no part. Only vectors of equal length are compared;
empty ones score 0. Of rows that repeat a vec_id, none is a candidate for a query of that vec_id; as candidates of
others, equal ones count once. Scores beyond 64 bits are returned as the nearest 64-bit integer. A null vec_id takes no part. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

_INT64 = 2**63 - 1


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): as float64 where inner products are exact in it, else as Python integers."""
    y = np.floor(x * scale)
    most = np.abs(y).max(initial=0.0)
    if most * most * max(1, y.shape[1]) < 2**52:
        return y
    return np.array([[int(c) for c in row] for row in y.tolist()], object).reshape(y.shape)


def _blocks(vectors: DataFrame, rows: int, slots: int, name: str) -> DataFrame:
    """Blocks of vectors of one length: dim, slot, ids and components (as doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            ids, body = np.array([i for i, _ in part], np.int64), np.array([x for _, x in part], float)
            slot = int(common.mix(np.array([ids[0] ^ dim ^ len(part)], np.int64).view(np.uint64))[0] % np.uint64(slots))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "slot": pa.array([slot], pa.int32()), name + "_ids": pa.array([ids.tobytes()], pa.binary()), name: pa.array([body.tobytes()], pa.binary())})

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) >= rows:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(run, f"dim int, slot int, {name}_ids binary, {name} binary")


class Searcher:
    """Meets blocks of queries with blocks of vectors, and keeps each query's k-th best score from one to the next."""

    def __init__(self, pivots: np.ndarray, k: int, scale: float):
        self.pivots, self.k, self.scale = pivots, k, scale
        self.least: dict[tuple[int, bytes], int] = {}
        self.evaluated = self.met = 0

    def table(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms, and distances to the pivots and to the origin."""
        y = x.astype(float)
        p = self.pivots if self.pivots.shape[1] == y.shape[1] else np.empty((0, y.shape[1]))
        p = np.concatenate([p, np.zeros((1, y.shape[1]))])
        square = (y * y).sum(1)
        d = square[:, None] + (p * p).sum(1)[None, :] - 2 * (y @ p.T)
        return square, np.sqrt(np.maximum(d, 0))

    def meet(self, q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query, vector, score) of each query's best k in this block that its earlier blocks leave possible."""
        v_square, v_table = self.table(v)
        q_square, q_table = self.table(q)
        for i, query in enumerate(q_ids.tolist()):
            lower = np.abs(v_table - q_table[i]).max(1)
            span = q_square[i] + v_square
            # Half and a billionth more than the rounding of distances can take off.
            upper = (span - lower * lower) / 2 + 0.5 + 1e-7 * (span + 1)
            name = query, q[i].tobytes() if q.dtype != object else repr(q[i].tolist()).encode()
            least, best, at, step = self.least.get(name), [], 0, max(64, 4 * self.k)
            order = np.argsort(-upper, kind="stable")
            while at < len(order) and (least is None or upper[order[at]] >= least):
                part = order[at : at + step]
                if least is not None:
                    part = part[upper[part] >= least]
                scores = v[part] @ q[i]
                self.evaluated += len(part)
                ids = v_ids[part]
                fit = ids != query
                if least is not None:
                    fit &= scores >= least
                best += zip((-scores[fit]).tolist(), ids[fit].tolist())
                best = sorted({(int(s), n) for s, n in best})[: self.k]
                if len(best) == self.k:
                    least = -best[-1][0] if least is None else max(least, -best[-1][0])
                at += step
                step *= 2
            self.met += len(order)
            if least is not None:
                self.least[name] = least
            yield from ((query, n, max(-_INT64 - 1, min(_INT64, -s))) for s, n in best)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, pivots: int = 32, block: int = 1024, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of floor(scale * x); ties to the smaller vec_id.

    vectors and queries have vec_id and v (usable). Pivots are the vectors of the most usual length with the smallest
    hashes; only they reach the driver.
    """
    spark = vectors.sparkSession
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = [r.v for r in vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(pivots).collect()]
    dims = [len(x) for x in chosen]
    usual = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    table = whole(np.array([x for x in chosen if len(x) == usual], float), scale).astype(float) if usual else np.empty((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(table, k, scale)
        read: dict[str, tuple[bytes, np.ndarray]] = {}

        def ints(side: str, raw: bytes, dim: int) -> np.ndarray:
            if side not in read or read[side][0] != raw:
                read[side] = raw, whole(np.frombuffer(raw).reshape(-1, dim), scale)
            return read[side][1]

        for batch in batches:
            for dim, q_ids, q, v_ids, v in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, v_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(v_ids, np.int64)
                a = ints("q", q, dim) if dim else np.zeros((len(q_ids), 0))
                b = ints("v", v, dim) if dim else np.zeros((len(v_ids), 0))
                if a.dtype != b.dtype or a.dtype != object and np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, dim) >= 2**52:
                    a, b = (np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape) for x in (a, b))
                found = list(searcher.meet(q_ids, a, v_ids, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    v = _blocks(vectors, block, slots, "v")
    q = _blocks(queries, query_block, slots, "q").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    found = q.join(v, ["slot", "dim"]).select("dim", "q_ids", "q", "v_ids", "v").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
