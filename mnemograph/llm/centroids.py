"""Operator 11: k-means over integer vectors with a VA-file.

Every vector is written once, whole and as an approximation: one cell number of few bits for each dimension. A round
reads the approximations alone (the whole vectors are another column, which the scan leaves out). Tables of each
dimension, cell and centroid hold the least and the most that a value of that cell can add to the distance, so that
their sums are an interval for each centroid. What all centroids have in common, the squared distance to the mean of
the centroids, is left out of both ends, which makes the intervals narrow. Whole vectors are fetched, by a join on the
row's number, only where intervals overlap or where the interval alone says that a vector moves; moved vectors change
the sums of two clusters. Only those sums, a row for each centroid, reach the driver. Rounds end early if no vector
moves, since all later ones would be the same. The first and the last assignment read all vectors, for the sums and the
distances.

Cell borders come from at most `fit_rows` vectors, the ones with the smallest hashes: borders lie dense where the square
root of the density is high, which makes the mean width of cells least. The outermost borders are the exact least and
greatest value of all vectors, so every interval is certain. Ties go to the smaller centroid; all sums and distances are
exact integers.

A vector that is null, of another length, or with a null, NaN or infinite component takes no part. A row without a vec_id
is assigned like any other, but is no first centroid. Rows that repeat a vec_id are vectors of their own; between equal
hashes the smaller vector is first. Fewer vectors than k give as many centroids. Components beyond 10^24 after scaling
count as 10^24, and distances beyond 64 bits as the greatest 64-bit integer. An empty table gives an empty result.
Other columns are not read. A task holds one batch and its tables (dimensions x cells x 2 k numbers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_INT64 = 2**63 - 1
_MOST = 1e24
_WHOLE = pa.decimal128(38, 0)


def usable(vectors: DataFrame, dims: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v of the rows whose vector has so many finite components."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.filter(F.col("v").isNotNull() & (F.size("v") == dims)).filter(good)


def _floors(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a batch of vectors, as doubles, which hold such integers exactly."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(x * scale), -_MOST, _MOST)


def packed(y: np.ndarray) -> list[bytes]:
    """Rows as 32-bit integers where those hold them, else as doubles; the length tells which."""
    small = np.abs(y).max(1, initial=0.0) < 2**31
    return [(row.astype(np.int32) if fits else row).tobytes() for row, fits in zip(y, small)]


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    kinds = {4 * dims: np.int32, 8 * dims: np.float64}
    if all(len(r) == 4 * dims for r in rows):
        return np.frombuffer(b"".join(rows), np.int32).reshape(-1, dims).astype(float)
    return np.array([np.frombuffer(r, kinds[len(r)]).astype(float) for r in rows]).reshape(-1, dims)


def cell_borders(sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> np.ndarray:
    """cells + 1 borders of each dimension: dims rows, ascending, from its low to its high."""
    grid = np.quantile(sample, np.linspace(0, 1, 129), axis=0).T
    out = np.empty((len(low), cells + 1))
    for d, points in enumerate(grid):
        points = np.concatenate([[low[d]], points, [high[d]]])
        weight = np.concatenate([[0.0], np.cumsum(np.sqrt(np.maximum(np.diff(points), 0)))])
        out[d] = np.interp(np.linspace(0, weight[-1], cells + 1), weight, points) if weight[-1] else low[d]
        out[d, 0], out[d, -1] = low[d], high[d]
    return np.maximum.accumulate(out, axis=1)


def cell_numbers(y: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(b[1:-1], y[:, d], side="right") for d, b in enumerate(borders)], 1).astype(np.uint8)


class Tables:
    """Intervals of distances from cells, and exact distances, to a list of integer centroids."""

    def __init__(self, borders: np.ndarray, centroids: list[list[int]]):
        self.exact = centroids
        c = np.array(centroids, float)
        mean = c.mean(0)
        u = (c - mean).T[:, None, :]
        left, right = (-2 * (b - mean[:, None])[:, :, None] * u for b in (borders[:, :-1], borders[:, 1:]))
        self.k = len(centroids)
        self.tables = np.concatenate([np.minimum(left, right) + u * u, np.maximum(left, right) + u * u], 2)
        # More than the rounding of the sums can take off.
        self.slack = 1e-12 * ((np.abs(borders).max(1) + np.abs(mean)) * (np.abs(c) + np.abs(mean))).sum(1) + 1e-6

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each row, the centroids whose interval begins no higher than the least end of any."""
        total = np.zeros((len(cells), 2 * self.k))
        for d, table in enumerate(self.tables):
            total += table[cells[:, d]]
        return total[:, : self.k] - self.slack <= (total[:, self.k :] + self.slack).min(1)[:, None]

    def nearest(self, y: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The nearest of each row's candidates and its exact squared distance."""
        most = np.abs(y).max(initial=0.0) + max((abs(x) for c in self.exact for x in c), default=0)
        kind = float if most * most * max(1, y.shape[1]) < 2**53 else object
        y = y if kind is float else np.array([[int(x) for x in row] for row in y.tolist()], object).reshape(y.shape)
        best = np.full(len(y), np.inf if kind is float else None, kind)
        at = np.full(len(y), -1, np.int32)
        for k, c in enumerate(self.exact):
            rows = np.flatnonzero(fit[:, k])
            d = ((y[rows] - np.array(c, kind)) ** 2).sum(1)
            nearer = (at[rows] < 0) | (d < np.where(at[rows] < 0, d, best[rows]))
            best[rows[nearer]], at[rows[nearer]] = d[nearer], k
        return at, [int(x) for x in best.tolist()]


class Sums:
    """Changes of clusters' counts and sums, as exact integers."""

    def __init__(self, dims: int):
        self.dims, self.held = dims, {}

    def add(self, cluster: np.ndarray, y: np.ndarray, sign: int) -> None:
        exact = np.abs(y).max(initial=0.0) * max(1, len(y)) < 2**53
        for k in np.unique(cluster[cluster >= 0]).tolist():
            part = y[cluster == k]
            total = [int(x) for x in part.sum(0).tolist()] if exact else [sum(int(x) for x in column) for column in part.T.tolist()]
            count, old = self.held.get(k, (0, [0] * self.dims))
            self.held[k] = count + sign * len(part), [a + sign * b for a, b in zip(old, total)]

    def rows(self) -> list[tuple[int, int, list[Decimal]]]:
        return [(k, n, [Decimal(x) for x in total]) for k, (n, total) in self.held.items()]


_RESOLVED = "key long, cells binary, cluster int, n long, total array<decimal(38,0)>"
_RESOLVED_ARROW = pa.schema([("key", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(_WHOLE))])


def _resolver(borders: np.ndarray, centroids: list[list[int]]) -> Callable:
    """key, cells and cluster of rows (key, cells, old, v), and after them rows of a task's changes: n and total of a cluster."""
    dims = len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = Tables(borders, centroids), Sums(dims)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = unpacked(batch.column(3).to_pylist(), dims)
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, dims)
            old = batch.column(2).to_numpy(zero_copy_only=False)
            new, _ = tables.nearest(y, tables.candidates(cells))
            moved = old != new
            sums.add(old[moved], y[moved], -1)
            sums.add(new[moved], y[moved], 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(_WHOLE))], schema=_RESOLVED_ARROW)
        changes = sums.rows()
        n = len(changes)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([k for k, _, _ in changes], pa.int32()), pa.array([c for _, c, _ in changes], pa.int64()), pa.array([t for _, _, t in changes], pa.list_(_WHOLE))], schema=_RESOLVED_ARROW)

    return run


def _scanner(borders: np.ndarray, centroids: list[list[int]]) -> Callable:
    """Rows (key, cells, cluster) with `fetch`: whether the intervals overlap, or name another cluster."""
    dims = len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(borders, centroids)
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, dims)
            fit = tables.candidates(cells)
            fetch = (fit.sum(1) > 1) | (fit.argmax(1) != batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fetch)], names=["key", "cells", "cluster", "fetch"])

    return run


def _finisher(borders: np.ndarray, centroids: list[list[int]]) -> Callable:
    """vec_id, cluster and distance of rows (vec_id, cells, v)."""
    dims = len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(borders, centroids)
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, dims)
            at, far = tables.nearest(unpacked(batch.column(2).to_pylist(), dims), tables.candidates(cells))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array([min(x, _INT64) for x in far], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def _bounds(vectors: DataFrame, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The least and greatest component of each dimension; none without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                y = _floors(batch.column(0), dims, scale)
                low = y.min(0) if low is None else np.minimum(low, y.min(0))
                high = y.max(0) if high is None else np.maximum(high, y.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], names=["pos", "low", "high"])

    found = vectors.select("v").mapInArrow(run, "pos int, low double, high double").groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    rows = sorted(found, key=lambda r: r.pos)
    return (np.array([r.low for r in rows]), np.array([r.high for r in rows])) if rows else None


class Clustering:
    """The VA-file of a table of vectors in the shared folder, and the rounds over it.

    fetched and scanned count, over the rounds after the first, the whole vectors that were fetched and the approximations read.
    """

    def __init__(self, vectors: DataFrame, dims: int, scale: float, bits: int, fit_rows: int):
        if not 1 <= bits <= 8:
            raise ValueError("a cell has 1 to 8 bits")
        self.spark, self.dims, self.scale = vectors.sparkSession, dims, scale
        self.fetched = self.scanned = 0
        bounds = _bounds(vectors, dims, scale)
        self.empty = bounds is None
        if bounds is None:
            return
        sample = np.array([r.v for r in vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(fit_rows).collect()])
        self.borders = borders = cell_borders(np.clip(np.floor(sample * scale), -_MOST, _MOST), *bounds, 1 << bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = _floors(batch.column(1), dims, scale)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in cell_numbers(y, borders)], pa.binary()), pa.array(packed(y), pa.binary())], names=["vec_id", "cells", "v"])

        self.file = common.written(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cells binary, v binary").withColumn("key", F.monotonically_increasing_id()))

    def first(self, vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
        name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
        rows = vectors.filter(F.col("vec_id").isNotNull()).orderBy(name, "v").limit(k).collect()
        return [[int(x) for x in np.clip(np.floor(np.array(r.v) * self.scale), -_MOST, _MOST).tolist()] for r in rows]

    def moved(self, rows: DataFrame, centroids: list[list[int]], path: str) -> tuple[DataFrame, list]:
        """rows (key, cells, cluster, v) with their nearest centroids, written to path, and the changes of the clusters' sums."""
        rows.select("key", "cells", F.col("cluster").cast("int").alias("old"), "v").mapInArrow(_resolver(self.borders, centroids), _RESOLVED).write.parquet(path)
        out = self.spark.read.schema(_RESOLVED).parquet(path)
        totals = [F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(self.dims)]
        changes = out.filter("key is null").groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect()
        return out.filter("key is not null").select("key", "cells", "cluster"), changes

    def rounds(self, centroids: list[list[int]], most: int) -> list[list[int]]:
        """The centroids after so many rounds of assignment and update."""
        counts, sums = [0] * len(centroids), [[0] * self.dims for _ in centroids]
        state, old_paths = None, []
        for nth in range(most):
            folder = common.shared_dir(self.spark)
            if state is None:
                state, changes = self.moved(self.file.withColumn("cluster", F.lit(-1)), centroids, f"{folder}/moved")
            else:
                state.mapInArrow(_scanner(self.borders, centroids), "key long, cells binary, cluster int, fetch boolean").write.parquet(f"{folder}/scanned")
                scanned = self.spark.read.schema("key long, cells binary, cluster int, fetch boolean").parquet(f"{folder}/scanned")
                wanted = scanned.filter("fetch").drop("fetch")
                tally = scanned.agg(F.count("*").alias("n"), F.count_if("fetch").alias("f")).first()
                self.scanned, self.fetched = self.scanned + tally.n, self.fetched + tally.f
                fetched = common.sized(wanted, f"{self.dims} + 8").join(self.file.select("key", "v"), "key")
                found, changes = self.moved(fetched, centroids, f"{folder}/moved")
                state = scanned.filter("not fetch").drop("fetch").union(found)
                for path in old_paths:  # the state is now the two tables of this round
                    common._remove(self.spark, path)
            old_paths = [folder]
            if not changes:
                return centroids
            for c in changes:
                counts[c.cluster] += c.n
                sums[c.cluster] = [a + int(c[f"t{d}"]) for d, a in enumerate(sums[c.cluster])]
            centroids = [[x // n for x in s] if n else old for n, s, old in zip(counts, sums, centroids)]
        return centroids


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, dims: int = 64, bits: int = 8, fit_rows: int = 4096, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector (vec_id, v)."""
    spark = vectors.sparkSession
    made = Clustering(vectors, dims, scale, bits, fit_rows)
    start = [] if made.empty else made.first(vectors, k, salt)
    if not start:
        return spark.createDataFrame([], _RESULT)
    centroids = made.rounds(start, rounds)
    placed = common.written(made.file.select("vec_id", "cells", "v").mapInArrow(_finisher(made.borders, centroids), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(inertia.values()), _INT64)
    rows = [(i, min(inertia.get(i, 0), _INT64), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(usable(common.table(spark, sf_dir, "embeddings"), 64))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same as SQL: a level of assignment and of centroids for each round."""
    head = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))"""
    for r in range(rounds + 1):
        head += f""",
a{r} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.row, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i])))::BIGINT AS d FROM v, c{r} k) GROUP BY row)"""
        if r < rounds:
            head += f""",
s{r} AS MATERIALIZED (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.c, generate_subscripts(v.e, 1) AS i, unnest(v.e) AS x FROM a{r} a JOIN v ON a.row = v.row) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.e, k.e) AS e
  FROM c{r} k LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY c) m ON k.c = m.c)"""
    return (
        head
        + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON a.row = v.row JOIN c{rounds} k ON a.c = k.c
"""
    )


OP11_SQL = _sql()
