"""Operator 1: near-duplicate documents by one-permutation MinHash.

One hash of each shingle fills `bands * rows` bins with their smallest hash; an empty bin takes the value of the first
filled bin in an order of its own (optimal densification). Each band of bins gives a bucket. Documents with equal
shingle sets form a class, and only its smallest document goes on. In each bucket the class that shares most buckets
with others is the hub of a star, and its candidate edges to the others are confirmed on full sets. A bucket whose
members are then in one component is done, since links inside a component change nothing. In the others, pairs of
different components are left. What a member has and its hub lacks, or the other way round, is a small set, and two
members are linked exactly if those two sets overlap enough; pairs are found by the rarest elements of them, by a
prefix filter, and confirmed (_open_pairs). So no pair of a bucket that could join two components is left out. Copies,
and edited copies whose edits differ, give about an edge a member; where a group's edits are out of a common menu, its
rarest hashes are shared by many and the open pairs grow with the square of its members.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased. Null and empty texts have an empty set and
no links, as does a row whose doc_id is null: its component_id is its own doc_id, and kept is true. Rows that repeat a
doc_id are one document of several texts, linked if any of them is, and each row is returned. An empty table gives an
empty result. A text of any length is one set; hubs of equal rank are taken by the smaller doc_id. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words has its whole sequence as the one shingle."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes.lower() changes A-Z alone
    starts, ends = common.word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    hashes = common.word_hashes(data, starts, ends)
    return np.unique(common.gram_hashes(hashes, min(words, len(hashes))))


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """For each bin, the rank of every other bin in the order in which it would borrow."""
    rng = np.random.default_rng(7)
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Smallest hash of each bin, with empty bins densified."""
    mixed = common.mix(hashes ^ np.uint64(0xD1B54A32D192ED03))
    at = ((mixed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    out = np.full(bins, np.uint64(2**64 - 1))
    np.minimum.at(out, at.astype(np.int64), common.mix(mixed))
    filled = np.zeros(bins, bool)
    filled[at.astype(np.int64)] = True
    if not filled.all():
        have, lack = np.flatnonzero(filled), np.flatnonzero(~filled)
        out[lack] = out[have[_orders(bins)[lack][:, have].argmin(1)]]
    return out


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig.reshape(bands, -1)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(parts.shape[1]):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return out.view(np.int64)


def _class(hashes: bytes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


_SKETCH = "doc_id long, n_shingles long, class binary, bands array<long>"


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class (a digest of the set; null if empty) and bands of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, classes, sigs = [], [], []
        for text in batch.column(1).to_pylist():
            h = shingle_hashes(text, words)
            sizes.append(len(h))
            classes.append(_class(h.tobytes()) if len(h) else None)
            sigs.append(band_hashes(signature(h, bands * rows), bands) if len(h) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], schema=schema)

    return common.texts(docs).mapInArrow(common.by_batch(lambda: run), _SKETCH)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class and sorted shingle hashes of the wanted documents (doc_id, measured before they are broadcast)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, words).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["class", "hashes"])

    some = common.texts(docs).join(common.sized(wanted), "doc_id", "left_semi")
    return some.mapInArrow(common.by_batch(lambda: run), "class binary, hashes binary").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """a, b of the pairs (a, b, class_a, class_b) whose sets have 100 * intersection >= share * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= share * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("class").alias("class_a"), F.col("hashes").alias("hashes_a"))
    second = sets.select(F.col("class").alias("class_b"), F.col("hashes").alias("hashes_b"))
    both = pairs.join(second, "class_b").join(first, "class_a").select("a", "b", "hashes_a", "hashes_b")
    return both.mapInArrow(run, "a long, b long")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, node and diff (hashes that one of the two sets has and the other lacks) of the pairs (hub, node, class_h, class_x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), assume_unique=True) for x, y in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["hub", "node", "diff"])

    first = sets.select(F.col("class").alias("class_h"), F.col("hashes").alias("hashes_h"))
    second = sets.select(F.col("class").alias("class_x"), F.col("hashes").alias("hashes_x"))
    both = pairs.join(second, "class_x").join(first, "class_h").select("hub", "node", "hashes_h", "hashes_x")
    return both.mapInArrow(run, "hub long, node long, diff array<long>")


def _open_pairs(left: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, node_a, b, node_b) of different components that the stars leave possible.

    left: hub, class_h, node, doc_id, class, n, part of the members of buckets with several components. With D(x) the
    size of x's difference from the hub, x and y are linked exactly if their differences have at least
    (S(x) + S(y)) / (2 * (100 + share)) hashes in common, where S(x) = (100 + share) * D(x) - (100 - share) * n(x). No
    member has a smaller S than the hub, so two members that need nothing in common are both linked to the hub, and of
    all others those hashes bring them together: each member is found by its rarest ones, as many as must hold one of
    any sufficient overlap (a prefix filter). Hashes of one component alone count for nothing.
    """
    up, down = 100 + share, 100 - share
    measured = common.written(_differences(left.select("hub", "node", "class_h", F.col("class").alias("class_x")), sets).join(left.select("hub", "node", "doc_id", "n", "part"), ["hub", "node"]).withColumn("s", up * F.size("diff") - down * F.col("n")))
    flat = measured.select("hub", "node", "part", F.explode("diff").alias("hash"))
    live = flat.groupBy("hub", "hash").agg(F.count("*").alias("times"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("hub", "hash", "times")
    rare_first = F.transform(F.sort_array(F.collect_list(F.struct("times", "hash"))), lambda x: x["hash"])
    lists = flat.join(live, ["hub", "hash"]).groupBy("hub", "node").agg(rare_first.alias("rare"))
    best = measured.groupBy("hub").agg(F.min(F.struct("s", "part")).alias("best"), F.max("n").alias("most_n"))
    second = measured.join(best, "hub").filter("part <> best.part").groupBy("hub").agg(F.min("s").alias("second"))
    other = F.when(F.col("part") == F.col("best.part"), F.col("second")).otherwise(F.col("best.s"))
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + other) / (2 * up)), F.ceil((F.col("s") - down * F.col("most_n")) / up)).cast("int")
    known = measured.select("hub", "node", "doc_id", "part", "s").join(lists, ["hub", "node"]).join(best.join(second, "hub"), "hub").withColumn("need", need).filter(F.size("rare") >= F.col("need"))
    keys = common.written(known.select("hub", "node", "doc_id", "part", "s", F.size("rare").alias("live"), F.explode(F.slice("rare", F.lit(1), F.size("rare") - F.col("need") + 1)).alias("hash")))
    side = lambda x: keys.select("hub", "hash", F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "part", "s", "live")))
    enough = 2 * up * F.least("live_a", "live_b") >= F.col("s_a") + F.col("s_b")
    return side("a").join(side("b"), ["hub", "hash"]).filter((F.col("part_a") < F.col("part_b")) & enough).select("a", "node_a", "b", "node_b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, of edges (a, b).

    Each round gives a node's label to its neighbours and then follows labels to their own labels, so that rounds grow
    with the logarithm of a component's width. Every round is written to the shared folder.
    """
    both = common.written(edges.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.filter("a <> b").select("b", "a")).distinct())
    labels = common.written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = common.written(lower.join(jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")))
        if moved.filter("old <> label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links have a similarity of share percent or more."""
    found = common.written(sketches(docs, words, bands, rows))
    real = found.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    reps = real.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    firsts = real.join(reps, ["class", "doc_id"], "left_semi").dropDuplicates(["class"])
    # A band's number is part of its hash, so the hash names the bucket; `node` names a class in eight bytes.
    buckets = firsts.select("doc_id", F.xxhash64("class").alias("node"), F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = common.written(buckets.join(shared, "bucket"))
    known = common.written(members.groupBy("doc_id", "node").agg(F.sum("size").alias("central"), F.first("n").alias("n")))
    classes = firsts.select("doc_id", F.xxhash64("class").alias("node"), "class").join(known, ["doc_id", "node"])
    classes = common.written(classes)
    # The hub is the member that shares most buckets with others: in a group of edited copies, the one nearest to all.
    hub = members.join(known.select("doc_id", "node", "central"), ["doc_id", "node"]).groupBy("bucket").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("less"), "doc_id", "node", "n")).alias("h"))
    fits = 100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")
    star = members.join(hub, "bucket").select(F.col("h.doc_id").alias("a"), F.col("h.node").alias("node_a"), F.col("h.n").alias("n_a"), F.col("doc_id").alias("b"), F.col("node").alias("node_b"), F.col("n").alias("n_b"))
    pairs = star.filter(((F.col("a") != F.col("b")) | (F.col("node_a") != F.col("node_b"))) & fits).select("a", "node_a", "b", "node_b").distinct()
    sets = common.written(_sets(docs, known.select("doc_id").distinct(), words))

    def confirmed(some: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("node").alias(f"node_{x}"), F.col("class").alias(f"class_{x}"))
        return _confirmed(some.join(side("a"), ["a", "node_a"]).join(side("b"), ["b", "node_b"]).select("a", "b", "class_a", "class_b"), sets, share)

    links = common.written(confirmed(pairs))
    labels = components(links)
    # Buckets whose members are still in several components: pairs whose differences from the hub overlap enough.
    part = labels.withColumnRenamed("node", "doc_id")
    named = members.join(part, "doc_id", "left").select("bucket", "doc_id", "node", "n", F.coalesce("label", "doc_id").alias("part"))
    mixed = named.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("bucket")
    centres = hub.join(mixed, "bucket").select("bucket", F.col("h.node").alias("hub"), F.col("h.doc_id").alias("hub_doc"))
    left = common.written(named.join(centres, "bucket").select("hub", "hub_doc", "doc_id", "node", "n", "part").distinct())
    if not left.isEmpty():
        of_hub = classes.select(F.col("doc_id").alias("hub_doc"), F.col("node").alias("hub"), F.col("class").alias("class_h"))
        more = _open_pairs(left.join(classes.select("doc_id", "node", "class"), ["doc_id", "node"]).join(of_hub, ["hub", "hub_doc"]), sets, share)
        found_more = common.written(confirmed(more))
        links = links.union(found_more)
        if not found_more.isEmpty():
            labels = components(links)
    own = real.select("class", "doc_id").distinct()
    if not own.groupBy("doc_id").count().filter("count > 1").isEmpty():
        # A doc_id of several texts joins their classes.
        same = own.join(reps.select("class", F.col("doc_id").alias("rep")), "class").filter("doc_id <> rep")
        every = links.union(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
        to = components(every).withColumnRenamed("node", "doc_id")
        named = found.join(to, "doc_id", "left")
    else:
        named = found.join(reps.select("class", F.col("doc_id").alias("rep")), "class", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("label", "doc_id"), F.lit(True)).alias("kept"))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=3, share=85, rows=8)


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(node, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN edges e ON r.other = e.a)
  SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN reach r ON s.doc_id = r.node
"""
