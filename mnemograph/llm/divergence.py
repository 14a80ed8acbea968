"""Operator 12: how far the sources of a language differ in their terms, by single-pass in-memory indexing.

Each task reads documents once, in blocks that fill the memory meant for them. A block's postings, the documents of each
term of a language and its count in each source, leave as a run in the order of terms, and the next block starts anew.
The runs are rows of a shuffle by a hash of (lang, term): in each shard Spark's sorter merges the runs it was sent, by a heap over
sorted pieces on disk, and one pass over them in that order adds up equal terms and drops those in too few documents. So
a hot language, source or term costs a row for each run that has it, and no task holds more than one term's sources.

A term that no two sources have is like any other that both lack: each pair of sources starts from the value of such a
term times the number of terms, and the pass over the merged terms streams only corrections, for pairs of which at
least one source has the term. They are summed in a task before they are shuffled.

Null text, lang and source are ''. Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z in lower case. A group
without terms has count 0 for every kept term; a language without kept terms has V = 0, pairs of value 0 and no terms. A
source alone in its language has no pairs. Rows are documents whatever their doc_id, which is not read, and repeated rows
count as often as they occur. Equal values rank by the bytes of the item. An empty table gives an empty result. All
arithmetic is exact. What a task holds of the languages' sources grows with the sources of one language, as the result,
a row for each pair of them, does with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed value: the p of a term is 1 + floor(UNIT * (count + 1) / (N + V)).
UNIT = 1_000_000_000
_RUN = "lang string, term string, docs long, sources array<string>, counts array<long>"
_RUN_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _ranked(values: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """The sorted dictionary, and each value's place in it."""
    order = pc.sort_indices(values.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return values.dictionary.take(order), rank[values.indices.to_numpy()]


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column of texts, as UTF-8 with A-Z in lower case, and the row of each. Every byte of a character
    beyond ASCII is over 0x7F."""
    raw = pa.concat_arrays([texts.cast(pa.binary())])
    at = np.frombuffer(raw.buffers()[1], np.int32)[: len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[: at[-1]]
    data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    solid = np.concatenate([[False], ((data >= 97) & (data <= 122)) | (data >= 128), [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid[1:-1]])])
    return found, np.searchsorted(at, starts, side="right") - 1


def postings(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """A run of the documents (lang, source, text): rows of _RUN in the order of (lang, term)."""
    columns = [pa.concat_arrays(c.chunks) for c in block.columns]
    found, row = tokens(columns[2])
    if not len(found):
        return
    terms, term = _ranked(found.dictionary_encode())
    langs, lang = _ranked(columns[0].dictionary_encode())
    sources, source = _ranked(columns[1].dictionary_encode())
    pairs, n = np.unique(row * len(terms) + term, return_counts=True)  # a document's terms
    row, term = pairs // len(terms), pairs % len(terms)
    keys, at = np.unique((lang[row] * len(terms) + term) * len(sources) + source[row], return_inverse=True)
    counts = np.bincount(at, n).astype(np.int64)
    own, first = np.unique(keys // len(sources), return_index=True)
    docs = np.add.reduceat(np.bincount(at), first)
    ends = np.append(first[1:], len(keys))
    for i in range(0, len(own), 20_000):
        part = slice(i, i + 20_000)
        low, high = first[i], ends[part][-1]
        offsets = pa.array(np.append(first[part], high) - low, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (sources.take(pa.array(keys[low:high] % len(sources))), pa.array(counts[low:high]))]
        names = langs.take(pa.array(own[part] // len(terms))), terms.take(pa.array(own[part] % len(terms))).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*names, pa.array(docs[part], pa.int64()), *lists], schema=_RUN_ARROW)


def _indexer(most_bytes: int) -> Callable:
    """Runs of the blocks that fill the memory meant for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            if batch.num_rows:
                block.append(batch)
                held += batch.nbytes
            if held > most_bytes:
                yield from postings(pa.Table.from_batches(block))
                block, held = [], 0
        if block:
            yield from postings(pa.Table.from_batches(block))
        pa.default_memory_pool().release_unused()

    return run


def _merger(least_docs: int) -> Callable:
    """One row for each kept term of a language, of rows of runs in the order of (lang, term): its sources and counts."""
    schema = pa.schema([f for f in _RUN_ARROW if f.name != "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, docs, counts = None, 0, {}

        def done() -> None:
            if key is not None and docs >= least_docs:
                out.append((*key, list(counts), list(counts.values())))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for lang, term, d, sources, ns in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (lang, term):
                    done()
                    key, docs, counts = (lang, term), d, dict(zip(sources, ns))
                else:
                    docs += d
                    for source, n in zip(sources, ns):
                        counts[source] = counts.get(source, 0) + n
            if len(out) >= 2_000:
                yield batch_of()
                out = []
        done()
        yield batch_of()

    return run


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are at most UNIT + 1, so the square fits."""
    return (p - q) ** 2 // q


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b and the sum, over terms that source a or b of the language has, of a term's value less that of a term that both lack.

    Rows: lang, at and counts of a term's sources (their places among the language's), totals (N + V of each of them).
    """
    held: dict[str, tuple] = {}

    def spilled() -> Iterator[pa.RecordBatch]:
        for lang, (_, _, _, sums) in held.items():
            a, b = np.nonzero(sums)
            for i in range(0, len(a), 100_000):
                x, y = a[i : i + 100_000], b[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(sums[x, y], pa.int64())], names=["lang", "a", "b", "more"])

    def add(lang: str, terms: list[tuple[list[int], list[int]]]) -> None:
        totals, p0, base, sums = held[lang]
        if len(p0) <= 64:  # few sources: a block of terms at once
            p = np.repeat(p0[None, :], len(terms), 0)
            for row, (at, counts) in zip(p, terms):
                row[at] = [1 + UNIT * (c + 1) // totals[i] for i, c in zip(at, counts)]
            for a in range(len(p0)):
                sums[a] += excess(p[:, a, None], p).sum(0) - len(terms) * base[a]
            return
        for at, counts in terms:
            here = np.array(at, np.int64)
            own = np.array([1 + UNIT * (c + 1) // totals[i] for i, c in zip(at, counts)], np.int64)
            p = p0.copy()
            p[here] = own
            sums[here] += excess(own[:, None], p[None, :]) - base[here]
            rest = np.setdiff1d(np.arange(len(p0)), here)
            sums[np.ix_(rest, here)] += excess(p0[rest][:, None], own[None, :]) - base[np.ix_(rest, here)]

    for batch in batches:
        blocks: dict[str, list] = {}
        langs = batch.column(0).to_pylist()
        for i, (lang, at, counts) in enumerate(zip(langs, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if lang not in held:
                if sum(x[3].size for x in held.values()) > 4_000_000:
                    for name, terms in blocks.items():
                        add(name, terms)
                    yield from spilled()
                    held, blocks = {}, {}
                totals = batch.column(3)[i].as_py()
                p0 = np.array([1 + UNIT // t for t in totals], np.int64)
                held[lang] = totals, p0, excess(p0[:, None], p0[None, :]), np.zeros((len(p0), len(p0)), np.int64)
            blocks.setdefault(lang, []).append((at, counts))
        for name, terms in blocks.items():
            add(name, terms)
    yield from spilled()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total); whole-number division of decimals is exact."""
    return _div(F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(18,0)"), total.cast("decimal(18,0)")) + 1


def kept_terms(docs: DataFrame, least_docs: int = 3, most_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Written tables: lang, term, sources and counts of every kept term; lang, source and n (kept occurrences) of every group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    common.bounded_batches(docs.sparkSession)
    runs = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_indexer(most_bytes), _RUN)
    shards = runs.repartition("lang", "term").sortWithinPartitions("lang", "term")
    terms = common.written(shards.mapInArrow(_merger(least_docs), "lang string, term string, sources array<string>, counts array<long>"))
    found = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    every = docs.select(text("lang"), text("source")).distinct()
    groups = common.written(every.join(found, ["lang", "source"], "left").fillna({"n": 0}))
    return terms, groups


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for each source the other sources of its language by divergence (part 'pair'),
    and its most excessive terms against the language (part 'term', the first `top`)."""
    terms, groups = kept_terms(docs, least_docs)
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("source", "n")))
    langs = groups.groupBy("lang").agg(ordered.alias("gs"), F.sum("n").alias("n")).join(sizes, "lang", "left").fillna({"v": 0})
    langs = common.written(langs.select("lang", "v", "n", F.transform("gs", lambda g: g["source"]).alias("every"), F.transform("gs", lambda g: g["n"] + F.col("v")).alias("totals")))
    known = common.sized(langs, "coalesce(array_size(every), 0) * 64")
    placed = terms.join(known, "lang")

    at = F.transform("sources", lambda s: (F.array_position("every", s) - 1).cast("int"))
    more = placed.select("lang", at.alias("at"), "counts", "totals").mapInArrow(_corrections, "lang string, a int, b int, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    side = lambda x: langs.select("lang", "v", F.posexplode(F.arrays_zip("every", "totals")).alias(x, f"x_{x}"))
    pairs = side("a").join(side("b").drop("v"), "lang").filter("a <> b").join(more, ["lang", "a", "b"], "left")
    lacks = lambda total: _div(F.lit(UNIT).cast("long"), F.greatest(total, F.lit(1).cast("long"))) + 1
    both = pairs.select("lang", F.col("x_a.every").alias("source"), F.col("x_b.every").alias("item"), "v", "more", lacks(F.col("x_a.totals")).alias("p"), lacks(F.col("x_b.totals")).alias("q"))
    far = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    value = F.when(F.col("v") > 0, F.col("v") * far + F.coalesce("more", F.lit(0))).otherwise(0)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "source", "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(order))

    totals = common.sized(groups.join(sizes, "lang").select("lang", "source", (F.col("n") + F.col("v")).alias("own")), "length(lang) + length(source)")
    wholes = common.sized(langs.select("lang", (F.col("n") + F.col("v")).alias("whole")), "length(lang)")
    spread = terms.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("count"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    joined = spread.select("lang", "term", "count", F.col("x.sources").alias("source"), F.col("x.counts").alias("n")).join(totals, ["lang", "source"]).join(wholes, "lang")
    shared = joined.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("own")).alias("p"), _share(F.col("count"), F.col("whole")).alias("q"))
    over = shared.filter("p > q").select("lang", "source", "item", far.alias("value"))
    term = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pair, "pair").union(columns(term, "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
hits AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM hits GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM hits JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(c.n, 0)::HUGEINT AS n, coalesce(s.v, 0)::HUGEINT AS v
  FROM groups g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source
  LEFT JOIN sizes s ON s.lang = g.lang),
grid AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + t.v) AS p
  FROM totals t JOIN kept k ON k.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
whole AS (
  SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // (any_value(t.n) + any_value(s.v)) AS q
  FROM counts c JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) t USING (lang) JOIN sizes s USING (lang) GROUP BY c.lang, c.term),
terms AS (
  SELECT g.lang, g.source, g.term AS item, (((g.p - w.q) * (g.p - w.q)) // w.q)::BIGINT AS value
  FROM grid g JOIN whole w ON w.lang = g.lang AND w.term = g.term WHERE g.n > 0 AND g.p > w.q),
ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
