"""Operator 6: benchmark decontamination by a BM25 index of test items.

Every text is cut into passages of words that overlap by half, twice as long as the longest item, so that an item's
text lies whole in one of them. A passage queries the inverted index of the items. Postings lie in blocks of items, and
a block keeps each term's largest impact in it. Block-max WAND: of a passage's terms in the order of their largest
impacts, those before the pivot cannot reach the threshold together, so only the pivot and the terms behind it open
blocks; in those the others are looked up, and only blocks whose sum of largest impacts reaches the threshold are
scored. All passages of a slice are searched side by side. So every item at or above the threshold is retrieved. Impacts are BM25 weights over the item's own
score, so that an item's whole text scores 1. A retrieved item counts as a leak if enough of the word shingles of its
question, and of its answer, stand in the passage.

Words are lower-cased runs of characters other than white space and ASCII punctuation. An item has columns question and
answer, or its text is split: the last sentence is the answer, or the last quarter of the words of a single sentence.
Null and empty texts have no passages, null and empty items are never found; a null doc_id is kept. Rows that repeat a
doc_id each give their leaks, and equal result rows are returned once; items that repeat are found each. Empty tables
give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words, in order."""
    data = np.frombuffer((text or "").lower().encode().translate(_TO_SPACE), np.uint8)
    return common.word_hashes(data, *common.word_spans(data))


def question_and_answer(text: str) -> tuple[str, str]:
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    at = len(words) - len(words) // 4
    return " ".join(words[:at]), " ".join(words[at:])


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(common.gram_hashes(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


@dataclass
class Lists:
    """Arrays of one type, one after the other."""

    first: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, parts: Iterable[np.ndarray]) -> Lists:
        parts = list(parts)
        return cls(np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]), np.concatenate([*parts, np.empty(0, np.uint64)]))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]


@dataclass
class Index:
    """Inverted index of a group of items: postings by term and item, in blocks of items with each term's largest impact."""

    items: list[int | None]
    questions: Lists
    answers: Lists
    terms: np.ndarray
    term_most: np.ndarray  # a term's largest impact
    blocks: int
    block_key: np.ndarray  # term * blocks + block of every block that has postings, ascending
    block_most: np.ndarray
    block_first: np.ndarray  # its first posting; the next one's ends it
    term_first: np.ndarray  # a term's first block
    item: np.ndarray
    impact: np.ndarray

    @classmethod
    def build(cls, items: list[int | None], questions: Lists, answers: Lists, term: np.ndarray, item: np.ndarray, impact: np.ndarray, block_items: int) -> Index:
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        terms, which = np.unique(term, return_inverse=True)
        blocks = len(items) // block_items + 1
        key = which * blocks + item // block_items
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        most = np.maximum.reduceat(impact, starts) if len(key) else np.empty(0)
        first = np.searchsorted(key[starts], np.arange(len(terms) + 1) * blocks)
        term_most = np.maximum.reduceat(most, first[:-1]) if len(terms) else np.empty(0)
        return cls(items, questions, answers, terms, term_most, blocks, key[starts], most, np.append(starts, len(key)), first, item, impact)

    def search(self, windows: np.ndarray, terms: np.ndarray, least: float, at_once: int = 500_000) -> Iterator[tuple[int, int, float]]:
        """(window, item position, score) of all that reach the threshold; windows and terms are distinct pairs, by window."""
        order = np.lexsort((self.term_most[terms], windows))
        w, t = windows[order], terms[order]
        if not len(w):
            return
        # The terms of least weight that together stay below the threshold find no item: a window's pivot is the first
        # term with which they could reach it, and only that and the following ones open blocks.
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        sums = np.cumsum(self.term_most[t])
        sums -= np.repeat(sums[starts] - self.term_most[t[starts]], np.diff(np.append(starts, len(w))))
        opens = sums >= least - 1e-6  # the running sums are rounded
        size = np.where(opens, self.term_first[t + 1] - self.term_first[t], 0)
        done = np.cumsum(size)
        for a, b in _cuts(starts, len(w), done, at_once):
            yield from self._search(w[a:b], t[a:b], opens[a:b], least)

    def _search(self, w: np.ndarray, t: np.ndarray, opens: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
        names, first, which = np.unique(w, return_index=True, return_inverse=True)
        last = np.append(first[1:], len(w))
        below = np.bincount(which[~opens], self.term_most[t[~opens]], len(names))
        pair, entry = _spread(self.term_first, t[opens])
        if not len(pair):
            return
        key, where = np.unique(which[opens][pair] * self.blocks + self.block_key[entry] % self.blocks, return_inverse=True)
        bound = np.bincount(where, self.block_most[entry])
        on = bound + below[key // self.blocks] >= least - 1e-9
        key, bound = key[on], bound[on]
        # Blocks that are still possible: the terms before the pivot are looked up in those alone.
        pivot = first + np.bincount(which[~opens], minlength=len(names))
        row, pair = _ranges(first[key // self.blocks], pivot[key // self.blocks])
        entry, found = self._entries(t[pair], key[row] % self.blocks)
        bound += np.bincount(row[found], self.block_most[entry], len(key))
        key = key[bound >= least - 1e-9]
        row, pair = _ranges(first[key // self.blocks], last[key // self.blocks])
        entry, found = self._entries(t[pair], key[row] % self.blocks)
        at, posting = _spread(self.block_first, entry)
        pairs, where = np.unique(key[row[found][at]] // self.blocks * len(self.items) + self.item[posting], return_inverse=True)
        score = np.bincount(where, self.impact[posting], len(pairs))
        for k in np.flatnonzero(score >= least - 1e-9).tolist():
            yield int(names[pairs[k] // len(self.items)]), int(pairs[k] % len(self.items)), float(score[k])

    def _entries(self, terms: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block entries of those terms and blocks that have one, and which those are."""
        key = terms * self.blocks + blocks
        at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        found = np.flatnonzero(self.block_key[at] == key)
        return at[found], found


def _cuts(starts: np.ndarray, n: int, done: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole windows with about at_once block entries each, and no more than a fifth as many terms."""
    a = 0
    while a < n:
        before = done[a - 1] if a else 0
        end = min(int(np.searchsorted(done, before + at_once, side="right")), a + at_once // 5)
        k = int(np.searchsorted(starts, end, side="right")) - 1
        b = n if end >= n else int(starts[k])
        if b <= a:  # one window is more
            b = int(starts[k + 1]) if k + 1 < len(starts) else n
        yield a, b
        a = b


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low to high: the number of the range and the place, of all their places."""
    counts = high - low
    row = np.repeat(np.arange(len(low)), counts)
    return row, np.arange(len(row)) + np.repeat(low - np.cumsum(counts) + counts, counts)


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists that start at first[r], first[r + 1] apart: the place in rows and the entry, of all their entries."""
    return _ranges(first[rows], first[rows + 1])


def _impacts(items: DataFrame, k1: float, b: float) -> DataFrame:
    """row, item_id, question, answer and the terms' hashes and impacts of each item; statistics cover all items."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, q, a, text in zip(*(c.to_pylist() for c in batch.columns)):
                if q is None and a is None:
                    q, a = question_and_answer(text or "")
                whole = words_of(f"{q or ''}\n{a or ''}")
                if len(whole):
                    terms, tf = np.unique(whole, return_counts=True)
                    out.append((key, q, a, len(whole), terms.view(np.int64).tolist(), tf.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["item_id", "question", "answer", "size", "terms", "tf"])

    has = {c.lower() for c in items.columns}
    side = lambda c: F.col(c).cast("string").alias(c) if c in has else F.lit(None).cast("string").alias(c)
    read = items.select(F.col("item_id").cast("long").alias("item_id"), side("question"), side("answer"), side("text"))
    split_items = common.written(read.mapInArrow(split, "item_id long, question string, answer string, size long, terms array<long>, tf array<long>").withColumn("row", F.monotonically_increasing_id()))
    stats = split_items.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    flat = split_items.select("row", "size", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("row", "size", "x.terms", "x.tf")
    df = flat.groupBy("terms").agg(F.count("*").alias("df"))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / (stats.mean or 1.0)))
    lists = flat.join(df, "terms").groupBy("row").agg(F.collect_list(F.struct(F.col("terms").alias("term"), weight.alias("w"))).alias("ws"))
    return common.written(split_items.select("row", "item_id", "question", "answer", "size").join(lists, "row"))


def leaks(docs: DataFrame, items: DataFrame, *, least: float = 0.5, question: float = 0.6, answer: float = 0.5, shingle: int = 5, k1: float = 1.2, b: float = 0.75, block_items: int = 16, index_items: int = 50_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leak (best passage of each pair).

    An index is sent to the tasks for each index_items items, so its size is bounded; more items take more passes.
    """
    table = _impacts(items, k1, b)
    n = table.count()
    longest = (table.agg(F.max("size")).first()[0] or 1) if n else 1
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    groups = -(-n // index_items)
    for g in range(groups):
        rows = table.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).orderBy("row").toArrow()
        if not rows.num_rows:
            continue
        ws = rows["ws"].combine_chunks()
        item = np.repeat(np.arange(len(ws)), np.diff(ws.offsets.to_numpy()))
        flat = ws.flatten()
        term, impact = flat.field("term").to_numpy().view(np.uint64), flat.field("w").to_numpy()
        impact = impact / np.bincount(item, impact, len(ws))[item]
        grams = lambda c: Lists.of(_grams(words_of(x), shingle) for x in rows[c].to_pylist())
        index = Index.build(rows["item_id"].to_pylist(), grams("question"), grams("answer"), term, item, impact, block_items)
        out = out.union(_query(docs, index, 2 * longest, least, question, answer, shingle))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("question_overlap", "answer_overlap", "score")).alias("x")).select("doc_id", "item_id", "x.score", "x.question_overlap", "x.answer_overlap")


def _query(docs: DataFrame, index: Index, width: int, least: float, question: float, answer: float, shingle: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    step = max(1, width // 2)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def overlap(grams: np.ndarray, of: np.ndarray) -> float:
        if not len(of):
            return 1.0
        return float(np.isin(of, grams).mean())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ix = shared.value
        ids, texts = batch.column(0).to_pylist(), [words_of(t) for t in batch.column(1).to_pylist()]
        sizes = np.array([len(w) for w in texts], np.int64)
        words = np.concatenate(texts) if len(texts) else np.empty(0, np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        n_steps = np.maximum(-(-sizes // step), 1)  # half passages; the last full one ends a text
        base = np.concatenate([[0], np.cumsum(n_steps)])
        found = []
        if len(words) and len(ix.terms):
            term = np.minimum(np.searchsorted(ix.terms, words), len(ix.terms) - 1)
            at = np.flatnonzero(ix.terms[term] == words)
            doc = np.searchsorted(starts, at, side="right") - 1
            half = base[doc] + (at - starts[doc]) // step
            # A word is in the passage that starts with its half, and in the one before.
            earlier = half > base[doc]
            pairs = np.unique(np.concatenate([half * len(ix.terms) + term[at], (half[earlier] - 1) * len(ix.terms) + term[at][earlier]]))
            for window, item, score in ix.search(pairs // len(ix.terms), pairs % len(ix.terms), least):
                d = int(np.searchsorted(base, window, side="right") - 1)
                a = (window - int(base[d])) * step
                part = texts[d][a : a + width]
                q, r = ix.questions[item], ix.answers[item]
                # Sides shorter than a shingle are one shingle of their own length.
                by = {k: common.gram_hashes(part, k) for k in range(1, shingle + 1)} if min(len(q), len(r)) <= 1 else {shingle: common.gram_hashes(part, shingle)}
                grams = np.concatenate(list(by.values()))
                x, y = overlap(grams, q), overlap(grams, r)
                if x >= question and y >= answer:
                    found.append((ids[d], ix.items[item], score, x, y))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(schema)], schema=schema)

    return common.texts(docs).mapInArrow(common.by_batch(lambda: run, 1 << 20), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
