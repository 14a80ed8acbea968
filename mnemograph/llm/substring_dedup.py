"""Operator 9: passages that repeat across documents, by an FM-index of each shard.

A window of `words` words is a row of symbols, each the hash of a fifth of its own number of words; a text position's
next symbol starts so many words on. A shard's FM-index is the Burrows-Wheeler transform of its segments in a wavelet
matrix with packed bits and block counts. Backward search over it finds every window of the shard's segments, and a
window is repeated if the smallest position in its suffix-array interval is not its own.

All occurrences of a window meet in one shard: a window's minimiser is the smallest hash of its six-word runs, and the
words around runs of windows with one minimiser are sent to the minimiser's shard. Only minimisers that occur twice
take part. A task sends equal segments once and reports their copies itself, and a shard indexes equal segments once.
A minimiser whose segments may hold more words than an index, as at the borders of a passage that many documents hold,
has its windows sent one by one, each to the shard of its own hash: equal windows share it, and no shard outgrows an index.
Words stand in segments as 40-bit hashes, next to the 64-bit hash of the minimiser.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D. Null and empty texts have no words. A row whose doc_id is
null keeps all its words and makes none repeated. Rows that repeat a doc_id and its text are one document, each
returned; different texts of one doc_id are documents in the order of a hash. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words in a run from which minimisers are taken.
RUN = 6


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level of packed bits for each bit of the symbols, with counts by block of 64."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.n, self.levels, s = len(sequence), [], sequence
        for b in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (s >> b) & 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            zeros = self.n - int(bit.sum())
            self.levels.append((b, packed, counts, zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of the prefixes of length `at` on the level below the last; a difference of two is a rank."""
        for b, packed, counts, zeros in self.levels:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> b) & 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """Backward search for patterns of up to `depth` symbols over sequences whose next symbol stands `step` behind.

    symbols are 0 to n - 1; following[i] is whether position i + step belongs to the same sequence.
    """

    def __init__(self, symbols: np.ndarray, following: np.ndarray, step: int, depth: int = 4):
        n = len(symbols)
        self.n_symbols = int(symbols.max(initial=0)) + 1
        rank, size = symbols.astype(np.int64) + 1, 1
        follows = following
        while size < depth:  # ranks of suffixes by their first `size` symbols
            ahead = np.zeros(n, np.int64)
            at = np.flatnonzero(follows)
            ahead[at] = rank[at + size * step]
            _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
            rank = rank + 1
            far = np.zeros(n, bool)
            far[at] = follows[at + size * step]
            follows, size = far, 2 * size
        self.positions = np.argsort(rank, kind="stable")
        before = np.zeros(n, np.int64)
        at = np.flatnonzero(following)
        before[at + step] = symbols[at] + 1  # 0: nothing stands before
        self._tree = WaveletMatrix(before[self.positions], self.n_symbols + 1)
        counts = np.bincount(symbols, minlength=self.n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        ends = np.bincount(symbols[~following], minlength=self.n_symbols)
        # A symbol at a sequence's end sorts before the same symbol with others behind it.
        self._base = self.first[:-1] + ends - self._tree.walk(np.arange(1, self.n_symbols + 1), np.zeros(self.n_symbols, np.int64))

    def intervals(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals of patterns given as one array for each place; searches from the last place on."""
        low, high = self.first[patterns[-1]], self.first[patterns[-1] + 1]
        for symbol in patterns[-2::-1]:
            base = self._base[symbol]
            low, high = base + self._tree.walk(symbol + 1, low), base + self._tree.walk(symbol + 1, high)
        return low, high


def repeated(segments: list[np.ndarray], words: int) -> list[np.ndarray]:
    """For each segment (word hashes, in order of precedence), whether each of its windows also starts earlier."""
    step = words // 4
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.concatenate(segments)
    start = np.concatenate([[0], np.cumsum(sizes)])
    segment = np.repeat(np.arange(len(segments)), sizes)
    left = start[segment + 1] - np.arange(len(text))  # words from here to the segment's end
    grams = common.gram_hashes(text, step)
    at = np.flatnonzero(left[: len(grams)] >= step)
    place = np.full(len(text) + words, -1)
    place[at] = np.arange(len(at))
    _, symbol = np.unique(grams[at], return_inverse=True)
    # Positions with a symbol keep their order; only the last step - 1 words of a segment have none.
    following = left[at] >= 2 * step
    dense = np.zeros(len(text), np.int64)
    dense[at] = symbol
    index = _spaced(dense, left, step, following, at)
    windows = np.flatnonzero(left >= words)
    low, high = index.intervals([dense[windows + k * step] for k in range(4)])
    distinct, where = np.unique(low, return_inverse=True)
    ends = np.empty_like(distinct)
    ends[where] = high
    cuts = np.stack([distinct, ends], 1).ravel()
    padded = np.append(index.positions, np.iinfo(np.int64).max)
    earliest = np.minimum.reduceat(padded, cuts)[::2] if len(cuts) else np.empty(0, np.int64)
    later = earliest[where] < windows
    out, n = [], np.maximum(sizes - words + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(bounds[:-1], bounds[1:]):
        out.append(later[a:b])
    return out


def _spaced(dense: np.ndarray, left: np.ndarray, step: int, following: np.ndarray, at: np.ndarray) -> FmIndex:
    """The index over all positions; those without a symbol get one of their own that no window has."""
    symbols = dense.copy()
    none = np.ones(len(dense), bool)
    none[at] = False
    symbols[none] = dense.max(initial=0) + 1
    follows = np.zeros(len(dense), bool)
    follows[at] = following
    return FmIndex(symbols, follows, step)


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have, size = x, 1
    while 2 * size <= w:
        have, size = np.minimum(have[:-size], have[size:]), 2 * size
    return np.minimum(have[: len(x) - w + 1], have[w - size : w - size + len(x) - w + 1]) if size < w else have


def _hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return common.word_hashes(data, *common.word_spans(data))


def _minimisers(words: np.ndarray, window: int) -> np.ndarray:
    """The minimiser of each window."""
    return _slide_min(common.gram_hashes(words, RUN), window - RUN + 1) if len(words) >= window else np.empty(0, np.uint64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one value."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def _pack(words: np.ndarray) -> bytes:
    """Forty bits of each word's hash."""
    return np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _keyed(docs: DataFrame) -> DataFrame:
    return common.texts(docs).filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, h and ms: the minimiser of each run of windows with one, once for each `window - RUN + 1` windows, and once more if its words occur twice in the document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(2).to_pylist():
            words = _hashes(text)
            m = _minimisers(words, window)
            starts, ends = _runs(m)
            m = m[starts]
            grams = np.sort(common.gram_hashes(words, RUN)) if len(m) else m
            again = np.unique(grams[1:][grams[1:] == grams[:-1]])
            each = np.repeat(m, -(-(ends - starts) // (window - RUN + 1)))
            found.append(np.concatenate([each, again[np.isin(again, m)]]).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "h", "ms"])

    return _keyed(docs).mapInArrow(common.by_batch(lambda: run), "doc_id long, h long, ms array<long>")


def _segments(docs: DataFrame, wanted: DataFrame, window: int, most_held: int = 200_000) -> DataFrame:
    """route, doc_id, h, start, words of the runs of windows that have a wanted minimiser; of each window, if it is one of `many`.

    Equal segments of a task are sent once, for the first of their documents; the others come as rows without words.
    """
    schema = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        def flush() -> pa.RecordBatch:
            rows = [(m, *own, size, body) for body, (m, own, size) in held.items()]
            held.clear()
            return out(rows)

        for batch in batches:
            copies: list[tuple] = []

            def copied(doc_id: int, h: int, start: int, size: int) -> None:
                if copies and copies[-1][:2] == (doc_id, h) and copies[-1][2] + copies[-1][3] - window + 1 == start:
                    start, size = copies[-1][2], copies[-1][3] + size - window + 1
                    copies.pop()
                copies.append((doc_id, h, start, size))

            for doc_id, h, text, ms, many in zip(*(c.to_pylist() for c in batch.columns)):
                words = _hashes(text)
                m = _minimisers(words, window)
                hit = np.isin(m, np.array(ms, np.int64).view(np.uint64))
                alone = np.isin(m, np.array(many, np.int64).view(np.uint64))
                whole = common.gram_hashes(words, window) if many else m
                for first, last in zip(*_runs(m)):
                    if not hit[first]:
                        continue
                    for a, b, route in zip(range(first, last), range(first + 1, last + 1), whole[first:last].view(np.int64).tolist()) if alone[first] else [(first, last, int(m[first].view(np.int64)))]:
                        body, own, size = _pack(words[a : b + window - 1]), (doc_id, h, int(a)), int(b - a + window - 1)
                        have = held.get(body)
                        if have is None:
                            held[body] = route, own, size
                        elif have[1] < own:
                            copied(*own, size)
                        elif own < have[1]:
                            held[body] = route, own, size
                            copied(*have[1], size)
                    if len(held) >= most_held:
                        yield flush()
            # Copies need no shard: any task can pass them on.
            yield out([(int(common.mix(np.array([r[0] ^ r[2]], np.int64).view(np.uint64))[0].view(np.int64)), *r, None) for r in copies])
        yield flush()

    both = _keyed(docs).join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text", "ms", "many")
    return both.mapInArrow(run, "route long, doc_id long, h long, start int, size int, words binary")


def _covered(segments: DataFrame, window: int, index_words: int) -> DataFrame:
    """doc_id, h, start, size of the stretches of words that repeated windows cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: list[tuple] = []
        held: list[np.ndarray] = []
        n, route, seen = 0, None, {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        def index() -> pa.RecordBatch:
            rows = []
            for (doc_id, h, start), later in zip(owners, repeated(held, window)):
                for a, b in zip(*_runs(later)):
                    if later[a]:
                        rows.append((doc_id, h, start + int(a), int(b - a) + window - 1))
            owners.clear()
            held.clear()
            return out(rows)

        for batch in batches:
            copies = []
            for r, doc_id, h, start, size, words in zip(*(c.to_pylist() for c in batch.columns)):
                if words is None:
                    copies.append((doc_id, h, start, size))
                    continue
                if r != route:
                    if n >= index_words:
                        yield index()
                        n = 0
                    route, seen = r, {}
                if words in seen:  # rows come in order: this one is later, or a repeated row
                    if seen[words] != (doc_id, h, start):
                        copies.append((doc_id, h, start, size))
                else:
                    seen[words] = doc_id, h, start
                    owners.append((doc_id, h, start))
                    held.append(_unpack(words))
                    n += size
            yield out(copies)
        if held:
            yield index()

    ordered = segments.repartition("route").sortWithinPartitions("route", "doc_id", "h", "start")
    return ordered.mapInArrow(run, "doc_id long, h long, start int, size int")


def routed(docs: DataFrame, window: int, index_words: int) -> DataFrame:
    """The segments of all minimisers that occur twice; the distinct ones of a route hold at most index_words words."""
    found = common.written(_occurrences(docs, window)).select("doc_id", "h", F.explode("ms").alias("m"))
    # So many windows with one minimiser are a segment of 2 * window - RUN words.
    most = F.count("*") * (2 * window - RUN)
    twice = found.groupBy("m").agg(F.count("*").alias("n"), (most > index_words).alias("over")).filter("n > 1").select("m", "over")
    sets = F.collect_set("m").alias("ms"), F.collect_set(F.when(F.col("over"), F.col("m"))).alias("many")
    wanted = common.written(found.join(twice, "m").groupBy("doc_id", "h").agg(*sets))
    return _segments(docs, common.sized(wanted, "8 * (size(ms) + size(many))"), window)


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with each row's stretches in order, those that overlap or touch as one."""
    starts, sizes = [], []
    for a, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        order = np.argsort(a, kind="stable")
        first, end = np.array(a, np.int64)[order], np.maximum.accumulate(np.add(a, n)[order])
        cut = np.concatenate([[0], np.flatnonzero(first[1:] > end[:-1]) + 1])
        first, end = first[cut], end[np.append(cut[1:], len(end)) - 1]
        starts.append(first)
        sizes.append(end - first)
    lists = [pa.array(x, pa.list_(pa.int32())) for x in (starts, sizes)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "h", "starts", "sizes"])


def repeated_passages(docs: DataFrame, window: int = 20, index_words: int = 1_000_000) -> DataFrame:
    """doc_id, h (hash of the text), starts and sizes (words) of what repeated windows cover in each document."""
    if window % 4 or window < 2 * RUN:
        raise ValueError("the window must be a multiple of four, twelve words at least")
    segments = routed(docs, window, index_words)
    covered = _covered(segments, window, index_words)
    return covered.groupBy("doc_id", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes")).mapInArrow(common.by_batch(lambda: _joined), "doc_id long, h long, starts array<int>, sizes array<int>")


def remove_repeated(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) of every document."""
    covered = common.written(repeated_passages(docs, window))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text, starts, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            words = (text or "").encode().split()
            if not starts:
                rows.append((doc_id, len(words), 0, b" ".join(words).decode()))
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.add(starts, sizes), -1)
            stay = np.cumsum(edge)[:-1] == 0
            left = [w for w, k in zip(words, stay.tolist()) if k]
            rows.append((doc_id, len(words), len(words) - len(left), b" ".join(left).decode()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    joined = common.texts(docs).withColumn("h", F.xxhash64("text")).join(common.sized(covered, "8 * size(starts)"), ["doc_id", "h"], "left")
    return joined.select("doc_id", "text", "starts", "sizes").mapInArrow(common.by_batch(lambda: run), "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated(common.table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 19], ' ')) AS s FROM starts),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 20) AS r(k)),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
    list_transform(list_filter(range(1, len(w) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: w[i]) AS k
  FROM words LEFT JOIN lists ON words.doc_id = lists.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
