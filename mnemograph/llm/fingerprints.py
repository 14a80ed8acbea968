"""Operator 13: document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hash of each of its prefixes, a polynomial in the code points modulo two primes of 31
bits. Two entries give the hash of any span in constant time, so two spans are equal or not without reading them, and
the longest common extension of two places is found by binary search (Prefixes.extension).

A fingerprint is a sample of that array. The text is cut where the hash of the last `WINDOW` code points ends in enough
zero bits, the least number that leaves no more than `cuts` places; short texts are cut everywhere. Cuts therefore depend
on what is near them alone, and those of a higher level are some of those of a lower one. A fingerprint holds the
length, the level, and of each cut its place, its own level and the prefix hash there. So the hash of every span between
two cuts can be computed from it. Two fingerprints are compared at the higher of their levels: from each cut of one, the
longest run of spans that the other has as well is found by binary search on the hashes of runs; one of `WINDOW` code
points or more (of a shorter text, half of it) counts, and every span is used once. The likeness is the common length
over the length of both less the common. Equal texts have equal fingerprints and a likeness of 1; it is 1 for texts made
of the same runs in another order, too, and 0 for texts without a common run. Different spans are taken for equal with a probability of about 2^-60 for each comparison.

The edited text of a document takes the place of its last quarter from the start of the next document. Documents are
dealt to partitions by ranges of (doc_id, hash of the text), whose borders come from a sample of 64 keys for each partition; each range also
gets the first document of the next one, so that each partition is one pass over sorted rows that holds two texts.

Null text is empty. A row without a doc_id comes after all others, and rows that repeat one are in the order of their
texts' hashes, each a document of its own. A single document is its own next. An empty table gives an empty result. Texts
are read whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The two moduli and bases, the code points that decide a cut, and the most cuts of a fingerprint.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_579, 1_181_783_497)
WINDOW, CUTS = 8, 64
#: The level of a text's end, which is a cut at every level.
_END = 255


def _table(base: int, prime: int, n: int) -> np.ndarray:
    """base^0, ..., base^(n - 1) modulo a prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    have = _POWERS.get((base, prime))
    if have is None or len(have) < n:
        if n > 1 << 20:
            return _table(base, prime, n)  # a very long text's are not kept
        have = _POWERS[base, prime] = _table(base, prime, max(n, 1 << 14))
    return have[:n]


class Prefixes:
    """The prefix hashes of a text: sums[m][i] of its first i code points modulo the m-th prime."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums, self.back = [], []
        for base, prime in zip(BASES, PRIMES):
            p = np.uint64(prime)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * _powers(base, prime, self.n) % p, out=sums[1:])
            self.sums.append(sums % p)
            self.back.append(_powers(pow(base, -1, prime), prime, self.n + 1))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The 62-bit hash of each span [start, end), the same wherever it stands."""
        out = np.zeros(len(starts), np.uint64)
        for prime, sums, back in zip(PRIMES, self.sums, self.back):
            p = np.uint64(prime)
            out = (out << np.uint64(31)) | ((sums[ends] + p - sums[starts]) % p * back[starts] % p)
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def extension(self, at: int, other: Prefixes, there: int) -> int:
        """How many code points agree from `at` here and from `there` in the other, by binary search on prefix hashes."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, at + middle) == other.span(there, there + middle):
                low = middle
            else:
                high = middle - 1
        return low


class Fingerprint(NamedTuple):
    """length and level of a text; places, levels and both prefix hashes of its cuts, the last of which is its end."""

    length: int
    level: int
    places: np.ndarray
    levels: np.ndarray
    hashes: np.ndarray  # 2 rows

    def text(self) -> str:
        body = np.concatenate([[self.length, self.level], self.places, self.levels, *self.hashes]).astype("<u4")
        return base64.b64encode(body.tobytes()).decode()


def parsed(text: str) -> Fingerprint:
    body = np.frombuffer(base64.b64decode(text), "<u4").astype(np.int64)
    n = (len(body) - 2) // 4
    return Fingerprint(int(body[0]), int(body[1]), body[2 : 2 + n], body[2 + n : 2 + 2 * n], body[2 + 2 * n :].reshape(2, n).astype(np.uint64))


def fingerprint(text: str, cuts: int = CUTS) -> Fingerprint:
    prefixes = Prefixes(text)
    n = prefixes.n
    levels = np.zeros(n + 1, np.int64)  # before a whole window has gone by, a cut is of the lowest level
    if n >= WINDOW:
        starts = np.arange(n - WINDOW + 1)
        mixed = common.mix(prefixes.spans(starts, starts + WINDOW))
        last = mixed & (~mixed + np.uint64(1))
        levels[WINDOW:] = np.where(last > 0, np.round(np.log2(np.maximum(last, np.uint64(1)).astype(float))), 63).astype(np.int64)
    levels[0] = -1
    inner = levels[:n]
    # The least level with no more cuts than asked for; it is above every window's level if no other is.
    tally = np.bincount(inner[inner >= 0], minlength=65)
    above = np.cumsum(tally[::-1])[::-1]
    level = int(np.flatnonzero(np.concatenate([above, [0]]) <= cuts)[0])
    places = np.concatenate([np.flatnonzero(inner >= level), [n]]) if n else np.array([0])
    return Fingerprint(n, level, places, np.concatenate([levels[places[:-1]], [_END]]), np.array([s[places] for s in prefixes.sums]))


class _Runs:
    """The cuts of a fingerprint at a level, with 0 before them, and the hashes of the spans between any two."""

    def __init__(self, f: Fingerprint, level: int):
        keep = f.levels >= level
        self.at = [0, *f.places[keep].tolist()]
        self.sums = [[0, *row[keep].tolist()] for row in f.hashes]
        self.back = [_powers(pow(base, -1, prime), prime, f.length + 1)[self.at].tolist() for base, prime in zip(BASES, PRIMES)]

    def span(self, i: int, j: int) -> tuple[int, int, int]:
        """Length and hashes from cut i to cut j."""
        out = [self.at[j] - self.at[i]]
        for prime, sums, back in zip(PRIMES, self.sums, self.back):
            out.append((sums[j] - sums[i]) * back[i] % prime)
        return tuple(out)


def _run(a: _Runs, i: int, b: _Runs, j: int, most: int) -> int:
    """How many spans from cut i of a are those from cut j of b, at most `most`: a longest common extension by binary search."""
    low, high = 1, most
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def likeness(x: Fingerprint, y: Fingerprint) -> float:
    """Common length over joint length, from 0 to 1."""
    if x.length == y.length and (x.hashes[:, -1] == y.hashes[:, -1]).all():
        return 1.0
    if not x.length or not y.length:
        return 0.0
    least = min(WINDOW, (min(x.length, y.length) + 1) // 2)
    level = max(x.level, y.level)
    a, b = _Runs(x, level), _Runs(y, level)
    places: dict[tuple, list[int]] = {}
    for j in range(len(b.at) - 1):
        places.setdefault(b.span(j, j + 1), []).append(j)
    free = [True] * (len(b.at) - 1)
    i = common_length = 0
    while i < len(a.at) - 1:
        best, at = 0, 0
        for j in places.get(a.span(i, i + 1), ()):
            if free[j]:
                end = j
                while end < len(free) and free[end] and end - j < len(a.at) - 1 - i:
                    end += 1
                n = _run(a, i, b, j, end - j)
                if n > best:
                    best, at = n, j
        length = a.at[i + best] - a.at[i]
        if length >= least:
            common_length += length
            free[at : at + best] = [False] * best
            i += best
        else:
            i += 1
    return common_length / (x.length + y.length - common_length)


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many from the start of the following text, or by all of it."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def _keys() -> list[Column]:
    return [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("h")]


def ranged(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) with h, part and copy, dealt by part and sorted by (doc_id, h) in it; each part ends with a
    copy of the first row of the next part that has any, the last with that of the first."""
    hashed = docs.withColumn("h", F.xxhash64("text"))
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(_keys())))
    some = [tuple(r.key) for r in hashed.select(key.alias("key")).orderBy(F.xxhash64(F.col("key.k1"), F.col("key.k2"))).limit(64 * parts).collect()]
    some.sort()
    borders = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    as_key = lambda b: F.struct(F.lit(b[0]).alias("k0"), F.lit(b[1]).cast("long").alias("k1"), F.lit(b[2]).cast("long").alias("k2"))
    part = F.size(F.filter(F.array(*map(as_key, borders)), lambda b: b <= key)) if borders else F.lit(0)
    placed = hashed.withColumn("part", part)
    firsts = sorted((r.part, r.key) for r in placed.groupBy("part").agg(F.min(key).alias("key")).collect())  # a row for each part
    rows = [(firsts[i - 1][0], *k) for i, (_, k) in enumerate(firsts)] if firsts else []
    heads = docs.sparkSession.createDataFrame(rows, "to int, k0 boolean, k1 long, k2 long")
    split = placed.select("*", key.alias("key"))
    match = (F.col("key.k0") == F.col("k0")) & (F.col("key.k1") == F.col("k1")) & (F.col("key.k2") == F.col("k2"))
    copies = split.join(F.broadcast(heads), match).dropDuplicates(["to"]).select("doc_id", "text", "h", F.col("to").alias("part"), F.lit(True).alias("copy"))
    every = placed.select("doc_id", "text", "h", "part", F.lit(False).alias("copy")).unionByName(copies)
    return every.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "copy", *_keys())


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _paired(cuts: int):
    """A result row for each row of (doc_id, text, part, copy) that is no copy, with the row behind it as its next."""
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        before = None
        for batch in batches:
            out = []
            for doc_id, text, part, copy in zip(*(c.to_pylist() for c in batch.columns)):
                own = fingerprint(text, cuts)
                if before is not None and before[2] == part:
                    there, last, _, theirs = before
                    new = edited(last, text)
                    changed = fingerprint(new, cuts)
                    out.append((there, len(last), hashlib.sha256(new.encode()).hexdigest(), theirs.text(), changed.text(), likeness(theirs, changed), likeness(theirs, own)))
                before = None if copy else (doc_id, text, part, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], names=names)

    return run


def fingerprints(docs: DataFrame, cuts: int = CUTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = common.texts(docs).fillna({"text": ""})
    return ranged(whole, parts).select("doc_id", "text", "part", "copy").mapInArrow(_paired(cuts), _RESULT)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
