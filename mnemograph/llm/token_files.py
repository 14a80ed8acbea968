"""Operator 10: token ids in binary files of bit-plane or byte-plane blocks.

A file holds the ids of a run of documents in ascending doc_id order:

    magic | planes of block 0 | planes of block 1 | ... | chunk index | document index | footer

A block is a fixed number of 32-bit ids (the last may be shorter), transposed into planes: plane p holds byte p (or
bit p) of every id of the block. Each plane that has a bit set is compressed with zstandard; an absent plane is zero.
The chunk index has a row for each block: its offset, its number of ids and the compressed size of every plane. The
document index has a row for each document: doc_id (with a validity flag) and its number of ids.

Null and empty texts are documents with the end id alone. A null doc_id sorts first and is kept. Rows that repeat a
doc_id are kept one after the other. An empty table makes no file and an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

MAGIC = b"MGTOKEN1"
_FOOTER = struct.Struct("<QQQQBI8s")


class TokenFileWriter:
    """Writes one file to an open binary stream; it holds one block and the indexes."""

    def __init__(self, out, plane_bits: int = 8, block_ids: int = 65_536, level: int = 3):
        if plane_bits not in (1, 8):
            raise ValueError("plane_bits is 1 or 8")
        self.out, self.plane_bits, self.block_ids = out, plane_bits, block_ids
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._held: list[np.ndarray] = []
        self._n_held = 0
        self._blocks: list[list[int]] = []
        self._docs: list[tuple[int, int, int]] = []
        self.n_ids = 0
        self._at = len(MAGIC)
        out.write(MAGIC)

    @property
    def n_docs(self) -> int:
        return len(self._docs)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id is not None, doc_id or 0, len(ids)))
        self.n_ids += len(ids)
        self._held.append(ids)
        self._n_held += len(ids)
        if self._n_held >= self.block_ids:
            ready = np.concatenate(self._held)
            whole = len(ready) - len(ready) % self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(ready[i : i + self.block_ids])
            self._held, self._n_held = [ready[whole:]], len(ready) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        planes = np.ascontiguousarray(raw.T)
        if self.plane_bits == 1:
            bits = np.unpackbits(planes, axis=0, bitorder="little")  # 32 rows: bit b of byte k is row 8 k + b
            planes = np.packbits(bits, axis=1)
        sizes = []
        start = self._at
        for plane in planes:
            body = self._zstd.compress(plane.tobytes()) if plane.any() else b""
            self.out.write(body)
            self._at += len(body)
            sizes.append(len(body))
        self._blocks.append([start, len(ids), *sizes])

    def close(self) -> None:
        if self._n_held:
            self._block(np.concatenate(self._held))
        chunk_index = self._zstd.compress(np.array(self._blocks, "<i8").tobytes())
        doc_index = self._zstd.compress(np.array(self._docs, "<i8").tobytes())
        self.out.write(chunk_index)
        self.out.write(doc_index)
        self.out.write(_FOOTER.pack(self._at, len(chunk_index), len(doc_index), len(self._docs), self.plane_bits, len(self._blocks), MAGIC))


class TokenFileReader:
    """Reads one file's bytes; blocks are decoded when they are asked for."""

    def __init__(self, data: bytes):
        start, n_chunk, n_doc, docs, self.plane_bits, blocks, magic = _FOOTER.unpack(data[-_FOOTER.size :])
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self._data, self._zstd = data, zstandard.ZstdDecompressor()
        planes = 4 if self.plane_bits == 8 else 32
        self.chunks = np.frombuffer(self._zstd.decompress(data[start : start + n_chunk]), "<i8").reshape(blocks, 2 + planes)
        self.docs = np.frombuffer(self._zstd.decompress(data[start + n_chunk : start + n_chunk + n_doc]), "<i8").reshape(docs, 3)

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.chunks[i].tolist()
        width = n if self.plane_bits == 8 else -(-n // 8)
        planes = np.zeros((len(sizes), width), np.uint8)
        for p, size in enumerate(sizes):
            if size:
                planes[p] = np.frombuffer(self._zstd.decompress(self._data[at : at + size]), np.uint8)
                at += size
        if self.plane_bits == 1:
            bits = np.unpackbits(planes, axis=1, count=n)
            planes = np.packbits(bits, axis=0, bitorder="little")
        return np.ascontiguousarray(planes.T).view("<u4").ravel()

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, in order; a block is decoded once."""
        blocks = (self.block(i) for i in range(len(self.chunks)))
        held = np.empty(0, "<u4")
        for known, doc_id, n in self.docs.tolist():
            parts, need = [], n
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held = next(blocks)
            parts.append(held[:need])
            held = held[need:]
            yield (doc_id if known else None), parts[0] if len(parts) == 1 else np.concatenate(parts)


_SEPARATORS = re.compile("[\x1c-\x1f]")


_SPACES = regex.compile(r"\s+")


def _words(text: str) -> list[str]:
    """Words between white space; Python's own split also takes four separators that the tokenizer's rules keep."""
    return _SPACES.split(text) if _SEPARATORS.search(text) else text.split()


class WordRules:
    """What a tokenizer file says of words, if its ids of a text are those of its words in order; else ValueError.

    Such a file turns white space to spaces, lower-cases, drops what its pattern leaves out, and marks the last token
    of each piece. Two steps more are known to change no text of the first 256 characters: NFC, and byte letters.
    """

    def __init__(self, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
        space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        normal = steps(spec["normalizer"], "normalizers")
        split, *other = steps(spec["pre_tokenizer"], "pretokenizers") or [{}]
        letters = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        model, added = spec["model"], spec["added_tokens"]
        known = (
            all(x in (space, {"type": "NFC"}, {"type": "Lowercase"}) for x in normal)
            and {"type": "Lowercase"} in normal
            and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
            and all({k: x.get(k) for k in letters} == letters for x in other)
            and model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        )
        if not known:
            raise ValueError("the ids of a text are not known to be those of its words")
        pattern = split["pattern"]["Regex"]
        if any(regex.search(pattern, c) for c in " \t\n"):
            raise ValueError("the pattern keeps white space")
        #: The file's own pattern over words of one line each.
        self.pieces = regex.compile(f"{pattern}|\n")
        self.suffix = model["end_of_word_suffix"]
        self.added = [t["content"] for t in added]


class WordCache:
    """Ids of texts by the tokenizers library.

    The library encodes every text whole, unless the tokenizer file allows to take a text's words one by one
    (WordRules). Then it sees each distinct piece of a word once, many in a call, while the cache holds it. Texts that
    hold an added token, in either case, always go to it whole, and words with characters beyond the first 256 as they
    stand.
    """

    def __init__(self, tokenizer_path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(tokenizer_path)
        self._library.no_truncation()
        self._library.no_padding()
        self._most = most
        self._have: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        try:
            self.rules = WordRules(tokenizer_path)
        except ValueError:
            self.rules = None
        else:
            self._ends = np.zeros(self._library.get_vocab_size(), bool)
            for token, i in self._library.get_vocab().items():
                self._ends[i] = token.endswith(self.rules.suffix)

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for e in self._library.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _ask(self, pieces: list[str], at_once: int = 2_000) -> None:
        """Encodes pieces, separated by spaces; each ends with a token that ends a word."""
        for i in range(0, len(pieces), at_once):
            part = pieces[i : i + at_once]
            ids = np.array(self._library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(part):
                raw, at = ids.tobytes(), 0
                for p, end in zip(part, (4 * ends).tolist()):
                    self._pieces[p] = raw[at:end]
                    at = end
            else:
                self._pieces.update(zip(part, self._whole(part)))

    def _fill(self, words: set[str]) -> None:
        if len(self._have) + len(words) > self._most:
            self._have.clear()
            self._pieces.clear()
        own = [w for w in words if w.isascii() or max(w) < "\u0100"]
        other = list(words.difference(own))
        for i in range(0, len(other), 500):
            self._have.update(zip(other[i : i + 500], self._whole(other[i : i + 500])))
        cut = self.rules.pieces.findall("\n".join(own))
        self._ask([p for p in set(cut).difference(self._pieces) if p != "\n"])
        pieces, have, held, at = self._pieces, self._have, b"", 0
        for p in cut:
            if p == "\n":
                have[own[at]], held, at = held, b"", at + 1
            elif held:
                held += pieces[p]
            else:
                held = pieces[p]
        if own:
            have[own[at]] = held

    def _by_words(self, text: str) -> list[str] | None:
        """Words as they are looked up, or None if the text goes to the library whole."""
        if self.rules is None:
            return None
        low = text.lower()
        if any(a in text or a.lower() in low for a in self.rules.added):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [w.lower() if w.isascii() or max(w) < "\u0100" else w for w in _words(text)]
        return _words(low)

    def encode(self, texts: list[str | None], end_id: int | None) -> Iterator[np.ndarray]:
        texts = [t or "" for t in texts]
        split = [self._by_words(t) for t in texts]
        new = set().union(*(s for s in split if s)).difference(self._have)
        if new:
            self._fill(new)
        have, end = self._have, b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for text, words in zip(texts, split):
            if words is None:
                ids = next(self._whole([text]))
            else:
                try:
                    ids = b"".join([have[w] for w in words])
                except KeyError:  # words that a clearing took
                    self._fill(set(words).difference(have))
                    ids = b"".join([have[w] for w in words]) if len(set(words)) <= self._most else next(self._whole([text]))
            yield np.frombuffer(ids + end, "<u4")


def _word_cache(tokenizer_path: str) -> WordCache:
    """A Python worker keeps it for its tasks of a stage."""
    return WordCache(tokenizer_path)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int | None = 2, plane_bits: int = 8, block_ids: int = 65_536, file_ids: int = 8_000_000) -> DataFrame:
    """Encodes docs (doc_id, text) and writes files in ascending doc_id order under path; returns their manifest.

    A range partition writes its own files, each of file_ids ids or a document more. A file that a lost or repeated
    task left behind is not in the manifest, and readers take only what the manifest lists.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, seq, rows = TaskContext.get().partitionId(), common.kept(_word_cache, tokenizer_path), 0, []
        store, folder = _file_system(path)
        writer = out = name = None

        def end():
            writer.close()
            out.close()
            rows.append((part, seq, name, writer.n_docs, writer.n_ids))

        for batch in batches:
            for a, b in common.chunks(batch.column(1), 2 << 20):
                piece = batch.slice(a, b - a)
                for doc_id, ids in zip(piece.column(0).to_pylist(), words.encode(piece.column(1).to_pylist(), end_id)):
                    if writer is None:
                        name = f"ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.bin"
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}")
                        writer = TokenFileWriter(out, plane_bits, block_ids)
                    writer.add(doc_id, ids)
                    if writer.n_ids >= file_ids:
                        end()
                        writer, seq = None, seq + 1
        if writer is not None:
            end()
        yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("part", "seq", "file", "n_docs", "n_ids"))}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = common.texts(docs).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return common.written(ordered.mapInArrow(write, _MANIFEST))


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document of the manifest's files.

    The manifest has a row for each file; starts come from sums by partition first, then over the partitions' totals.
    """
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = manifest.withColumn("inner", inner).join(before, "part").select("file", (F.col("before") + F.col("inner")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, starts_, sizes, sums, at = [], [], [], [], base
                for doc_id, ids in TokenFileReader(content.as_buffer().to_pybytes()):
                    keys.append(doc_id)
                    starts_.append(at)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts_, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(common.sized(starts, "length(file)"), "file").select("base", "content").mapInArrow(read, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_dir(spark)
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path, manifest)
