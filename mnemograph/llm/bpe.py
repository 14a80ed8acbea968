"""Operator 3: byte-level BPE encoding and decoding as a streaming transducer.

A tokenization of bytes is the merge list's own exactly if each two neighbouring tokens are (no merge of lower rank
joins across their border). So the last token of every prefix is unique: the token that ends there and agrees with the
last token of the prefix before it. The encoder keeps those last tokens for the positions that are still open, and
emits a token once so many bytes stand behind it as a merge can look to its right, a bound that is computed from the
merge list (BpeModel.lookahead), and the paths back from every position that can still begin a token have met behind it:
nothing that follows can change it. So state stays constant however long a piece is. A piece that is shorter than the
bound is emitted at its end. Every piece goes through this transducer; the tokens of short ones are remembered.

Null texts are empty; an empty text has no tokens. Texts of any length are read in windows. doc_id may be null or
repeat: a row in, a row out. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = regex.compile(PATTERN)


def _first_256() -> re.Pattern:
    """The pattern for texts of the first 256 characters alone, its classes spelled out."""
    of = lambda c: "".join(re.escape(chr(i)) for i in range(256) if regex.match(c, chr(i)))
    letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


_PIECES_256 = _first_256()


def _pieces_of(text: str) -> Any:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _PIECES
    return _PIECES_256


#: A piece is final if it ends so many characters before the end of what has been read: longest contraction and one.
_HOLD = 4
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself, or from 256 up for the others in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """A vocabulary and merge list with what the transducer needs of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.table = [b""] * (1 + max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for k, v in self.ids.items():
            self.table[v] = k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for k, v in self.special.items():
            self.table[v] = k.encode()
        #: Bytes that begin a token, with the tokens that they end with, longest first (found when first asked for).
        self.begins: dict[bytes, tuple[tuple[int, int], ...] | None] = dict.fromkeys(k[:i] for k in self.ids for i in range(1, len(k) + 1))
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = self.ids[a], self.ids[b]
            self.rank.setdefault(pair, r)
            self.made.setdefault(self.ids[a + b], (r, *pair))
        self.longest = max(map(len, self.ids))
        self._borders: dict[int, bool] = {}
        self._wholes: dict[int, bool] = {}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Most bytes to the right of a merge that can decide whether it happens.

        Only a merge of lower rank that takes a piece at the right edge of its right part can prevent a merge, and that
        one depends in the same way on what stands to its own right. So the bound is the longest such chain, found by
        going through the merges in rank order.
        """
        far: dict[int, int] = {}
        for r, (a, b) in sorted((r, p) for p, r in self.rank.items()):
            reach, edge = 0, b
            while True:
                reach = max(reach, far.get(edge, 0))
                if edge not in self.made or self.made[edge][0] >= r:
                    break
                edge = self.made[edge][2]
            far[a] = max(far.get(a, 0), len(self.table[b]) + reach)
        return max(far.values(), default=1)

    def agrees(self, a: int, b: int, most: int = 1 << 20) -> bool:
        """_agrees, remembered for a number of pairs."""
        key = a << 32 | b
        found = self._borders.get(key)
        if found is None:
            if len(self._borders) >= most:
                self._borders.clear()
            found = self._borders[key] = self._agrees(a, b)
        return found

    def _agrees(self, a: int, b: int) -> bool:
        """Whether the merge list leaves a border between tokens a and b: undoes merges at the border, latest first."""
        made, rank = self.made, self.rank
        before = 1 << 62  # merges of this rank and later ones have not happened at this point
        while True:
            if rank.get((a, b), before) < before:
                return False
            ra, rb = made[a][0] if a in made else -1, made[b][0] if b in made else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, made[a][2]
            else:
                # Left to right, equal ranks: a merge at the left of the border comes first.
                before, b = rb + (ra < rb), made[b][1]

    def ends(self, data: bytes) -> tuple[tuple[int, int], ...]:
        """The tokens that data, the beginning of a token, ends with, and their lengths, longest first."""
        if not data:
            raise ValueError("the vocabulary lacks a byte")
        found = self.begins[data]
        if found is None:
            tokens = ((self.ids.get(data[i:], -1), len(data) - i) for i in range(len(data)))
            found = tuple((t, n) for t, n in tokens if t >= 0 and self._whole(t))
            self.begins[data] = found
        return found

    def encode_pieces(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of pieces that are at hand as a whole; what a piece begins with like the one before it is read once."""
        stream, before = PieceStream(self), b""
        for data in pieces:
            same = 0
            if before[:3] == data[:3]:
                same = next((i for i, (x, y) in enumerate(zip(before, data)) if x != y), min(len(before), len(data)))
            if not stream.back_to(same):
                stream, same = PieceStream(self), 0
            out = stream.feed(data[same:])
            yield out + stream.rest()
            before = data

    def _whole(self, token: int) -> bool:
        """Whether the token's bytes, alone, are merged to it."""
        found = self._wholes.get(token)
        if found is None:
            _, a, b = self.made.get(token, (0, -1, -1))
            found = self._wholes[token] = a < 0 or self._whole(a) and self._whole(b) and self._joins(a, b, token)
        return found

    def _joins(self, a: int, b: int, token: int) -> bool:
        made, rank, before = self.made, self.rank, self.made[token][0]
        while True:
            ra, rb = made[a][0] if a in made else -1, made[b][0] if b in made else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, made[a][2]
            else:
                before, b = rb + (ra < rb), made[b][1]
            if rank.get((a, b), before) < before:
                return False


class PieceStream:
    """Tokens of one piece whose bytes arrive in parts; holds the open positions only."""

    def __init__(self, model: BpeModel):
        self.model, self._data, self._last = model, b"", []
        self._deep: list[int] = []  # where the longest end of each prefix that begins a token starts
        self._first: int | None = None  # the token before what is held
        self._due = 2 * max(model.lookahead, model.longest)

    def feed(self, data: bytes) -> list[int]:
        """Takes the next bytes; returns the tokens that they make final."""
        out: list[int] = []
        for at in range(0, len(data), self._due):
            self._read(data[at : at + self._due])
            if len(self._data) > self._due:
                out += self._stable()
        return out

    def _read(self, more: bytes) -> None:
        """The last token of each further prefix: the longest that agrees with the last token before it."""
        model, last, data, deeps = self.model, self._last, self._data + more, self._deep
        deep = deeps[-1] if deeps else 0
        begins, borders, first = model.begins, model._borders, self._first
        for end in range(len(last) + 1, len(data) + 1):
            while (held := data[deep:end]) not in begins and deep < end:
                deep += 1
            for token, size in begins.get(held) or model.ends(held):
                before = last[end - size - 1] if size < end else first
                if before is None:
                    break
                fits = borders.get(before << 32 | token)
                if model.agrees(before, token) if fits is None else fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            deeps.append(deep)
        self._data = data

    def _stable(self) -> list[int]:
        """Tokens with the lookahead behind them, if the paths from all open positions have met there."""
        size, end = [len(self.model.table[t]) for t in self._last], len(self._data)
        marked = [False] * (end + 1)
        for at in range(max(0, end - self.model.longest), end + 1):
            marked[at] = True
        paths, at = sum(marked), end
        while paths > 1:
            if marked[at]:
                before = at - size[at - 1]
                paths -= marked[before]
                marked[before] = True
            at -= 1
        while not marked[at]:
            at -= 1
        while at > end - self.model.lookahead and at:
            at -= size[at - 1]
        return self._emit(at)

    def rest(self, end: int | None = None) -> list[int]:
        """Tokens of what is held, or of what is held before end."""
        out, at, table, last = [], len(self._data) if end is None else end, self.model.table, self._last
        while at:
            out.append(last[at - 1])
            at -= len(table[last[at - 1]])
        return out[::-1]

    def _emit(self, end: int) -> list[int]:
        out = self.rest(end)
        if out:
            self._first = out[-1]
            self._data, self._last, self._deep = self._data[end:], self._last[end:], [max(0, d - end) for d in self._deep[end:]]
        return out

    def back_to(self, n: int) -> bool:
        """Forgets all but the first n bytes, unless tokens have left since."""
        if self._first is not None:
            return False
        self._data = self._data[:n]
        del self._last[n:], self._deep[n:]
        return True

    def finish(self) -> list[int]:
        return self._emit(len(self._data))


class Encoder:
    """Tokens of texts; remembers those of short pieces, up to a number of them, as view() makes them of token lists."""

    def __init__(self, model: BpeModel, view: Callable[[list[int]], Any] = tuple, window: int = 1 << 16, most: int = 600_000, short: int = 256):
        self.model, self.view, self.window, self._most, self._short = model, view, window, most, short
        self._have: dict[str, Any] = {}

    def _tokens(self, pieces: list[str]) -> list:
        have = self._have
        try:
            return [have[p] for p in pieces]
        except KeyError:
            pass
        long: dict[str, Any] = {}
        if len(have) + len(pieces) > self._most:
            have.clear()
        new = sorted(set(pieces).difference(have))
        for p, tokens in zip(new, self.model.encode_pieces(map(str.encode, new))):
            (have if len(p) <= self._short else long)[p] = self.view(tokens)
        return [have[p] if p in have else long[p] for p in pieces]

    def stream(self, text: str) -> Iterator[list]:
        """Views of the pieces' tokens, in order, for one window of the text after another."""
        if not any(s in text for s in self.model.special):
            yield from self._plain(text)
            return
        at = 0
        for m in self.model.special_pattern.finditer(text):
            yield from self._plain(text[at : m.start()])
            yield [self.view([self.model.special[m[0]]])]
            at = m.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[list]:
        at, n, cut = 0, len(text), _pieces_of(text)
        while n - at > self.window:
            end = at + self.window
            safe = at
            pieces = []
            for m in cut.finditer(text, at, end):
                if m.end() > end - _HOLD:
                    break
                pieces.append(m[0])
                safe = m.end()
            if safe == at:  # one piece fills the window
                yield from self._long(text, at)
                at = self._ended
                continue
            yield self._tokens(pieces)
            at = safe
        if at < n:
            yield self._tokens(cut.findall(text, at))

    def _long(self, text: str, at: int) -> Iterator[list]:
        """A piece longer than the window, fed to the transducer part by part."""
        stream, n = PieceStream(self.model), len(text)
        first = at + (text[at] == " " and at + 1 < n and not text[at + 1].isspace())
        run = next((r for r in _RUNS if r.match(text, first)), None)
        end = at
        if run is None:  # white space: the run without its last character if something follows
            while end < n and text[end].isspace():
                end += 1
            end -= end < n
        part = at
        while True:
            if run is not None:
                m = run.match(text, max(part, first), min(n, part + self.window))
                end = m.end() if m else part
            stop = min(end, part + self.window)
            if stop <= part:
                break
            yield [self.view(stream.feed(text[part:stop].encode()))]
            part = stop
        yield [self.view(stream.finish())]
        self._ended = part


class ByteDecoder:
    """Text of tokens' bytes that arrive in parts: bytes are held until they end a character; bad ones become U+FFFD."""

    def __init__(self):
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._utf8.decode(data)

    def finish(self) -> str:
        return self._utf8.decode(b"", True)


def decode(model: BpeModel, ids: Iterable[int]) -> str:
    """The text of token ids."""
    decoder = ByteDecoder()
    return "".join([decoder.feed(model.table[i]) for i in ids]) + decoder.finish()


def _digester(tokenizer_path: str) -> Callable[[str], tuple[int, str, str]]:
    """Number of ids, digest of the ids and digest of their text, of a text; a Python worker keeps it for its tasks of a stage."""
    model = BpeModel(tokenizer_path)
    table, numbers = model.table, [f"{i}," for i in range(len(model.table))]
    encoder = Encoder(model, lambda ids: ("".join([numbers[i] for i in ids]), b"".join([table[i] for i in ids])))

    def digests(text: str) -> tuple[int, str, str]:
        ids_hash, text_hash, decoder, n, held = hashlib.sha256(), hashlib.sha256(), ByteDecoder(), 0, ""
        for views in encoder.stream(text):
            if not views:
                continue
            numbers_, parts = zip(*views)
            ids = held + "".join(numbers_)
            n += ids.count(",") - len(held)
            if ids:
                held = ids[-1]
                ids_hash.update(ids[:-1].encode())
            text_hash.update(decoder.feed(b"".join(parts)).encode())
        text_hash.update(decoder.finish().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    return digests


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = common.kept(_digester, tokenizer_path)
        for batch in batches:
            for a, b in common.chunks(batch.column(1)):
                piece = batch.slice(a, b - a)
                rows = [(i, *digests(t or "")) for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return common.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
