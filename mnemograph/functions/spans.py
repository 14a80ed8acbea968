"""Spans of a text that are no prose: code, mathematics and URLs (X1 to X3), found from left to right.

Each kind is looked for by itself, in one pass over the text; of spans that overlap the one that starts first stays, and
of those that start together code before mathematics before URLs. Built-in pattern functions can not do that, since what
a kind takes depends on where its own last span ended; so these are Arrow-batched functions, which get only texts that
have a mark in them. Places count characters from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("raw", T.StringType())]))
_RANK = {"fenced_code": 0, "inline_code": 0, "math": 1, "url": 2}
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]")
_OPERATOR = re.compile(r"[\\=+\-*/^_{}<>]")
_NUMBERS = re.compile("[0-9.,\t-\r \x85\xa0  -     　]+")
_TOKEN = re.compile("(?=.*[A-Za-z])[A-Za-z0-9]+", re.DOTALL)


def reads_as_math(body: str) -> bool:
    """Whether what stands between two dollar signs is mathematics and no amount of money."""
    x = body.strip()
    if not x or "\n" in x or len(x.encode()) > 120:
        return False
    return bool(_OPERATOR.search(x) or _NUMBERS.fullmatch(x) or _TOKEN.fullmatch(x))


def _between(text: str, opening: str, closing: str) -> Iterator[tuple[int, int]]:
    """From each opening mark to the next closing one, or to the end of the text."""
    at = text.find(opening)
    while at >= 0:
        stop = text.find(closing, at + len(opening))
        stop = len(text) if stop < 0 else stop + len(closing)
        yield at, stop
        at = text.find(opening, stop)


def _ticked(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("`")
    while at >= 0:
        if text.startswith("```", at):
            at = text.find("`", at + 3)
            continue
        stop = text.find("`", at + 1)
        if stop < 0:
            return
        yield at, stop + 1
        at = text.find("`", stop + 1)


def _dollars(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("$")
    while at >= 0:
        stop = -1
        if not text.startswith("$$", at) and text[at - 1 : at] != "\\":
            stop = text.find("$", at + 1)
            if stop < 0:
                return
            if reads_as_math(text[at + 1 : stop]):
                yield at, stop + 1
            else:
                stop = -1
        at = text.find("$", at + 1 if stop < 0 else stop + 1)


def _urls(text: str, prefix: str) -> Iterator[tuple[int, int]]:
    at = text.find(prefix)
    while at >= 0:
        space = _SPACE.search(text, at)
        stop = at + len(text[at : space.start() if space else len(text)].rstrip(".,;:!?)"))
        yield at, stop
        at = text.find(prefix, max(stop, at + len(prefix)))


def protected_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, raw) of the spans that are no prose, in order; none overlap."""
    found = []
    if "`" in text:
        found += [("fenced_code", *x) for x in _between(text, "```", "```")]
        found += [("inline_code", *x) for x in _ticked(text)]
    if "$" in text:
        found += [("math", *x) for x in _between(text, "$$", "$$")]
    if "\\" in text:
        for opening, closing in (("\\(", "\\)"), ("\\[", "\\]")):
            found += [("math", *x) for x in _between(text, opening, closing)]
    if "$" in text:
        found += [("math", *x) for x in _dollars(text)]
    if "http" in text:
        for prefix in ("https://", "http://"):
            found += [("url", *x) for x in _urls(text, prefix)]
    out, free = [], 0
    for kind, start, stop in sorted(found, key=lambda x: (x[1], _RANK[x[0]], x[2])):
        if start >= free and start < stop:
            out.append((kind, start, stop, text[start:stop]))
            free = stop
    return out


def _prose(text: str) -> str:
    parts, at = [], 0
    for _, start, stop, _ in protected_spans(text):
        parts += [text[at:start], " "]
        at = stop
    return "".join([*parts, text[at:]])


def _spans_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [dict(zip(("kind", "start", "stop", "raw"), s)) for s in protected_spans(t)])


def _prose_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _prose(t))


def _marked(text: Column) -> Column:
    """The text where it has marks that a span may be made of, else null: a lone backtick or dollar sign makes none."""
    return F.when(text.rlike(r"`[^`]*`|\$[^$]*\$|\\[(\[]|https?://"), text)


def protected(text: Column) -> Column:
    """Array of (kind, start, stop, raw) of a text's spans that are no prose; empty for a null text."""
    return F.coalesce(F.pandas_udf(_spans_of, SPAN)(_marked(text)), F.array().cast(SPAN))


def prose(text: Column) -> Column:
    """The text with a space in place of each such span."""
    return F.coalesce(F.pandas_udf(_prose_of, T.StringType())(_marked(text)), text)
