"""Operator 3 against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemograph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(PATH)


def ids_of(encoder, text):
    return [i for group in encoder.stream(text) for tokens in group for i in tokens]


@pytest.mark.parametrize("window, short", [(1 << 16, 256), (16, 4)])
def test_random_texts(library, model, window, short):
    rng, encoder = random.Random(window), bpe.Encoder(model, window=window, short=short)
    parts = ["a", "the", " ", "  ", "\n", "'re", "'", "1", "23", "!", "...", "é", "漢", "😀", "́", "<|endoftext|>", "\x1c", "\x85", "　", "\xa0", "er", "in", "aaaa", " a", "ing", "'l", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids, text


def test_long_piece_in_constant_memory(library, model):
    rng = random.Random(5)
    for text in ("a" * 4000, "".join(rng.choice("etaoinshrdlu") for _ in range(6000)), "=-" * 2000):
        stream, out, most = bpe.PieceStream(model), [], 0
        for k in range(0, len(text), 37):
            out += stream.feed(text[k : k + 37].encode())
            most = max(most, len(stream._data))
        assert out + stream.finish() == library.encode(text, add_special_tokens=False).ids
        assert most <= 2 * max(model.lookahead, model.longest)


def test_decoder_keeps_what_it_cannot_end(library, model):
    for ids in ([447], [447, 250], [220, 447, 220], list(range(300))):
        assert bpe.decode(model, ids) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    texts = [None, "", "a", "naïve <|endoftext|> text\n\n  end ", "x" * 70000 + " é" * 9000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 2), (2, "a", 3)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encode_digests(df, PATH).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts), (None, "a"), (2, "a")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def test_a_worker_keeps_things_for_one_stage(monkeypatch):
    from types import SimpleNamespace

    from mnemograph.llm import common

    made = []

    def make(name):
        made.append(name)
        return object()

    at = SimpleNamespace(stageId=lambda: 1)
    monkeypatch.setattr(common.TaskContext, "get", classmethod(lambda cls: at))
    first = common.kept(make, "a")
    assert common.kept(make, "a") is first and common.kept(make, "b") is not first
    at = SimpleNamespace(stageId=lambda: 2)
    common.forget()
    assert not common._KEPT
    assert common.kept(make, "a") is not first and made == ["a", "b", "a"]
    monkeypatch.undo()
    common.forget()
