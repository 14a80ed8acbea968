"""Operator 10: round trips and the library's own ids."""

import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemograph.llm import common, token_files as t

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 8])
def test_file_round_trip(bits):
    rng = np.random.default_rng(bits)
    docs = [(i if i else None, rng.integers(0, 2 ** rng.integers(1, 33), rng.integers(0, 900), dtype=np.uint64).astype("<u4")) for i in range(60)]
    out = io.BytesIO()
    w = t.TokenFileWriter(out, bits, block_ids=1000)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    back = list(t.TokenFileReader(out.getvalue()))
    assert [i for i, _ in back] == [i for i, _ in docs]
    assert all(np.array_equal(a, b) for (_, a), (_, b) in zip(back, docs))
    # One block can be read alone.
    every = np.concatenate([x for _, x in docs])
    assert np.array_equal(t.TokenFileReader(out.getvalue()).block(2), every[2000:3000])


def test_words_have_the_librarys_ids():
    rng, library = random.Random(2), Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    parts = ["a", "The", " ", "  ", "\n", "'re", "'", "1", "23", "!", "...", ".", ",", "É", "İ", "ß", "漢", "😀", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "　", "\xa0", "er", "Σ", "ΑΣ", "क़", "ª", "don't."]
    cache = t.WordCache(PATH)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]
    for text, ids in zip(texts, cache.encode(texts, None)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_of_other_rules_get_whole_texts(tmp_path):
    """Rules that keep white space, or that are not known, hand every text to the library whole."""
    cache = t.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    assert cache.rules is None
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["A  b\n", "", "don't stop. Éa"]
    assert [x.tolist() for x in cache.encode(texts, 7)] == [library.encode(x, add_special_tokens=False).ids + [7] for x in texts]
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["pretokenizers"][0]["invert"] = False
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        t.WordRules(str(tmp_path / "other.json"))


def test_small_cache():
    library = Tokenizer.from_file(PATH)
    cache = t.WordCache(PATH, most=5)
    texts = ["one two three", "four five six seven eight nine ten", "one two", "a b c d e f g h"]
    assert [x.tolist() for x in cache.encode(texts, None)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    texts = [(7, "Hello, world."), (3, None), (5, ""), (None, "x"), (3, "again"), (9, "long " * 30000)] + [(20 + i, f"word{i} " * i) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as file", "2 as start").repartition(3)
    path = common.shared_dir(spark)
    manifest = t.write_token_files(df, path, PATH, file_ids=500, block_ids=64)
    got = sorted(t.read_token_files(spark, path, manifest).collect(), key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    at, sums = 0, {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        sums.setdefault(r.doc_id, set()).add((r.n_tokens, r.ids_crc32))
    for i, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in sums[i]
    empty = common.shared_dir(spark)
    assert t.read_token_files(spark, empty, t.write_token_files(df.limit(0), empty, PATH)).count() == 0
