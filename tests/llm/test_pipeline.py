"""The pipeline's stages, one after the other, against plain checks of each stage's own input."""

import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, "/root/repo")

import corpus_pipeline  # noqa: E402
from mnemograph.llm import common, decontaminate, quality, secrets  # noqa: E402
from tests.llm.test_near_dup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(common.written(stage(spark, kept[-1], SF)))
    assert all(k.columns == columns for k in kept[1:-1])
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    text = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    ranker = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {i: ranker.score(np.array([quality.features(t or "")]))[0] for i, t in text[0].items()}
    assert ids[1] == {i for i, s in score.items() if s >= quality.CUT}
    assert ids[2] == {r[0] for r in brute(text[1].items(), 5, 80) if r[3]}
    items = [" ".join(r.text.lower().encode().translate(decontaminate._TO_SPACE).decode().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = {i: " ".join(t.lower().encode().translate(decontaminate._TO_SPACE).decode().split()) for i, t in text[2].items()}
    assert ids[3] == {i for i, t in flat.items() if not any(f" {x} " in f" {t} " for x in items)}
    assert ids[4] == ids[3] == ids[5]
    assert secrets.scan(kept[4].select("doc_id", "text")).filter("size(base) > 0").isEmpty()
    same = [i for i in ids[4] if text[4][i] == text[3][i]]
    assert len(same) > 0.9 * len(ids[4])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    assert {r.doc_id: r.n_tokens for r in kept[5].collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in text[4].items()}
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, kept[5].collect()))


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated doc_ids, empty tables and columns whose names the stages use themselves."""
    item = "what colour is the sky above the old northern harbour at noon in the middle of a cold winter. it is blue on every clear day of that month."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(None, f"so {item} yes"), (None, None), (7, f"well {item} then"), (7, clean), (8, clean.upper()), (9, "password = abcdefghijklmnop " + clean[::-1]), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'b' as base", "'s' as spans", "2 as `row`", "3 as _leak", "4 as kept", "text as value", "5 as `a.b`")
    left = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in rows if item not in (t or ""))
    masked = corpus_pipeline.mask_secrets(spark, docs, str(tmp_path))
    assert masked.columns == docs.columns
    got = {(r.doc_id, r.value): r for r in masked.collect()}
    assert all((r.base, r.spans, r.row, r["a.b"]) == ("b", "s", 2, 5) for r in got.values()) and len(got) == len(rows)
    assert got[9, rows[5][1]].text.startswith("[SECRET] ") and got[7, clean].text == clean
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert unique.columns == docs.columns
    assert sorted(str(r.doc_id) for r in unique.collect()) == ["10", "7", "7", "9", "None", "None"]
    good = quality.keep_good(docs, quality.fit_ranker(np.empty((0, 10)), np.empty(0)))
    assert good.columns == docs.columns and good.count() == len(rows)  # without labels all scores are at the threshold
    for stage in (corpus_pipeline.drop_benchmark_leaks, corpus_pipeline.mask_secrets, corpus_pipeline.drop_near_duplicates, corpus_pipeline.encode):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
