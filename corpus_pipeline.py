"""The document pipeline: quality, near duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of docs, whatever else those are named. run() writes each stage's rows to the shared folder and reads them back
for the next.

A null text is empty: it is scored as such, is no duplicate, leaks nothing and has no tokens. A row without a doc_id is
never a duplicate; the other stages treat it like any row. Rows that repeat a doc_id are one document to the duplicate
stage, and are judged row by row, by their own text, in the others. Texts are read whole. Empty tables give an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm import bpe, common, decontaminate, near_dup, quality, secrets


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """docs without the rows of these keys (a column of gone), which are written and measured before they may be broadcast."""
    name = "_" * (1 + max(map(len, docs.columns)))  # no column of docs
    gone = common.written(gone.toDF(name).filter(F.col(name).isNotNull()).distinct())
    return docs.join(common.sized(gone), key == F.col(name), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality ranker rejects."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return _without(docs, F.col("doc_id"), near_dup.near_duplicates(docs).filter("not kept").select("doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. A leak is a matter of the text alone, so its hash stands for it."""
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    return _without(docs, F.xxhash64("text"), decontaminate.leaks(by_text, common.table(spark, sf_dir, "benchmark")).select("doc_id"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars is the new length where a text was changed."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = secrets.scan(docs.select("text", row))
    new = {"text": secrets.redacted(F.col("text"), F.col("spans")).alias("text")}
    if "n_chars" in docs.columns:
        length = F.length(secrets.redacted(F.col("text"), F.col("spans"))).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("row")["n_chars"]).alias("n_chars")
    return found.select(*(new.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoded text."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]
#: SQL has no model fit, no index search and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
