"""Stable orders and splits of training rows by group."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from mnemograph.operators.graph import _kept as kept

#: Offset and prime of the 64-bit FNV-1a hash.
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(texts: list[bytes], seed: int) -> np.ndarray:
    """The hashes of byte strings, one place of all of them at a time."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    state = np.full(len(texts), np.uint64((_OFFSET ^ seed) & (2**64 - 1)))
    sizes = np.array([len(texts[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8).astype(np.uint64)
    for j in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -j, side="left"))  # those longer than j come first
        state[:live] = (state[:live] ^ data[starts[:live] + j]) * np.uint64(_PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


def shuffle_key(text: Column, seed: int) -> Column:
    """Twenty digits by which canonical JSON texts sort as their seeded 64-bit hashes do; equal ones then sort by the text."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{h:020d}" for h in fnv1a([t.encode() for t in texts], seed).tolist()])

    return F.pandas_udf(run, T.StringType())(F.coalesce(text, F.lit("null")))


def shuffled(rows: DataFrame, text: Column, seed: int, by: list[str]) -> DataFrame:
    """Rows with their place in the stable order of each group of `by`."""
    keyed = rows.withColumns({"_key": shuffle_key(text, seed), "_text": text})
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_key", "_text")).cast("long")).drop("_key", "_text")


def covering_groups(rows: DataFrame, required: list[str], least_eval: int, least_train: int, seed: int = 0) -> tuple[DataFrame, Mapping[str, int]]:
    """The groups that are held out, each with the round that chose it, and what they hold of each required capability.

    rows: group, capability (a string each). Whole groups are chosen one by one until each required capability has
    least_eval rows in them: the one that fills most of what is missing, then of most capabilities, of fewest rows, first
    in the stable order. A group that would leave fewer than least_train rows of a required capability is passed over; the
    choice ends where no group helps. Each round is one pass over the groups' counts for its best row, and there are at
    most as many rounds as required capabilities times least_eval, since each adds a row that is missing.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("group").agg(F.count("*").alias("rows"), *(F.count_if(F.col("capability") == c).alias(f"c{i}") for i, c in enumerate(required)))
    groups = kept(counts.withColumn("key", shuffle_key(F.concat(F.lit('"'), "group", F.lit('"')), seed)))
    total = groups.agg(*(F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(required)))).first()
    held, chosen = [0] * len(required), []
    goal = max(1, least_eval)
    while any(h < goal for h in held):
        fits, score, kinds = F.lit(True), F.lit(0), F.lit(0)
        for i, h in enumerate(held):
            have = F.col(f"c{i}")
            if least_train > 0:
                fits = fits & (F.lit(total[i] - h) - have >= least_train)
            if h < goal:
                score = score + F.least(have, F.lit(goal - h))
                kinds = kinds + (have > 0).cast("int")
        left = groups.filter(~F.col("group").isin([g for g, *_ in chosen])) if chosen else groups
        best = left.withColumns({"score": score, "kinds": kinds}).filter(fits & (F.col("score") > 0)).orderBy(F.desc("score"), F.desc("kinds"), "rows", "key", "group").limit(1).collect()
        if not best:
            break
        held = [h + best[0][f"c{i}"] for i, h in enumerate(held)]
        chosen.append((best[0]["group"], len(chosen) + 1))
    return spark.createDataFrame(chosen, "group string, round int"), dict(zip(required, held))
