"""Embeddings: batch inference with a model of the caller, vector tables, and comparison of models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.vectors import dot, norm


def embed(texts: Column, model: Callable[[Sequence[str]], np.ndarray], size: int, batch: int = 64) -> Column:
    """Vectors of a text column by ``model`` (texts -> matrix), ``batch`` texts at a time. Blank texts and outputs of another shape are errors."""

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(column), batch):
            some = column.iloc[at : at + batch].tolist()
            if any(t is None or not t.strip() for t in some):
                raise ValueError("blank text to embed")
            rows = np.asarray(model(some), dtype=np.float32)
            if rows.shape != (len(some), size):
                raise ValueError(f"model gave {rows.shape} for {len(some)} texts of dimension {size}")
            out += list(rows)
        return pd.Series(out, index=column.index, dtype=object)

    return run(texts)


def check_compat(vectors: DataFrame, config: DataFrame) -> DataFrame:
    """(dimension, model) groups of ``vectors`` that differ from the one row of ``config``."""
    return vectors.groupBy(F.size("vector").alias("dimension"), "model").agg(F.count(F.lit(1)).alias("n")).join(config.select("dimension", "model"), ["dimension", "model"], "left_anti")


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The last row of a key within ``new`` (by ``order``) replaces the old one."""
    last = new.withColumn("_turn", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).filter("_turn = 1").drop("_turn", order)
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def get_by_id(vectors: DataFrame, ids: Sequence[object], key: str = "doc_id") -> DataFrame:
    """E5: rows of the given ids; the scan sees the filter."""
    return vectors.filter(F.col(key).isin(*ids))


def candidate_pool(chunks: DataFrame, wanted: DataFrame, size: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """All wanted rows (positives and hard negatives), filled up to ``size``, if they are fewer, with those of the smallest seeded hashes."""
    ids = wanted.select(key).distinct()
    critical = chunks.join(ids, key, "left_semi")
    others = chunks.join(ids, key, "left_anti").withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")))
    return critical.unionByName(others.orderBy("_h", key).limit(max(0, size - critical.count())).drop("_h"))


def compare_embeddings(ranked: DataFrame, relevant: DataFrame, negatives: DataFrame, scores: DataFrame) -> DataFrame:
    """Per model hit@1/3/5, MRR to rank 10, precision@5, and the mean score of positives less that of negatives.

    ``ranked``: (model, query_id, doc_id, rank); ``relevant`` and ``negatives``: (query_id, doc_id); ``scores``: (model, query_id, doc_id, score).
    """
    pos = relevant.select("query_id", "doc_id").distinct().withColumn("pos", F.lit(1))
    marked = ranked.join(pos, ["query_id", "doc_id"], "left")
    first = F.min(F.when(F.col("pos") == 1, F.col("rank")))
    per = marked.groupBy("model", "query_id").agg(first.alias("first"), F.count_if((F.col("pos") == 1) & (F.col("rank") <= 5)).alias("in5"))
    hit = lambda k: F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"hit_{k}")
    quality = per.groupBy("model").agg(hit(1), hit(3), hit(5), F.avg(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"), F.avg(F.col("in5") / 5.0).alias("precision_5"))
    mean = lambda of, name: scores.join(of.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("model").agg(F.avg("score").alias(name))
    out = quality.join(mean(relevant, "_p"), "model", "left").join(mean(negatives, "_n"), "model", "left")
    return out.select(*quality.columns, (F.col("_p") - F.col("_n")).alias("margin"))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
