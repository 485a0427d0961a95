"""Corpus pipeline over ``documents``: STAGES are applied in order, each written as Parquet and read again.

Every stage works on all rows its predecessor kept. Null texts pass through as empty documents would; columns beyond
those of ``documents`` are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.mixing import emit
from docketry.llm.packing import default_tokenizer, pack_documents
from docketry.llm.quality import with_quality
from docketry.llm.secret_scan import labelled_samples, redact, train_markov
from docketry.llm.shared import stash, table
from docketry.llm.simhash import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.3 or more)."""
    scored = with_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), name="_score")
    return scored.filter("_score >= 0.3").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: fingerprints within eight bits by the Gray index, five-word Jaccard similarity of 0.8 or more."""
    return keep_one(docs.select(*COLUMNS))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of every secret; ``n_chars`` follows the text."""
    docs = docs.select(*COLUMNS)
    return redact(docs, train_markov(labelled_samples(docs))).selectExpr(*COLUMNS[:-1], "CAST(length(text) AS BIGINT) AS n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight says."""
    return emit(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most 2048 tokens."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier, fingerprints and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
