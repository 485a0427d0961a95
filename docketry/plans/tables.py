"""Reading the given tables, and SQL snippets that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.functions.text import INDEX_STOP_WORDS
from docketry.operators.lexical import LexicalIndex


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_INDEXES: dict[tuple[str, str, bool], LexicalIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str, positional: bool = False) -> LexicalIndex:
    """The lexical index of ``documents``, built at its first use in the application: later queries on the same corpus cut no text."""
    key = (spark.sparkContext.applicationId, sf_dir, positional)
    if key not in _INDEXES or not _INDEXES[key].exists():
        _INDEXES[key] = LexicalIndex.create(load(spark, sf_dir, "documents").select("doc_id", "text"), positional=positional)
    return _INDEXES[key]


STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in INDEX_STOP_WORDS) + "]"


def lower_words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+'), lambda w: w <> '')"


def terms_sql(text: str) -> str:
    """SQL for ``index_terms``."""
    stopped = lambda x: f"list_contains({STOPS_SQL}, {x})"
    return f"""(SELECT list_concat(list_filter(ws, lambda w: len(w) >= 2 AND NOT {stopped("w")}),
      list_transform(list_filter(range(1, len(ws)), lambda i: NOT {stopped("ws[i]")} OR NOT {stopped("ws[i + 1]")}), lambda i: ws[i] || '_' || ws[i + 1])) FROM (SELECT {lower_words_sql(text)} AS ws))"""
