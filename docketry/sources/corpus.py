"""Reading corpora, questions and pages, and writing chunks, metrics and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import strip

META_FIELDS = ("so_hieu", "loai_van_ban", "co_quan_ban_hanh", "ngay_ban_hanh", "ngay_hieu_luc", "tinh_trang_hieu_luc", "doc_id", "source")
QUESTION_SCHEMA = (
    "question_id string, question string, category string, gold_sources array<struct<document_id: string, article_number: string, chunk_ids: array<string>>>,"
    " reference_answer string, requires_refusal boolean"
)
CSV_COLUMNS = (
    "id", "session_id", "ts", "model_name", "query", "intent", "complexity", "route_taken", "answer", "is_refused", "refusal_reason", "total_latency_ms", "total_tokens", "estimated_cost_usd", "user_rating",
)
LOG_FIELDS = ("question_id", "query", "answer", "is_refused", "refusal_reason", "route_taken", "sub_queries", "retrieved_chunks", "total_latency_ms", "input_tokens", "output_tokens", "system")


def read_corpus(spark: SparkSession, folder: str, fields: Sequence[str] = META_FIELDS) -> DataFrame:
    """One row per ``<id>.txt`` with its text and the fields of ``<id>_meta.json``; a text without metadata keeps null fields."""
    name = lambda end: F.regexp_extract(F.input_file_name(), rf"([^/]+){end}$", 1)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(name(r"\.txt").alias("id"), F.col("value").alias("text"))
    metas = spark.read.schema(", ".join(f"{f} string" for f in fields)).json(f"{folder}/*_meta.json", multiLine=True).withColumn("id", name(r"_meta\.json"))
    return texts.join(metas, "id", "left").withColumn("id", F.url_decode("id"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array with the fixed schema."""
    return spark.read.schema(QUESTION_SCHEMA).json(path, multiLine=True)


def explode_gold(questions: DataFrame) -> DataFrame:
    """S3: distinct (question_id, document_id, article_number, chunk_id); a source without chunk ids keeps its pair with a null chunk."""
    sources = questions.select("question_id", F.explode("gold_sources").alias("g"))
    return sources.select("question_id", "g.document_id", "g.article_number", F.explode_outer("g.chunk_ids").alias("chunk_id")).distinct()


def html_to_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; common entities read; no BOM or CR; blanks and empty lines collapsed; trimmed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "\n"), r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(F.translate(out, " ﻿\r", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))


def page_fields(html: Column, labels: Mapping[str, str], rows: str = r"(?is)<t[dh][^>]*>([^<]*)</t[dh]>\s*<t[dh][^>]*>([^<]*)</t[dh]>") -> Column:
    """Struct of one text for each of ``labels`` (field -> part of a label, any case): the value of the first label/value row whose label holds it, else of the
    first "label: value" line of the text; null if neither is there.
    """
    names, values = F.regexp_extract_all(html, F.lit(rows), 1), F.regexp_extract_all(html, F.lit(rows), 2)
    pairs = F.zip_with(names, values, lambda a, b: F.struct(F.lower(strip(a)).alias("label"), strip(b).alias("value")))
    lines = F.split(html_to_text(html), "\n")

    def field(part: str) -> Column:
        row = F.get(F.filter(pairs, lambda p: p["label"].contains(part.lower()) & (p["value"] != "")), F.lit(0))["value"]
        line = F.get(F.filter(lines, lambda x: F.contains(F.lower(F.substring_index(x, ":", 1)), F.lit(part.lower())) & x.contains(":")), F.lit(0))
        return F.coalesce(row, F.nullif(strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))), F.lit("")))

    return F.struct(*[field(part).alias(name) for name, part in labels.items()])


def extract_page_metadata(pages: DataFrame, labels: Mapping[str, str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S4 over a table: the id and one column for each of ``labels``."""
    return pages.select(id_col, page_fields(F.col(html_col), labels).alias("f")).select(id_col, "f.*")


def write_chunks(chunks: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The core columns as JSON lines, nulls kept."""
    chunks.select(*columns).write.json(path, ignoreNullFields=False)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metric table as CSV with a header."""
    metrics.write.option("header", True).csv(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Answer-log rows added to a table that is partitioned by day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def unify_logs(plain: DataFrame, corrective: DataFrame, adaptive: DataFrame) -> DataFrame:
    """Three response shapes as one log; absent fields are null, and the corrective system's rewritten query is its only sub-query."""
    corrective = corrective.withColumn("sub_queries", F.array_compact(F.array("rewritten_query")))
    parts = [df.withColumn("system", F.lit(name)) for df, name in ((plain, "plain"), (corrective, "corrective"), (adaptive, "adaptive"))]
    parts = [df.select(*[c for c in LOG_FIELDS if c in df.columns]) for df in parts]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select(*[c for c in LOG_FIELDS if c in out.columns])


def export_history(rows: DataFrame, path: str, kind: str = "json", session: object = None) -> None:
    """A log as JSON lines, or as CSV with its fixed columns; one session only, if given."""
    rows = rows if session is None else rows.filter(F.col("session_id") == F.lit(session))
    if kind == "csv":
        rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]).write.option("header", True).csv(path)
    else:
        rows.write.json(path, ignoreNullFields=False)


def parse_history_json(rows: DataFrame, columns: Sequence[str] = ("citations", "retrieved_chunks", "sub_queries")) -> DataFrame:
    """Columns of JSON arrays as arrays of texts; null and broken values become empty arrays."""
    return rows.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in columns})
