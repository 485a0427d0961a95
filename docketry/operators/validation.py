"""Validation and profiles of chunk tables, vector tables and question tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import estimate_tokens, lower_words, strip, word_total
from docketry.operators.quantiles import index_quantiles


def validate(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """V1: (valid rows, invalid rows with an array ``violations``); a rule is a name and a condition that must hold (null does not)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = rows.withColumn("violations", broken)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def chunk_rules(required: Sequence[str] = ("chunk_id", "content")) -> dict[str, Column]:
    """V1: the rules of chunks: required texts, an index of 0 or more, dates of the calendar, a point only under a clause or an article."""
    from docketry.functions.dates import parse_legal_date

    rules = {f"{c}_empty": strip(F.col(c).cast("string")) != "" for c in required}
    rules["chunk_index"] = F.col("chunk_index") >= 0
    return rules | {"issue_date": F.col("issue_date").isNull() | parse_legal_date(F.col("issue_date")).isNotNull(), "orphan_point": F.col("point").isNull() | F.col("clause").isNotNull() | F.col("article").isNotNull()}


def duplicate_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """V2: rows whose key came before, by ``order``."""
    return rows.withColumn("_turn", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_turn > 1").drop("_turn")


def token_profile(rows: DataFrame, text: str, edges: Sequence[int] = (100, 350, 800)) -> DataFrame:
    """V3: count, least, most, mean and median of token estimates, and count and percent of each size class; one row."""
    t = rows.select(estimate_tokens(F.col(text)).alias("t"))
    bounds = [(None, edges[0]), *zip(edges, edges[1:], strict=False), (edges[-1], None)]

    def inside(k: int) -> Column:
        low, high = bounds[k]
        ok = F.lit(True) if low is None else F.col("t") >= low if k == 1 else F.col("t") > low
        return ok if high is None else ok & (F.col("t") < high if low is None else F.col("t") <= high)

    counts = [F.count_if(inside(k)).alias(f"class_{k}") for k in range(len(bounds))]
    out = t.agg(F.count("t").alias("n"), F.min("t").alias("least"), F.max("t").alias("most"), F.avg("t").alias("mean"), F.median("t").alias("median"), *counts)
    return out.withColumns({f"percent_{k}": F.round(100.0 * F.col(f"class_{k}") / F.col("n"), 2) for k in range(len(bounds))})


def type_distribution(rows: DataFrame, column: str, default: str = "article") -> DataFrame:
    """V4: counts of a column's values, null as ``default``."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(default)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, columns: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """V5: per column how many values are there (not null, empty or ``unknown``), how many are ``unknown``, and the percent there."""
    there = lambda c: F.coalesce(~F.col(c).cast("string").isin("", unknown), F.lit(False))
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(there(c)).alias(f"t_{c}") for c in columns], *[F.count_if(F.col(c).cast("string") == unknown).alias(f"u_{c}") for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"t_{c}").alias("there"), F.col(f"u_{c}").alias("unknown")) for c in columns])).alias("f")
    return one.select("total", pairs).select("f.*", F.round(100.0 * F.col("f.there") / F.col("total"), 2).alias("percent"))


def corpus_summary(rows: DataFrame, by: str, text: str) -> DataFrame:
    """V6: per group the number of rows, and of characters and words the least, most, mean, and index-style median and P95."""
    sizes = rows.select(by, F.length(text).alias("chars"), word_total(F.col(text)).alias("words"))
    out = sizes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("chars", "words") for name, f in (("least", F.min), ("most", F.max), ("mean", F.avg))])
    for c in ("chars", "words"):
        out = out.join(index_quantiles(sizes, [by], c, {f"median_{c}": 0.5, f"p95_{c}": 0.95}), by)
    return out


def index_audit(chunks: DataFrame, vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """V7: (problem, key) of vectors without a chunk, chunks without a vector and vectors of another dimension."""
    ids = lambda df: df.select(key).distinct()
    tell = lambda df, what: df.select(F.lit(what).alias("problem"), key)
    orphans, missing = ids(vectors).join(ids(chunks), key, "left_anti"), ids(chunks).join(ids(vectors), key, "left_anti")
    return tell(orphans, "orphan_vector").unionByName(tell(missing, "unindexed_chunk")).unionByName(tell(vectors.filter(F.size(vector) != size), "dimension"))


def validate_questions(questions: DataFrame, gold: DataFrame, chunks: DataFrame, pattern: str = r"^Q\d{3}$") -> DataFrame:
    """V8: (query_id, problem): an id off the pattern, a text (trimmed, lower case) seen before, a refusal with gold, an answer without gold, gold that is no chunk.

    ``questions``: query_id, text, requires_refusal; ``gold``: query_id, doc_id; ``chunks``: doc_id.
    """
    tell = lambda df, what: df.select("query_id", F.lit(what).alias("problem"))
    same = questions.withColumn("_text", F.lower(strip(F.col("text"))))
    repeated = same.withColumn("_turn", F.row_number().over(W.partitionBy("_text").orderBy("query_id"))).filter("_turn > 1")
    has = gold.select("query_id").distinct()
    parts = [
        tell(questions.filter(~F.col("query_id").cast("string").rlike(pattern)), "id"), tell(repeated, "duplicate_text"),
        tell(questions.filter("requires_refusal").join(has, "query_id", "left_semi"), "refusal_with_gold"), tell(questions.filter("NOT requires_refusal").join(has, "query_id", "left_anti"), "no_gold"),
        tell(gold.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("query_id").distinct(), "unknown_gold"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def question_groups(questions: DataFrame, by: str) -> DataFrame:
    """Per category count, percent of all, answerable, refusals and their percent."""
    out = questions.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("requires_refusal")).alias("answerable"), F.count_if("requires_refusal").alias("refusals"))
    return out.withColumns({"percent": F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2), "refusal_percent": F.round(100.0 * F.col("refusals") / F.col("n"), 2)})


def document_coverage(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Per document its chunks and how often questions cite it."""
    cited = gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("citations"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")).join(cited, "doc_id", "left").fillna(0, ["citations"])


def table_checksum(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and an order-free checksum of the named columns: the sum of the first 48 bits of each row's SHA-256, repeats counted."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    part = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(part), F.lit(0)) % F.lit(2**48)).cast("long").alias("checksum"))


def validity_audit(gold: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """(query_id, doc_id, status, suggested) of gold documents that are replaced or repealed as of a date; ``edges``: doc_id, status, since, replaced_by."""
    hits = gold.join(edges.filter(F.col("since") <= as_of), "doc_id")
    return hits.select("query_id", "doc_id", "status", F.col("replaced_by").alias("suggested"))


def lost_words(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, word) of words of a document's text that none of its chunks holds. Arrays of one document at a time are compared, so words are not shuffled one by one."""
    held = chunks.select("doc_id", F.array_distinct(lower_words(F.col("content"))).alias("ws")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("held"))
    own = docs.select("doc_id", F.array_distinct(lower_words(F.col("text"))).alias("own")).join(held, "doc_id", "left")
    return own.select("doc_id", F.explode(F.array_except("own", F.coalesce("held", F.array().cast("array<string>")))).alias("word"))


def text_loss(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, words, lost): how many different words a document has, and how many of them none of its chunks holds; one row a document, its text cut into words once."""
    held = chunks.select("doc_id", F.array_distinct(lower_words(F.col("content"))).alias("ws")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("held"))
    own = docs.select("doc_id", F.array_distinct(lower_words(F.col("text"))).alias("own")).join(held, "doc_id", "left")
    return own.select("doc_id", F.size("own").alias("words"), F.size(F.array_except("own", F.coalesce("held", F.array().cast("array<string>")))).cast("long").alias("lost"))


def lost_lines(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """V14 by lines: (doc_id, line) of lines of a document that are in none of its chunks, white space aside.

    ``docs`` has (doc_id, text), ``chunks`` (doc_id, content). The chunks of a document are looked at together.
    """
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    held = chunks.groupBy("doc_id").agg(F.array_join(F.collect_list(flat(F.col("content"))), "\n").alias("held"))
    own = docs.select("doc_id", F.transform(F.split("text", "\r?\n"), lambda x: F.trim(flat(x))).alias("own")).join(held, "doc_id", "left")
    lost = F.filter("own", lambda x: (x != "") & ~F.coalesce(F.contains(F.col("held"), x), F.lit(False)))
    return own.select("doc_id", F.explode(lost).alias("line"))


def question_status(questions: DataFrame, gold: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """V9: (query_id, status); later rules overwrite: VALID, INVALID (a refusal with gold or an answer without), CORPUS_MISMATCH (gold that is no chunk), INDEX_MISMATCH (gold without a vector)."""
    known = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    marked = gold.join(known(chunks, "_c"), "doc_id", "left").join(known(vectors, "_v"), "doc_id", "left")
    per = marked.groupBy("query_id").agg(F.bool_and(F.col("_c").isNotNull()).alias("corpus"), F.bool_and(F.col("_v").isNotNull()).alias("index"))
    rows = questions.join(per, "query_id", "left")
    status = F.when(~F.col("index"), "INDEX_MISMATCH").when(~F.col("corpus"), "CORPUS_MISMATCH").when(F.col("requires_refusal") == F.col("corpus").isNotNull(), "INVALID").otherwise("VALID")
    return rows.select("query_id", status.alias("status"))
