"""Usage history: filters, statistics, sessions, feedback and cost over answer-log rows.

Rows have id, session_id, ts, model_name, route_taken, query, answer, is_refused, total_latency_ms, input_tokens, output_tokens, estimated_cost_usd, user_rating.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import floor_tokens

USD_IN, USD_OUT = 0.15, 0.60


def estimate_cost(input_tokens: Column, output_tokens: Column, usd_in: float = USD_IN, usd_out: float = USD_OUT) -> Column:
    """H7: dollars at prices per million tokens, rounded to six places."""
    return F.round((input_tokens * F.lit(usd_in) + output_tokens * F.lit(usd_out)) / 1e6, 6)


def with_token_estimates(rows: DataFrame, query: str = "query", answer: str = "answer") -> DataFrame:
    """H7: input and output tokens by words, and their cost."""
    rows = rows.withColumns({"input_tokens": floor_tokens(F.col(query)), "output_tokens": floor_tokens(F.col(answer))})
    return rows.withColumn("estimated_cost_usd", estimate_cost(F.col("input_tokens"), F.col("output_tokens")))


def history(rows: DataFrame, session: object = None, model: str | None = None, route: str | None = None, refused: bool | None = None, keyword: str | None = None,
            start: object = None, end: object = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """H1: rows that meet all given conditions (time bounds inclusive, the keyword in the query or the answer in any case), newest first."""
    for column, value in (("session_id", session), ("model_name", model), ("route_taken", route), ("is_refused", refused)):
        if value is not None:
            rows = rows.filter(F.col(column) == F.lit(value))
    if keyword:
        rows = rows.filter(F.lower("query").contains(keyword.lower()) | F.lower("answer").contains(keyword.lower()))
    rows = rows if start is None else rows.filter(F.col("ts") >= F.lit(start))
    rows = rows if end is None else rows.filter(F.col("ts") <= F.lit(end))
    rows = rows.orderBy(F.col("ts").desc(), F.col("id").desc())
    return rows.offset(offset) if limit is None else rows.offset(offset).limit(limit)


def history_stats(rows: DataFrame) -> DataFrame:
    """H2: rows (kind, value, n, ...): the totals, and counts by model, route and rating (nulls left out)."""
    total = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("is_refused").cast("double")), F.lit(0.0)).alias("refusal_rate"), F.avg("total_latency_ms").alias("mean_latency_ms"),
        F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"), F.sum("estimated_cost_usd").alias("cost_usd"),
    )
    out = total.select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value"), "*")
    keys = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in ("model_name", "route_taken", "user_rating")])
    parts = rows.select(F.explode(keys).alias("k")).filter("k.value IS NOT NULL").groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(parts, allowMissingColumns=True)


def sessions(rows: DataFrame, titles: DataFrame, keyword: str | None = None, limit: int | None = None) -> DataFrame:
    """H3: per session its count, latest query and time, and title (else its first query); only those with the keyword in the title or a row."""
    first, last = F.struct("ts", "id"), F.struct("ts", "id")
    per = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("query", last).alias("latest_query"), F.max("ts").alias("latest"), F.min_by("query", first).alias("first_query"))
    out = per.join(titles.select("session_id", "title"), "session_id", "left")
    if keyword:
        word = keyword.lower()
        told = rows.filter(F.lower("query").contains(word) | F.lower("answer").contains(word)).select("session_id")
        named = out.filter(F.lower("title").contains(word)).select("session_id")
        out = out.join(told.unionByName(named).distinct(), "session_id", "left_semi")
    out = out.select("session_id", F.coalesce("title", "first_query").alias("title"), "n", "latest_query", "latest").orderBy(F.col("latest").desc(), "session_id")
    return out if limit is None else out.limit(limit)


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """H4: sessions (session_id, title, created_at, updated_at); a known one keeps its creation and gets the new time, and the new title if there is one."""
    both = old.alias("o").join(new.alias("n"), "session_id", "full")
    return both.select("session_id", F.coalesce("n.title", "o.title").alias("title"), F.coalesce("o.created_at", "n.created_at").alias("created_at"), F.coalesce("n.updated_at", "o.updated_at").alias("updated_at"))


def apply_feedback(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """H5: by id, the given fields of ``updates`` (id, user_rating, user_feedback) replace the old ones; null leaves a field as it is."""
    fields = [c for c in ("user_rating", "user_feedback") if c in updates.columns]
    new = updates.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = rows.join(new, "id", "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def delete_rows(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """H6: without the rows whose ``key`` is in ``gone``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
