"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ``window`` words (a shorter item is one window), a window into shingles of ``width`` words. A document holds a window only
if it holds all its shingles, so of the shingles in order of rarity (occurrences in all documents) a prefix of one is necessary: documents are joined to
windows on that rarest shingle alone. The places of both give the only start that the window can have; it must lie within the document (position) with room for
the whole window (length). What is left is verified word by word.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import stash, table

#: Words of a window and of a shingle.
WINDOW, WIDTH = 10, 5
#: Rows of a table that is broadcast (a few numbers a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Runs of digits, small ASCII letters and anything above ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none if it is null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def shingles(words: Column, width: int) -> Column:
    """(place, hash) of each run of ``width`` words; none if there are fewer."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    every = F.transform(places, lambda k: F.struct(k.alias("place"), F.xxhash64(F.slice(words, k + 1, width)).alias("shingle")))
    return F.filter(every, lambda _: F.size(words) >= width)


def _few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count shows it to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(name, content, size) of the distinct windows of each item; a null id is the empty name, an item without words has none."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("size", F.least(F.size("words"), F.lit(window)))
    cut = rows.select("name", "size", F.explode(F.expr("transform(sequence(0, size(words) - size), k -> array_join(slice(words, k + 1, size), ' '))")).alias("content"))
    return cut.select("name", "content", "size").distinct()


def covered(spans: Column) -> Column:
    """Places that sorted (start, stop) spans cover."""
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(F.greatest(acc["stop"], s["stop"]).alias("stop"), (acc["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["stop"]))).alias("total"))
    return F.aggregate(spans, zero, step, lambda acc: acc["total"])


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, width: int = WIDTH
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted names of the items with occurring windows), contaminated.

    A word is hit if an occurrence of a window covers it. Null and empty texts have no words; an item without words has no window; items of one id count
    once, and a null item id is the empty name; repeated rows and null ids of documents each keep their row. Without documents there are no rows, without items no hits. Other
    columns are not read.

    Documents are cut into words once and written. Shingles that no window has stop at the first join, so what is shuffled are occurrences of benchmark
    shingles, never texts, unless over ``BROADCAST_ROWS`` places are to be verified. Names are gathered once for each distinct set of windows, so copies
    of a document cost one row.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    docs = stash(docs, "leak-words")
    held = stash(item_windows(items, item_col, item_text, window), "leak-items")
    windows = held.select("content", "size").distinct().select(F.monotonically_increasing_id().alias("window"), "content", "size")
    windows = stash(windows, "leak-windows")
    widths = sorted(r["w"] for r in windows.select(F.least("size", F.lit(width)).alias("w")).distinct().collect())
    if not widths:
        return docs.select("doc_id", F.size("words").cast("long").alias("n_words"), *[F.lit(0).cast("long").alias(c) for c in ("n_hit", "n_items")], F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    parts = [windows.filter(F.least("size", F.lit(width)) == w).select("window", "size", F.explode(shingles(F.split("content", " "), w)).alias("s")) for w in widths]
    of_windows = parts[0]
    for part in parts[1:]:
        of_windows = of_windows.unionByName(part)
    of_windows = stash(of_windows.select("window", "size", "s.place", "s.shingle"), "leak-shingles")

    every = docs.select("row", F.size("words").alias("length"), F.explode(F.concat(*[shingles(F.col("words"), w) for w in widths])).alias("s"))
    known = _few(of_windows.select("shingle").distinct())
    hits = stash(every.select("row", "length", "s.place", "s.shingle").join(known, "shingle", "left_semi"), "leak-hits")

    rarity = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = of_windows.join(rarity, "shingle", "left").groupBy("window", "size").agg(F.min(F.struct("n", "shingle", "place")).alias("first"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    prefixes = stash(ranked.filter("whole").select("size", "first.shingle", F.col("first.place").alias("ahead")).distinct(), "leak-prefixes")
    start = (F.col("place") - F.col("ahead")).alias("start")
    places = hits.join(_few(prefixes), "shingle").select("row", "length", start, "size").filter("start >= 0 AND start + size <= length").select("row", "start", "size").distinct()
    places = stash(places, "leak-places")

    asked = places.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("at"))  # at most one for each word of the document and size of a window
    cut = docs.join(F.broadcast(asked) if places.count() <= BROADCAST_ROWS else asked, "row")
    cut = cut.select("row", F.explode(F.expr("transform(at, a -> struct(a.start, a.start + a.size AS stop, array_join(slice(words, a.start + 1, a.size), ' ') AS content))")).alias("a"))
    found = cut.select("row", "a.*").join(_few(windows.select("content", "window")), "content").select("row", "start", "stop", "window")
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    found = stash(found.groupBy("row").agg(covered(spans).alias("n_hit"), F.array_sort(F.collect_set("window")).alias("windows")), "leak-found")

    sets = stash(found.select("windows").distinct().withColumn("set", F.monotonically_increasing_id()), "leak-sets")
    named = sets.select("set", F.explode("windows").alias("window")).join(windows, "window").join(held.select("content", "name"), "content")
    named = named.groupBy("set").agg(F.array_sort(F.collect_set("name")).alias("items"))
    named = sets.join(named, "set").select("windows", "items")
    out = docs.select("row", "doc_id", F.size("words").cast("long").alias("n_words")).join(found.join(named, "windows").drop("windows"), "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_LOWER = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
_SLICE = "array_to_string(list_slice(ws, k + 1, k + m), ' ')"
# every run of words of every document against every window
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS name, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT name, m, {_SLICE} AS content FROM (SELECT name, ws, least(len(ws), 10) AS m, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS k FROM i WHERE len(ws) > 0)
), m AS (SELECT DISTINCT m FROM w), s AS (
  SELECT r, k, m, {_SLICE} AS content FROM (SELECT r, ws, m, unnest(range(0, len(ws) - m + 1)) AS k FROM d, m WHERE len(ws) >= m)
), hit AS (
  SELECT r, k, s.m, name FROM s JOIN w ON s.content = w.content
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS p FROM hit) GROUP BY r
), names AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM hit) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN names USING (r)
"""
