"""Refinement of evidence, context packing under a budget, and citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import WHITE, estimate_tokens, once, one_of, source_tags, strip

# Stop words of strip scoring, and the words that its pairs leave out.
STRIP_STOP_WORDS = (
    "là gì thế nào ở đâu khi bao nhiêu theo quy định pháp luật cho tôi biết với về của và các những được bị có không phải người lao động sử dụng thì trong trường hợp mỗi ngày năm tháng"
).split()
PAIR_STOP_WORDS = ("người", "lao", "động", "và", "có", "bị")
HEADING = r"(?iu)^Điều\s+\d+"
MARK = "\x01"


def strips_of(content: Column, heading: str = HEADING, longest: int = 250) -> Column:
    """Array of strips: lines; headings whole; else cut before ``N. ``, and a piece over ``longest`` characters after sentence ends."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), strip), lambda s: s != "")
    clauses = lambda s: F.split(F.regexp_replace(s, rf"(?<![\p{{L}}\p{{N}}_])(\d+\.{WHITE}+)", MARK + "$1"), MARK)
    sentences = lambda s: F.split(F.regexp_replace(s, rf"([.!?]){WHITE}+", "$1" + MARK), MARK)
    tidy = lambda a: F.filter(F.transform(a, strip), lambda s: s != "")
    cut = lambda s: F.flatten(F.transform(tidy(clauses(s)), lambda c: F.when(F.length(c) > longest, tidy(sentences(c))).otherwise(F.array(c))))
    return F.flatten(F.transform(lines, lambda s: F.when(s.rlike(heading), F.array(s)).otherwise(cut(s))))


def strip_terms(query: Column, stop_words: Sequence[str] = STRIP_STOP_WORDS, pair_stops: Sequence[str] = PAIR_STOP_WORDS) -> tuple[Column, Column]:
    """The words of a query that a strip is searched for, and its pairs of neighbouring words of more than five characters."""
    asked = F.lower(F.coalesce(query, F.lit("")))
    tokens = F.filter(F.regexp_extract_all(asked, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: (F.length(w) > 1) & ~one_of(w, stop_words))
    words = F.filter(F.split(asked, rf"{WHITE}+"), lambda w: (w != "") & ~one_of(w, pair_stops))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return tokens, F.filter(pairs, lambda p: p.isNotNull() & (F.length(p) > 5))


def strip_score(text: Column, query: Column, score: Column, terms: tuple[Column, Column] | None = None, heading: str = HEADING) -> Column:
    """Score of a strip for a query, given the score of its chunk, rounded to four places. ``terms``: those of ``strip_terms``, if they are known."""
    low, asked = F.lower(text), F.lower(F.coalesce(query, F.lit("")))
    tokens, pairs = terms or strip_terms(query)
    hits = once(low, lambda x: F.size(F.filter(tokens, lambda w: x.contains(w))))
    bonus = 0.2 * once(low, lambda x: F.size(F.filter(pairs, lambda p: x.contains(p))))
    named = F.regexp_extract(text, r"(?iu)^Điều\s+(\d+)", 1)
    head = F.when((named != "") & asked.contains(named), 1.0).otherwise(0.75)
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 * score + 0.5 * hits / F.size(tokens) + F.least(F.lit(0.25), bonus)))
    body = F.when(F.size(tokens) == 0, score * 0.5).when((hits == 0) & (bonus == 0), F.least(F.lit(0.35), score * 0.3)).otherwise(mixed)
    return F.round(F.when(text.rlike(heading), head).otherwise(body), 4)


def split_strips(chunks: DataFrame, heading: str = HEADING) -> DataFrame:
    """Rows (query_id, doc_id, score, query, ..., strip_no from 0, strip) of rows with ``content``; the other columns stay."""
    tokens, pairs = strip_terms(F.col("query"))  # once a chunk, not once a strip
    return chunks.select(*[c for c in chunks.columns if c != "content"], tokens.alias("_tokens"), pairs.alias("_pairs"), F.posexplode(strips_of(F.col("content"), heading)).alias("strip_no", "strip"))


def filter_strips(strips: DataFrame, threshold: float = 0.50, heading: str = HEADING) -> DataFrame:
    """Strips that reach ``threshold`` and headings; if no other strip of a chunk does, its best one too (the first of equals)."""
    by = W.partitionBy("query_id", "doc_id")
    head = F.col("strip").rlike(heading)
    terms = (F.col("_tokens"), F.col("_pairs")) if "_tokens" in strips.columns else None
    marked = strips.withColumns({"is_heading": head, "strip_score": strip_score(F.col("strip"), F.col("query"), F.col("score"), terms, heading)}).drop("_tokens", "_pairs")
    body = ~F.col("is_heading")
    best = F.max(F.when(body, F.struct("strip_score", (-F.col("strip_no")).alias("n")))).over(by)
    enough = F.max(F.when(body, F.col("strip_score"))).over(by) >= threshold
    marked = marked.withColumns({"_best": -best["n"], "_enough": enough})
    return marked.filter((F.col("strip_score") >= threshold) | F.col("is_heading") | (~F.col("_enough") & body & (F.col("strip_no") == F.col("_best")))).drop("_best", "_enough")


def recompose(strips: DataFrame, most: int = 3500, least_rest: int = 200) -> DataFrame:
    """(query_id, context, n_sources, compression) of kept strips with ``rank`` and ``full_length`` of their chunks.

    Chunks become numbered blocks in rank order; the first block that goes over ``most`` characters is cut if more than ``least_rest`` are left, and ends the context.
    """
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("strip_no", "strip"))), lambda s: s["strip"]), "\n")
    blocks = strips.groupBy("query_id", "doc_id").agg(F.first("rank").alias("rank"), F.first("full_length").alias("full_length"), body.alias("body"))
    order = W.partitionBy("query_id").orderBy("rank", "doc_id")
    blocks = blocks.withColumn("n", F.row_number().over(order)).withColumn("block", F.concat(F.lit("[SOURCE "), F.col("n").cast("string"), F.lit("]\n"), F.col("body"), F.lit("\n")))
    before = F.coalesce(F.sum(F.length("block")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.lit(most) - before).cast("int")
    cut = F.when(F.length("block") <= room, F.col("block")).when(room > least_rest, F.expr("substring(block, 1, room)"))
    parts = blocks.withColumn("room", room).withColumn("cut", cut).filter("cut IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cut"))), lambda s: s["cut"]), "")
    out = parts.groupBy("query_id").agg(joined.alias("context"), F.count(F.lit(1)).alias("n_sources"))
    full = blocks.groupBy("query_id").agg(F.sum("full_length").alias("full"))
    return out.join(full, "query_id").select("query_id", "context", "n_sources", F.round(F.greatest(F.lit(0.0), 1 - F.length("context") / F.col("full")), 4).alias("compression"))


def pack_context(chunks: DataFrame, budget: int = 3000, separator: int = 5) -> DataFrame:
    """Rows (query_id, doc_id, rank, content) with ``tokens`` and ``included``: one row a document, in rank order, until the first whose tokens (and separator) go over the budget."""
    once = chunks.withColumn("_turn", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank"))).filter("_turn = 1").drop("_turn")
    order = W.partitionBy("query_id").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    sized = once.withColumn("tokens", estimate_tokens(F.col("content")))
    used = F.sum(F.col("tokens") + F.lit(separator)).over(order)
    return sized.withColumn("included", used - F.lit(separator) <= budget).withColumn("included", F.min("included").over(order))


def sectioned_context(rows: DataFrame, most: int = 4000) -> DataFrame:
    """(query_id, context) of rows (query_id, sub_no, sub_query, rank, content): a section for each sub-query, its sources whole, numbered through.

    A source that would take all sources (a line end each) over ``most`` characters ends its section; headings do not count. A later section may still have room.
    """
    line = lambda s, r: F.concat(F.lit("[SOURCE "), (s["n"] + 1).cast("string"), F.lit("] "), F.coalesce(r["content"], F.lit("")))

    def step(s: Column, r: Column) -> Column:
        new = ~s["sub"].eqNullSafe(r["sub_no"])
        text = F.when(s["started"] & new, F.concat(s["text"], F.lit("\n\n"))).otherwise(s["text"])
        text = F.when(~s["started"] | new, F.concat(text, F.lit("## "), F.coalesce(r["sub_query"], F.lit("")))).otherwise(text)
        open_ = ~s["started"] | new | s["open"]
        fits = open_ & (s["used"] + F.length(line(s, r)) + 1 <= most)
        return F.struct(
            F.when(fits, F.concat(text, F.lit("\n"), line(s, r))).otherwise(text).alias("text"), F.when(fits, s["used"] + F.length(line(s, r)) + 1).otherwise(s["used"]).alias("used"),
            F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), r["sub_no"].alias("sub"), fits.alias("open"), F.lit(True).alias("started"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(None).cast(rows.schema["sub_no"].dataType).alias("sub"), F.lit(True).alias("open"), F.lit(False).alias("started"))
    ordered = F.array_sort(F.collect_list(F.struct("sub_no", "rank", "content", "sub_query")))
    return rows.groupBy("query_id").agg(ordered.alias("parts")).select("query_id", F.aggregate("parts", start, step, lambda s: s["text"]).alias("context"))


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers (answer_id, text) with ``[SOURCE n]`` tags replaced by the citation of source n, unknown tags removed and listed.

    ``sources``: (answer_id, n, citation). Adds text, resolved (array of n) and invalid (array of n).
    """
    tagged = answers.withColumn("tags", source_tags(F.col("text")))
    known = sources.groupBy("answer_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("n").cast("int"), "citation")))).alias("known"))
    rows = tagged.join(known, "answer_id", "left")
    there = lambda n: F.coalesce(F.map_contains_key("known", n), F.lit(False))
    swap = lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"\[SOURCE\s+0*"), n.cast("string"), F.lit(r"\]")), F.regexp_replace(F.coalesce(F.element_at("known", n), F.lit("")), r"([\\$])", r"\\$1"))
    return rows.select(
        "answer_id", F.aggregate("tags", F.coalesce("text", F.lit("")), swap).alias("text"), F.filter("tags", there).alias("resolved"), F.filter("tags", lambda n: ~there(n)).alias("invalid"),
    )
