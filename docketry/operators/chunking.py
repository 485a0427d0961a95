"""Chunking: sentence packing with overlap, merging and splitting of pieces, ids.

The folds (what fits depends on what was packed before) run as Arrow batches over arrays of one document's pieces; the rest is expressions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import WHITE_SIGNS, content_hash_id, estimate_tokens, restore_metadata
from docketry.operators.appendices import appendix_units
from docketry.operators.structure import (
    APPENDIX,
    HEADINGS,
    by_line,
    carry_hierarchy,
    clauses_and_points,
    flag_appendix_start,
    flag_headings,
    join_title_lines,
    reject_references,
    to_lines,
)
from docketry.sources.scratch import written


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens; a token estimate is ceil(words x per_word)."""

    least: int = 100
    target: int = 350
    most: int = 800
    overlap: int = 50
    header: int = 35
    per_word: float = 1.3

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most or not 0 <= self.overlap < self.least:
            raise ValueError(f"sizes are not in order: {self}")

    def tokens(self, text: str) -> int:
        return math.ceil(len(text.split()) * self.per_word)

    def words(self, tokens: int) -> int:
        return max(1, int(tokens / self.per_word))


SENTENCE_END = re.compile(r"(?<=[;\n])\s+|(?<!\d)\.(?!\d)\s+")


def pack_text(text: str, config: ChunkConfig, prefix: str = "", most: int | None = None) -> list[str]:
    """K2: pieces of at most ``most`` tokens cut at sentences, with the last sentences of up to ``overlap`` tokens repeated; a longer sentence is cut by words. Every piece starts with ``prefix``."""
    most = config.most if most is None else most
    if config.tokens(text) <= most:
        return [text]
    room = max(config.least, most - config.tokens(prefix))
    pieces: list[str] = []
    held: list[str] = []
    sizes: list[int] = []  # tokens of the sentences in held

    def put(body: str) -> None:
        pieces.append(f"{prefix}\n{body}".strip() if prefix else body)

    for sentence in filter(None, map(str.strip, SENTENCE_END.split(text))):
        size = config.tokens(sentence)
        if size > room:
            if held:
                put(" ".join(held))
                held, sizes = [], []
            words, width, back = sentence.split(), config.words(room), config.words(config.overlap)
            at = 0
            while at < len(words):
                put(" ".join(words[at : at + width]))
                if at + width >= len(words):
                    break
                at = max(at + 1, at + width - back)
            continue
        if held and sum(sizes) + size > room:
            put(" ".join(held))
            first, total = len(held), 0
            while first and total + sizes[first - 1] <= config.overlap:
                first -= 1
                total += sizes[first]
            held, sizes = held[first:], sizes[first:]
        held.append(sentence)
        sizes.append(size)
    if held:
        put(" ".join(held))
    return pieces


def merge_short(pieces: Sequence[str], config: ChunkConfig, joint: str = "\n") -> list[str]:
    """K5: neighbours join while the last one is under ``least`` and both together are within ``target``."""
    out: list[str] = []
    for piece in pieces:
        if out and (held := config.tokens(out[-1])) < config.least and held + config.tokens(piece) <= config.target:
            out[-1] += joint + piece
        else:
            out.append(piece)
    return out


def merge_tail(pieces: Sequence[str], config: ChunkConfig, joint: str = "\n") -> list[str]:
    """K6: a last piece under ``least`` joins the one before if both together are within ``most``."""
    out = list(pieces)
    if len(out) > 1 and config.tokens(out[-1]) < config.least and config.tokens(out[-2]) + config.tokens(out[-1]) <= config.most:
        tail = out.pop()
        out[-1] += joint + tail
    return out


def merge_headers(pieces: Sequence[str], config: ChunkConfig, joint: str = "\n") -> list[str]:
    """K8: a piece under ``header`` tokens joins the next one if both together are within ``most``; chains of them too."""
    out: list[str] = []
    ahead = ""
    for piece in pieces:
        whole = ahead + joint + piece if ahead else piece
        if ahead and config.tokens(whole) > config.most:
            out.append(ahead)
            whole = piece
        ahead = ""
        if config.tokens(whole) < config.header:
            ahead = whole
        else:
            out.append(whole)
    return [*out, ahead] if ahead else out


def point_packs(points: Sequence[str], lead: str, config: ChunkConfig) -> list[range]:
    """K4: numbers of the points of each pack, up to ``target`` tokens with the clause's lead repeated; a small last pack joins the one before."""
    words, above = [len(p.split()) for p in points], len(lead.split())
    tokens = lambda n: math.ceil(n * config.per_word)
    packs: list[range] = []
    held = 0  # words of the last pack
    for k, size in enumerate(words):
        if packs and tokens(above + held + size) <= config.target:
            packs[-1] = range(packs[-1].start, k + 1)
            held += size
        else:
            packs.append(range(k, k + 1))
            held = size
    if len(packs) > 1 and tokens(held) < config.least and tokens(above + sum(words[packs[-2].start :])) <= config.most:
        packs[-2:] = [range(packs[-2].start, len(points))]
    return packs


def group_points(points: Sequence[str], lead: str, config: ChunkConfig) -> list[str]:
    """K4: the texts of :func:`point_packs`."""
    return ["\n".join(filter(None, [lead, *(points[k] for k in pack)])) for pack in point_packs(points, lead, config)]


def chunk_pieces(pieces: Sequence[str], config: ChunkConfig) -> list[str]:
    """K3, K5-K8 over the pieces of one document: whole if the document is within ``target``; else merged, and what is over ``most`` split."""
    pieces = [p for p in pieces if p]
    if config.tokens("\n".join(pieces)) <= config.target:
        return ["\n".join(pieces)] if pieces else []
    merged = merge_headers(merge_tail(merge_short(pieces, config), config), config)
    return [part for piece in merged for part in pack_text(piece, config)]


def packed(text: Column, config: ChunkConfig) -> Column:
    """K2 as a column: array of pieces; null and blank texts give an empty array."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([pack_text(t, config) if t and t.strip() else [] for t in texts], dtype=object)

    return pack(text)


def chunk_documents(docs: DataFrame, config: ChunkConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index from 0, chunk_id, content, tokens) of every document by its lines; null and blank texts have no chunks."""
    config = config or ChunkConfig()

    @F.pandas_udf("array<string>")
    def cut(lines: pd.Series) -> pd.Series:
        return pd.Series([chunk_pieces(list(ls), config) for ls in lines], dtype=object)

    lines = to_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    rows = lines.select("doc_id", F.posexplode(cut(F.transform("ls", lambda x: x["line"]))).alias("chunk_index", "content"))
    ident = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return rows.select("doc_id", "chunk_index", ident.alias("chunk_id"), "content", estimate_tokens(F.col("content"), config.per_word).alias("tokens"))


def assign_ids(rows: DataFrame, base: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K9: ``chunk_index`` from 0 in the document's order, ``chunk_id`` the ``base`` parts, with a suffix where a document has the id more than once."""
    name = F.regexp_replace(F.concat_ws("_", *[F.col(c).cast("string") for c in base]), r"\s+", "")
    index = F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1
    out = rows.withColumns({"chunk_index": index, "_name": name})
    turn = F.row_number().over(W.partitionBy("doc_id", "_name").orderBy("chunk_index"))
    return out.withColumn("chunk_id", F.concat(F.col("_name"), F.when(turn > 1, F.concat(F.lit("_"), turn.cast("string"))).otherwise(""))).drop("_name")


def hashed_ids(chunks: DataFrame) -> DataFrame:
    """C12 over chunks: an id from the content's hash."""
    return chunks.withColumn("hash_id", content_hash_id(F.col("doc_id").cast("string"), F.lit(""), F.col("content"), F.col("chunk_index")))


@dataclass
class Part:
    """A chunk of an article before it gets its document's fields."""

    name: str
    clause: str | None
    point: str | None
    content: str
    content_type: str
    can_merge: bool = False


def article_parts(number: str, title: str | None, lines: Sequence[str], config: ChunkConfig) -> list[Part]:
    """K3 to K6 for one article: whole within ``target``; else by clauses, and long clauses by packs of points with the clause's lead; short neighbours join."""
    heading = f"{number}. {title}" if title else number
    whole = "\n".join([heading, *lines])
    if config.tokens(whole) <= config.target:
        return [Part("", None, None, whole, "article")]
    clauses: list[tuple[int | None, str, list[tuple[str, str]]]] = []
    for piece in clauses_and_points(list(lines)):
        body = "\n".join(piece.lines)
        if piece.point is not None and clauses:
            clauses[-1][2].append((piece.point, f"{piece.point}) {body}"))
        elif piece.clause is not None:
            clauses.append((piece.clause, f"{piece.clause}. {body}", []))
        elif body.strip():
            clauses.append((None, body, []))
        else:
            clauses.append((None, "", []))
    out: list[Part] = []
    for at, (clause, lead, points) in enumerate(c for c in clauses if c[1] or c[2]):
        label = f"Khoản {clause}" if clause is not None else None
        name = f"_Khoản{clause}" if clause is not None else f"_C{at + 1}"
        text = "\n".join(filter(None, [lead, *(p for _, p in points)]))
        if not points:
            if config.tokens(text) > config.most:
                out += [Part(f"{name}_{k}", label, None, part, "clause") for k, part in enumerate(pack_text(text, config, heading), 1)]
            else:
                out.append(Part(name, label, None, text, "clause", can_merge=True))
        elif config.tokens(text) <= config.target:
            out.append(Part(name, label, None, f"{heading}\n{text}", "clause"))
        else:
            above = f"{heading}\n{lead}".strip()
            for k, pack in enumerate(point_packs([p for _, p in points], above, config), 1):
                first, last = points[pack[0]][0], points[pack[-1]][0]
                point = f"Điểm {first}" if first == last else f"Điểm {first} đến {last}"
                body = "\n".join([above, *(points[i][1] for i in pack)])
                cut = pack_text(body, config, above)
                out += [Part(f"{name}_P{k}" + (f"_{i}" if len(cut) > 1 else ""), label, point, part, "point") for i, part in enumerate(cut, 1)]
    if not out:  # all text is in the heading
        return [Part("", None, None, whole, "article")]
    joined: list[list[Part]] = []
    for part in out:
        held = joined[-1] if joined else None
        size = sum(config.tokens(p.content) for p in held) if held else 0
        if held and held[-1].can_merge and part.can_merge and size < config.least and size + config.tokens(part.content) <= config.target:
            held.append(part)
        else:
            joined.append([part])
    merged = []
    for held in joined:
        a, z = held[0], held[-1]
        label = f"{a.clause} đến {z.clause}" if a.clause and z.clause and a.clause != z.clause else a.clause or z.clause
        body = "\n\n".join(p.content for p in held)
        merged.append(Part(a.name, label, a.point, f"{heading}\n{body}" if a.can_merge else body, a.content_type))
    if len(merged) > 1 and config.tokens(merged[-1].content) < config.least and config.tokens(merged[-2].content) + config.tokens(merged[-1].content) <= config.most:
        tail = merged.pop()
        merged[-1].content += "\n\n" + tail.content
    return merged


def bounded_parts(parts: Sequence[Part], config: ChunkConfig) -> list[Part]:
    """K7: parts over ``most`` tokens are cut at sentences."""
    out = []
    for part in parts:
        cut = pack_text(part.content, config)
        out += [part] if len(cut) == 1 else [Part(f"{part.name}_{k}", part.clause, part.point, text, part.content_type) for k, text in enumerate(cut, 1)]
    return out


PART = "array<struct<name: string, clause: string, point: string, content: string, content_type: string, words: int>>"
#: A word as ``word_total`` counts it.
WORD = re.compile(f"[^{WHITE_SIGNS}]+")
#: What a chunk has of its own before it gets its document's fields.
OWN_FIELDS = (
    "chapter_number", "chapter_title", "section_number", "section_title", "article_number", "article_title", "clause_number", "point_number", "parent_article", "content_type",
    "appendix_number", "appendix_title",
)
#: Content types of chunks that join the next one if they are small.
HEADER_TYPES = ("table", "form", "appendix", "other")


def chunk_legal_documents(
    docs: DataFrame, config: ChunkConfig | None = None, id_col: str = "doc_id", text_col: str = "text", patterns: Mapping[str, str] = HEADINGS, appendix: str = APPENDIX, keep_lead: bool = True, **rules
) -> DataFrame:
    """K9, K10 over laws: D1-D9, D11-D15 and C9 end to end, with the 22 fields of a chunk and its content type, appendix number and title.

    Lines are folded into articles under their chapter and section, articles into chunks (:func:`article_parts`); lines from the first appendix on go to
    :func:`appendices.appendix_units`, block by block by their kind. What is over ``most`` tokens is cut, a small table, form or appendix joins the next chunk
    (:func:`header_runs`), and ids carry the chunk's number in its document. Lines before the first article and of chapter and section headings are in no chunk; null and blank texts have
    none. Without ``keep_lead`` lines of an appendix before its first form, region or entry are left out too. ``rules`` go to D3.
    """
    config = config or ChunkConfig()
    meta = restore_metadata(docs, id_col, text_col)
    headed = flag_headings(to_lines(docs, id_col, text_col), patterns, appendix)
    rows = carry_hierarchy(flag_appendix_start(join_title_lines(reject_references(headed, **rules)), appendix=appendix))
    rows = written(rows.select("doc_id", "line_no", "line", "kind", "number", "full_title", "title_lines", "chapter", "section", "in_appendix"), "law-lines")  # articles and appendices read it
    chunks = article_chunks(rows.filter("NOT in_appendix"), config).unionByName(appendix_chunks(appendix_units(rows.filter("in_appendix").select("doc_id", "line_no", "line"), keep_lead), config))
    return finish_chunks(chunks, meta, config)


def article_chunks(rows: DataFrame, config: ChunkConfig) -> DataFrame:
    """K3 to K7: (doc_id, _at, _name, content, fields) of the chunks of all articles, from lines with their headings and hierarchy."""
    upto = by_line((W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_unit", F.sum(F.when(F.col("kind").isin("chapter", "section", "article"), 1).otherwise(0)).over(upto))
    title = lambda k: F.last(F.when(F.col("kind") == k, F.struct(F.col("number").alias("n"), F.col("full_title").alias("t"))), ignorenulls=True)
    rows = rows.withColumns({"_chapter": title("chapter").over(upto), "_section": title("section").over(upto)})
    rows = rows.withColumn("_turn", F.row_number().over(W.partitionBy("doc_id", "_unit").orderBy("line_no")) - 1)
    grouped = rows.groupBy("doc_id", "_unit").agg(
        F.min_by(F.struct("kind", "number", "full_title", F.coalesce("title_lines", F.lit(0)).alias("taken"), "chapter", "section", F.col("_chapter.t").alias("chapter_title"), F.col("_section.t").alias("section_title")), "line_no").alias("h"),
        F.array_sort(F.collect_list(F.struct("line_no", "line", "_turn"))).alias("ls"),
    ).filter("h.kind = 'article'")
    own = F.transform(F.filter("ls", lambda x: x["_turn"] > F.col("h.taken")), lambda x: x["line"])
    name = F.concat(F.lit("Điều "), F.col("h.number"))

    @F.pandas_udf(PART)
    def cut(frame: pd.DataFrame) -> pd.Series:
        parts = [bounded_parts(article_parts(r.number, r.title, list(r.lines), config), config) for r in frame.itertuples(index=False)]
        return pd.Series([[vars(p) | {"words": words_of(p.content)} for p in ps] for ps in parts], dtype=object)

    parts = cut(F.struct(name.alias("number"), F.col("h.full_title").alias("title"), own.alias("lines")))
    chunks = grouped.select("doc_id", "_unit", "h", F.posexplode(parts).alias("_part", "p"))
    titled = lambda c: F.when(F.col(f"h.{c}").isNotNull(), F.col(f"h.{c}_title")).alias(f"{c}_title")
    none = F.lit(None).cast("string")
    return chunks.select(
        "doc_id", place(F.lit(0), F.col("_unit"), F.lit(0), F.col("_part")), F.concat(F.col("doc_id").cast("string"), F.lit("_Điều"), F.col("h.number"), F.col("p.name")).alias("_name"), "p.content", F.col("p.words").alias("_words"),
        F.concat(F.lit("Chương "), F.col("h.chapter")).alias("chapter_number"), titled("chapter"), F.concat(F.lit("Mục "), F.col("h.section")).alias("section_number"), titled("section"),
        F.concat(F.lit("Điều "), F.col("h.number")).alias("article_number"), F.col("h.full_title").alias("article_title"), F.col("p.clause").alias("clause_number"), F.col("p.point").alias("point_number"),
        F.concat_ws("_", F.col("doc_id").cast("string"), F.concat(F.lit("Điều"), F.col("h.number"))).alias("parent_article"), "p.content_type", none.alias("appendix_number"), none.alias("appendix_title"),
    )


def appendix_chunks(units: DataFrame, config: ChunkConfig) -> DataFrame:
    """K7: the same of appendix units; one over ``most`` tokens is cut at sentences, each piece under the appendix's number and title."""

    @F.pandas_udf("array<struct<text: string, words: int>>")
    def cut(texts: pd.Series, heads: pd.Series) -> pd.Series:
        found = ([part for piece in pack_text(t, config, h) for part in pack_text(piece, config)] for t, h in zip(texts, heads, strict=True))
        return pd.Series([[{"text": x, "words": words_of(x)} for x in parts] for parts in found], dtype=object)

    pieces = cut.asNondeterministic()("content", F.concat_ws(" ", "appendix_number", "appendix_title"))  # else the filter of the generator cuts every text a second time
    rows = units.withColumn("_pieces", pieces).withColumn("_many", F.size("_pieces") > 1).select("*", F.posexplode("_pieces").alias("_k", "_piece")).drop("content", "_pieces")
    name = F.concat(F.col("doc_id").cast("string"), F.col("name"), F.when(F.col("_many"), F.concat(F.lit("_"), F.col("_k") + 1)).otherwise(""))
    at = place(F.col("block") + 1, F.col("unit"), F.col("part"), F.col("_k"))
    own = [F.col(c) if c in units.columns else F.lit(None).cast("string").alias(c) for c in OWN_FIELDS]
    return rows.select("doc_id", at, name.alias("_name"), F.col("_piece.text").alias("content"), F.col("_piece.words").alias("_words"), *own)


def words_of(text: str) -> int:
    """``word_total`` of a text that is in Python already."""
    return len(WORD.findall(text))


def place(*parts: Column) -> Column:
    """Where a chunk stands in its document."""
    return F.struct(*[p.cast("int").alias(f"p{k}") for k, p in enumerate(parts)]).alias("_at")


def header_runs(words: Sequence[int], headers: Sequence[bool], config: ChunkConfig) -> list[int]:
    """K8: number of the chunk that each piece goes to, from words and whether its type may be a header.

    A header under ``header`` tokens joins the next piece if the tokens of both are within ``most``; what they make is of the second's type and joins on in the same way.
    """
    tokens = lambda n: math.ceil(n * config.per_word)
    runs: list[int] = []
    held, joins = 0, False
    for size, header in zip(words, headers, strict=True):
        if joins and tokens(held) < config.header and tokens(held) + tokens(size) <= config.most:
            held += size
            runs.append(runs[-1])
        else:
            held = size
            runs.append(runs[-1] + 1 if runs else 0)
        joins = header
    return runs


def finish_chunks(chunks: DataFrame, meta: DataFrame, config: ChunkConfig) -> DataFrame:
    """K8, K9 and the fields of a chunk: headers join the next chunk, chunks are numbered in their document, the document's fields are joined by its id."""

    @F.pandas_udf("array<int>")
    def runs(words: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([header_runs(list(w), list(h), config) for w, h in zip(words, headers, strict=True)], dtype=object)

    of_doc = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_name", "content", "_words", *OWN_FIELDS))).alias("cs"))
    sizes, headers = F.transform("cs", lambda c: c["_words"]), F.transform("cs", lambda c: c["content_type"].isin(*HEADER_TYPES))
    # not deterministic: else the filter of the generator folds a second time
    rows = of_doc.withColumn("_runs", runs.asNondeterministic()(sizes, headers)).select("doc_id", F.explode(F.arrays_zip("cs", "_runs")).alias("x")).select("doc_id", "x.cs.*", F.col("x._runs").alias("chunk_index"))
    fields = ["_name", *OWN_FIELDS]
    merged = rows.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("_at", "content"))).alias("cs"), F.max_by(F.struct(*fields), "_at").alias("f"))
    out = merged.select("doc_id", "f.*", F.array_join(F.transform("cs", lambda x: x["content"]), "\n\n").alias("content"), "chunk_index")
    out = out.withColumn("chunk_id", F.concat_ws("_", F.regexp_replace("_name", r"\s+", ""), F.col("chunk_index").cast("string"))).drop("_name")
    out = out.join(meta.withColumnRenamed("document_id", "doc_id").drop("issuing_authority"), "doc_id")
    return out.withColumnRenamed("doc_id", "document_id").withColumn("parent_document", F.col("document_id")).select(*CHUNK_FIELDS)


#: The 22 fields of a chunk, and three more.
CHUNK_FIELDS = (
    "chunk_id", "document_id", "document_number", "document_title", "document_type", "chapter_number", "chapter_title", "section_number", "section_title", "article_number",
    "article_title", "clause_number", "point_number", "content", "issue_date", "effective_from", "effective_to", "legal_status", "source_url", "parent_document", "parent_article",
    "chunk_index", "content_type", "appendix_number", "appendix_title",
)
