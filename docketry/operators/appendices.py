"""Appendices of a law: blocks, their kind, and the units of each kind (D11 to D15), as tables under one schema.

A block is cut by window marks where its lines say where a unit begins; only limits of words, which depend on what came before, are folds over the word counts
of a block's lines (no text goes to Python). Every window and group is within one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import strip, word_total
from docketry.sources.scratch import written

# Marks of blocks and units, in the words of the laws.
BLOCK = r"^(?iu:phụ\s+lục)(?:\s+([IVXLCDMivxlcdm\d]+))?(?![\p{L}\p{N}_])"
CATALOG = r"^(?:DANH\s+MỤC|Danh\s+mục)(?![\p{L}\p{N}_])"
FINISHED = r"""[.:”";]$"""
INLINE_ENDS = ("theo", "tại", "nêu tại", "khoản", "điều")
NO_TITLE = ("(", "TM.", "BỘ", "CỘNG HÒA", "Mẫu")
SECTOR = r"^([IVXLCDM]+)\.\s+([\p{Lu}\s,–-]+)$"
TIER = r"^(?iu:Điều\s+kiện\s+lao\s+động\s+loại)\s+([IVXivx]+)"
ENTRY = r"^\d+$"
REGION = r"^(\d+)\.\s+(Vùng\s+[IVX]+)[,:]?\s*(.*)$"
GROUP = r"^(?iu:Lao\s+động\s+nam|Lao\s+động\s+nữ)$"
FORM = r"^(?iu:Mẫu\s+số|Mẫu)\s+(\d+[\p{L}\p{N}_/]*)"
FORM_NUMBER = r"^(?iu:số)\s+(\d+[\p{L}\p{N}_/]*)"
NO_FORM_TITLE = ("(", "CỘNG HÒA", "---", "Số:")
FIRST_SECTOR, FIRST_SECTOR_TITLE, FIRST_TIER = "I", "Quy định chung", "Điều kiện lao động chung"
OCCUPATIONS_TITLE, REGIONS_TITLE = "DANH MỤC NGHỀ, CÔNG VIỆC NẶNG NHỌC, ĐỘC HẠI, NGUY HIỂM", "DANH MỤC ĐỊA BÀN ÁP DỤNG MỨC LƯƠNG TỐI THIỂU"
ENTRY_LEAD, RULE = "Đặc điểm điều kiện lao động: ", "-" * 40
# Kind of a block -> sets of words; it is of the first kind all of whose words, of one of its sets, stand in the block's first lines.
KINDS = {"occupation": [("nặng nhọc",), ("điều kiện lao động loại",)], "region": [("vùng i", "địa bàn")], "retirement": [("tuổi nghỉ hưu",), ("lao động nam",)], "form": [("mẫu số",)]}
#: Lines of a block that tell its kind, and those that a form's heading may stand in; words of an occupation unit are limited by entries.
KIND_LINES, FORM_LINES, ENTRIES = 100, 30, 15
#: Words at which a unit ends, and under which a group joins the next one.
GENERIC_WORDS, GROUP_WORDS, LEAST_WORDS, FORM_WORDS, FORM_PART_WORDS = 600, 1000, 10, 1200, 800

UNIT = ("doc_id", "block", "unit", "part", "name", "unit_title", "content", "content_type", "appendix_number", "appendix_title")
_KEY = ["doc_id", "block"]


def _in_block(*frame: int):
    w = W.partitionBy(*_KEY).orderBy("line_no")
    return w.rowsBetween(*frame) if frame else w


_UPTO = (W.unboundedPreceding, W.currentRow)


def _any(column: Column, starts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [column.startswith(s) for s in starts])


def appendix_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, line_no, line) of appendices with ``block`` (from 0), ``appendix_number`` and ``appendix_title``.

    A block begins at a line that names an appendix, and at a catalog's name in capitals if no number was given yet; not at the first line, nor where the line before is unfinished and ends
    in a word that cites. The title is the first two of the block's second to sixth lines of text that may be one; null without any.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    upto = w.rowsBetween(*_UPTO)
    out = lines.withColumns({"_block": F.col("line").rlike(BLOCK), "_catalog": F.col("line").rlike(CATALOG)})
    marks = F.col("_block") | F.col("_catalog")  # what follows is computed for the few lines that may begin a block
    near = marks & (F.lag("line_no").over(w) == F.col("line_no") - 1)  # an empty line cites nothing
    out = out.withColumns({"_before": F.when(near, F.lower(F.lag("line").over(w))), "_later": F.lag("line_no").over(w).isNotNull()})
    cites = reduce(lambda a, b: a | b, [F.col("_before").endswith(x) for x in INLINE_ENDS])
    out = out.withColumn("_free", marks & F.col("_later") & ~F.coalesce(~F.col("_before").rlike(FINISHED) & cites, F.lit(False)))
    capitals = (F.col("line") == F.upper("line")) & (F.col("line") != F.lower("line"))
    out = out.withColumns({"_catalog": F.col("_catalog") & F.col("_free") & ~F.col("_block") & capitals, "_block": F.col("_block") & F.col("_free")})
    out = out.withColumn("_number", F.when(F.col("_block"), F.nullif(F.regexp_extract("line", BLOCK, 1), F.lit(""))))
    out = out.withColumn("_catalogs", F.sum(F.col("_catalog").cast("int")).over(upto))
    # the number of the last named block, and the catalogs before it
    out = out.withColumn("_last", F.last(F.when(F.col("_block"), F.struct(F.col("_number").alias("number"), F.col("_catalogs").alias("n"))), ignorenulls=True).over(upto))
    out = out.withColumn("_catalog", F.col("_catalog") & F.col("_last.number").isNull() & (F.col("_catalogs") - F.coalesce("_last.n", F.lit(0)) == 1))
    name = F.when(F.col("_block"), F.concat_ws(" ", F.lit("Phụ lục"), "_number")).when(F.col("_catalog"), F.lit("Danh mục"))
    out = out.withColumns({"block": F.sum((F.col("_block") | F.col("_catalog")).cast("int")).over(upto), "appendix_number": F.coalesce(F.last(name, ignorenulls=True).over(upto), F.lit("Phụ lục"))})
    begins = F.coalesce(F.last(F.when(F.col("_block") | F.col("_catalog"), F.col("line_no")), ignorenulls=True).over(upto), F.first("line_no").over(upto))
    out = out.withColumn("_place", F.col("line_no") - begins)
    title = F.when(F.col("_place").between(1, 5) & ~_any(F.col("line"), NO_TITLE), F.struct("line_no", "line"))
    titles = F.array_sort(F.collect_list(title).over(W.partitionBy(*_KEY)))
    out = out.withColumn("appendix_title", F.nullif(F.array_join(F.transform(F.slice(titles, 1, 2), lambda t: t["line"]), " - "), F.lit("")))
    return out.select("doc_id", "block", "line_no", "line", "appendix_number", "appendix_title", F.col("_place").alias("place"))


def with_kind(lines: DataFrame) -> DataFrame:
    """``kind`` of each block by the words in its first lines; the first kind that fits, else ``generic``."""
    whole = W.partitionBy(*_KEY)
    lines = lines.withColumn("_top", F.when(F.col("place") < KIND_LINES, F.lower("line")))
    seen = lambda word: F.coalesce(F.bool_or(F.col("_top").contains(word)).over(whole), F.lit(False))
    form = F.bool_or((F.col("place") < FORM_LINES) & F.col("line").rlike(FORM)).over(whole)
    every = {k: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(seen, words)) for words in sets]) for k, sets in KINDS.items()}
    every["form"] = every["form"] | form
    return lines.withColumn("kind", F.coalesce(*[F.when(c, F.lit(k)) for k, c in every.items()], F.lit("generic"))).drop("_top")


def word_spans(words: Sequence[int], heads: Sequence[bool], most: int, least: int = 0) -> list[tuple[int, int, int]]:
    """(start, stop, head) of the units of lines with so many words: a unit ends once it holds ``most`` words, and before the head of a group.

    A group of under ``least`` words, head included, moves into the next one, as do the lines before the first head. ``head`` is the unit's last head, -1 without one.
    """
    spans, start, count, head = [], 0, 0, -1
    for k, (size, first) in enumerate(zip(words, heads, strict=True)):
        if first:
            if head >= 0 and count >= least and k > start:
                spans.append((start, k, head))
                start, count = k, 0
            head = k
        count += size
        if not first and count >= most:
            spans.append((start, k + 1, head))
            start, count = k + 1, 0
    if start < len(words):
        spans.append((start, len(words), head))
    return spans


def limited(lines: Column, head: str | None, most: int, least: int = 0) -> Column:
    """:func:`word_spans` of an array of (line_no, line) structs, as an array of (lines, head, head_again); ``head`` is the pattern of the head of a group."""

    @F.pandas_udf("array<struct<start: int, stop: int, head: int>>")
    def spans(words: pd.Series, heads: pd.Series) -> pd.Series:
        found = [word_spans(list(w), list(h), most, least) for w, h in zip(words, heads, strict=True)]
        return pd.Series([[{"start": a, "stop": b, "head": h} for a, b, h in x] for x in found], dtype=object)

    text = lambda x: x["line"]
    marks = F.transform(lines, lambda x: text(x).rlike(head) if head else F.lit(False))
    at = spans.asNondeterministic()(F.transform(lines, lambda x: word_total(text(x))), marks)
    cut = lambda s: F.transform(F.slice(lines, s["start"] + 1, s["stop"] - s["start"]), text)
    return F.transform(at, lambda s: F.struct(cut(s).alias("lines"), F.when(s["head"] >= 0, text(F.get(lines, s["head"]))).alias("head")))


def _gathered(lines: DataFrame, *by: str) -> DataFrame:
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("appendix_number", "appendix_title")]
    return lines.groupBy(*_KEY, *by).agg(*same, F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def _leads(lines: DataFrame, marked: Column) -> DataFrame:
    """Lines of a block before its first unit, as a unit of their own, so that no text is lost."""
    before = lines.withColumn("_any", F.max(marked.cast("int")).over(_in_block(*_UPTO))).filter("_any = 0")
    out = _gathered(before.drop("_any")).select(*_KEY, F.lit(-1).alias("unit"), F.lit(0).alias("part"), F.lit("_Lead").alias("name"), F.lit(None).cast("string").alias("unit_title"), _joined(F.col("ls")).alias("content"),
                                   F.lit("appendix").alias("content_type"), "appendix_number", "appendix_title")
    return out.select(*UNIT)


def form_units(lines: DataFrame, keep_lead: bool = True) -> DataFrame:
    """A unit per form, from its heading (also where "Mẫu" and its number stand on two lines); a form of over ``FORM_WORDS`` words is cut where a part holds ``FORM_PART_WORDS``.

    A block without headings is one form. Lines before the first heading are a unit of their own, or left out without ``keep_lead``.
    """
    w = _in_block()
    broken = F.lag("line").over(w).isin("Mẫu", "MẪU") & (F.lag("line_no").over(w) == F.col("line_no") - 1) & F.col("line").rlike(FORM_NUMBER)
    number = F.when(F.col("line").rlike(FORM), F.regexp_extract("line", FORM, 1)).when(broken, F.regexp_extract("line", FORM_NUMBER, 1))
    rows = lines.withColumn("_number", number).withColumn("unit", F.count("_number").over(_in_block(*_UPTO)))
    many = F.max("unit").over(W.partitionBy(*_KEY)) > 0
    leads = _leads(rows.withColumn("_many", many).filter("_many"), F.col("_number").isNotNull()) if keep_lead else None
    rows = rows.withColumn("_many", many).filter("unit > 0 OR NOT _many")
    titled = F.when(F.col("_number").isNull() & ~_any(F.col("line"), NO_FORM_TITLE), F.struct("line_no", "line"))
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("appendix_number", "appendix_title")]
    forms = rows.groupBy(*_KEY, "unit").agg(*same, F.max("_number").alias("number"), F.min(titled).alias("t"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    name = F.coalesce(F.concat(F.lit("Mẫu số "), "number"), F.lit("Biểu mẫu"))
    long = F.aggregate("ls", F.lit(0), lambda n, x: n + word_total(x["line"])) > FORM_WORDS
    whole = F.array(F.struct(F.transform("ls", lambda x: x["line"]).alias("lines"), F.lit(None).cast("string").alias("head")))
    forms = forms.withColumn("_long", long)
    long = F.col("_long")
    cut = forms.withColumn("cut", F.when(long, limited(F.col("ls"), None, FORM_PART_WORDS)).otherwise(whole)).withColumn("_parts", F.size("cut"))
    cut = cut.select("*", F.posexplode("cut").alias("part", "u"))
    title = F.coalesce("t.line", name)
    out = cut.select(*_KEY, F.col("unit").cast("int"), "part", F.concat(F.lit("_"), F.regexp_replace(name, "[ /]", "_"), F.when(long, F.concat(F.lit("_Part"), F.col("part") + 1)).otherwise("")).alias("name"),
                     F.when(long, F.concat(title, F.lit(" (Phần "), F.col("part") + 1, F.lit(")"))).otherwise(title).alias("unit_title"), F.array_join("u.lines", "\n").alias("content"), F.lit("form").alias("content_type"), "appendix_number", "appendix_title")
    return out.unionByName(leads) if keep_lead else out


def occupation_units(lines: DataFrame, keep_lead: bool = True, batch: int = ENTRIES) -> DataFrame:
    """Entries (a number alone on a line, the title on the next, then a description) under their sector and tier, ``batch`` to a unit, with both and the catalog's title above.

    Of numbers on lines in a row every second one is a title. Lines before the first entry of a group that mark nothing are a unit of their own with ``keep_lead`` if they open the block, and are else left out.
    """
    w = _in_block()
    rows = lines.withColumn("_digits", F.col("line").rlike(ENTRY)).withColumn("_run", F.sum((~F.col("_digits")).cast("int")).over(_in_block(*_UPTO)))
    turn = F.row_number().over(W.partitionBy(*_KEY, "_run", "_digits").orderBy("line_no"))
    rows = rows.withColumn("_entry", F.col("_digits") & (turn % 2 == 1))
    rows = rows.withColumn("_title", F.coalesce(F.lag("_entry").over(w), F.lit(False)))
    marks = ~F.col("_title") & ~F.col("_entry")
    rows = rows.withColumns({"_sector": marks & F.col("line").rlike(SECTOR), "_tier": marks & F.col("line").rlike(TIER)})
    upto = _in_block(*_UPTO)
    rows = rows.withColumns({"_s": F.sum(F.col("_sector").cast("int")).over(upto), "_g": F.sum((F.col("_sector") | F.col("_tier")).cast("int")).over(upto)})
    last = lambda c, v, over: F.last(F.when(F.col(c), v), ignorenulls=True).over(over)
    sector = last("_sector", F.struct(F.regexp_extract("line", SECTOR, 1).alias("id"), strip(F.regexp_extract("line", SECTOR, 2)).alias("title")), upto)
    tier = last("_tier", F.concat(F.lit("Điều kiện lao động loại "), F.regexp_extract("line", TIER, 1)), W.partitionBy(*_KEY, "_s").orderBy("line_no").rowsBetween(*_UPTO))
    rows = rows.withColumns({"sector": sector, "tier": F.coalesce(tier, F.lit(FIRST_TIER)), "_n": F.sum(F.col("_entry").cast("int")).over(W.partitionBy(*_KEY, "_g").orderBy("line_no").rowsBetween(*_UPTO))})
    leads = _leads(rows, F.col("_entry") | F.col("_sector") | F.col("_tier")) if keep_lead else None
    inside = rows.filter("_n > 0 AND NOT _sector AND NOT _tier")
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("appendix_number", "appendix_title", "sector", "tier")]
    said = F.array_sort(F.collect_list(F.when(~F.col("_entry") & ~F.col("_title"), F.struct("line_no", "line"))))
    entries = inside.groupBy(*_KEY, "_g", "_n").agg(*same, F.min(F.when(F.col("_entry"), F.col("line"))).alias("no"), F.min(F.when(F.col("_title"), F.col("line"))).alias("title"), said.alias("said"))
    text = F.concat(F.col("no"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n" + ENTRY_LEAD), F.array_join(F.transform("said", lambda x: x["line"]), " "))
    batched = entries.withColumns({"_text": text, "_b": F.floor((F.col("_n") - 1) / batch).cast("int")}).groupBy(*_KEY, "_g", "_b")
    units = batched.agg(*same, F.array_sort(F.collect_list(F.struct("_n", "_text"))).alias("es"))
    units = units.withColumn("unit", F.row_number().over(W.partitionBy(*_KEY).orderBy("_g", "_b")))
    sid, stitle = F.coalesce("sector.id", F.lit(FIRST_SECTOR)), F.coalesce("sector.title", F.lit(FIRST_SECTOR_TITLE))
    head = F.concat(F.coalesce("appendix_title", F.lit(OCCUPATIONS_TITLE)), F.lit("\nLĨNH VỰC "), sid, F.lit(": "), stitle, F.lit("\nPHÂN LOẠI: "), "tier", F.lit(f"\n{RULE}\n"))
    out = units.select(*_KEY, "unit", F.lit(0).alias("part"), F.concat(F.lit("_DM_S"), sid, F.lit("_"), F.regexp_replace("tier", r"[^\p{L}\p{N}_]+", "_"), F.lit("_P"), "unit").alias("name"), F.col("tier").alias("unit_title"),
                       F.concat(head, F.array_join(F.transform("es", lambda e: e["_text"]), "\n\n")).alias("content"), F.lit("table").alias("content_type"), "appendix_number", "appendix_title")
    return out.unionByName(leads) if keep_lead else out


def region_units(lines: DataFrame, keep_lead: bool = True) -> DataFrame:
    """A unit per region, with the catalog's title above; lines before the first one are a unit of their own, or left out without ``keep_lead``."""
    marked = F.col("line").rlike(REGION)
    rows = lines.withColumn("unit", F.sum(marked.cast("int")).over(_in_block(*_UPTO)).cast("int"))
    units = _gathered(rows.filter("unit > 0"), "unit").withColumn("region", F.regexp_extract(F.col("ls")[0]["line"], REGION, 2))
    out = units.select(*_KEY, "unit", F.lit(0).alias("part"), F.concat(F.lit("_DM_"), F.translate("region", " ", "_")).alias("name"), F.col("region").alias("unit_title"),
                       F.concat(F.coalesce("appendix_title", F.lit(REGIONS_TITLE)), F.lit("\n\n"), _joined(F.col("ls"))).alias("content"), F.lit("table").alias("content_type"), "appendix_number", "appendix_title")
    return out.unionByName(_leads(lines, marked)) if keep_lead else out


def _limited_units(lines: DataFrame, head: str | None, most: int, least: int) -> DataFrame:
    return _gathered(lines).select(*_KEY, "appendix_number", "appendix_title", F.posexplode(limited(F.col("ls"), head, most, least)).alias("unit", "u"))


def retirement_units(lines: DataFrame, most: int = GROUP_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """A unit per group of people, cut once it holds ``most`` words; a group of under ``least`` words moves into the next, and what comes before the first group into that."""
    word = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "_")
    title = F.coalesce("u.head", F.lit("Bảng số liệu"))
    return _limited_units(lines, GROUP, most, least).select(*_KEY, "unit", F.lit(0).alias("part"), F.concat(F.lit("_"), word("appendix_number"), F.lit("_"), word(title), F.lit("_"), F.col("unit") + 1).alias("name"),
                                                            title.alias("unit_title"), F.array_join("u.lines", "\n").alias("content"), F.lit("table").alias("content_type"), "appendix_number", "appendix_title")


def generic_units(lines: DataFrame, most: int = GENERIC_WORDS) -> DataFrame:
    """A block's lines, cut once a unit holds ``most`` words."""
    return _limited_units(lines, None, most, 0).select(*_KEY, "unit", F.lit(0).alias("part"), F.concat(F.lit("_"), F.translate("appendix_number", " ", "_"), F.lit("_P"), F.col("unit") + 1).alias("name"),
                                                       F.lit(None).cast("string").alias("unit_title"), F.array_join("u.lines", "\n").alias("content"), F.lit("appendix").alias("content_type"), "appendix_number", "appendix_title")


def appendix_units(lines: DataFrame, keep_lead: bool = True) -> DataFrame:
    """Units (doc_id, block, unit, part, name, unit_title, content, content_type, appendix_number, appendix_title) of the lines (doc_id, line_no, line) of appendices.

    Blocks go to the sub-plan of their kind. ``content_type`` is table, form or appendix; (block, unit, part) is the order within a document. Documents without lines have no units.
    """
    rows = written(with_kind(appendix_blocks(lines)), "appendix-lines")  # every plan reads its kind of it
    plans = {"occupation": lambda b: occupation_units(b, keep_lead), "region": lambda b: region_units(b, keep_lead), "retirement": retirement_units, "form": lambda b: form_units(b, keep_lead), "generic": generic_units}
    parts = [plan(rows.filter(F.col("kind") == kind)).select(*UNIT) for kind, plan in plans.items()]
    return reduce(DataFrame.unionByName, parts)
