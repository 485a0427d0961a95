"""Document structure as line tables: headings, citations that look like headings, hierarchy, sections, clauses and points.

Every window is partitioned by document, so a task holds the lines of one document at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import once, strip, strip_line, word_total

# Words that head a chapter, section, article and appendix; the number is in group 1 and the rest of the line in group 2.
HEADINGS = {
    "chapter": r"^(?iu:Chương)\s+([IVXLCDMivxlcdm]+|\d+)(?![\p{L}\p{N}_])(.*)$",
    "section": r"^(?iu:Mục)\s+([IVXLCDMivxlcdm]+|\d+)(?![\p{L}\p{N}_])(.*)$",
    "article": r"^(?iu:Điều)\s+(\d+)(?![\p{L}\p{N}_])(.*)$",
}
APPENDIX = r"^(?:(?iu:Phụ\s+lục)(?:\s+[IVXLCDMivxlcdm\d]+)?(?![\p{L}\p{N}_])|(?:DANH|Danh)\s+(?:MỤC|mục)(?:\s*$|\s+\p{Lu}(?![\p{L}\p{N}_]))|(?:MẪU\s+SỐ|Mẫu\s+số)\s+\d+(?![\p{L}\p{N}_]))"
# What follows a name of an appendix in a sentence about it.
APPENDIX_SUFFIX = r"(?iu)^(?:ban\s+hành\s+kèm\s+theo|kèm\s+theo|quy\s+định\s+tại|được\s+quy\s+định|(?:tại|và|trong|của|đối\s+với)(?![\p{L}\p{N}_]))"
# Ends of a line that introduce an article that is cited.
PHRASE_ENDS = ("quy định tại", "hướng dẫn tại", "nêu tại", "theo quy định tại", "theo", "trong", "trừ trường hợp", "ban hành kèm theo", "kèm theo")
#: What may stand between an article's number and its title.
ARTICLE_REST = r"^(?:$|[.:–—-])"
#: Lines to look at before and after a heading for the next one that is not empty.
LINES_BEFORE, LINES_AFTER = 9, 5
# Words after a number that make it a citation.
CITATION_SUFFIX = r"(?iu)^\s*(?:của|này|và|đến|hoặc|trừ|được|là|quy\s+định|áp\s+dụng)(?![\p{L}\p{N}_])"
# Ends of a line that introduce a citation.
INTRODUCERS = (
    "quy định tại", "hướng dẫn tại", "nêu tại", "theo quy định tại", "theo", "trong", "tại mục", "tại chương", "tại điều", "tại khoản", "khoản", "điều", "mục",
    "chương", "trừ trường hợp", "tại", "mẫu số", "kèm theo", "ban hành kèm theo", "ghi tại",
)
# Ends of a finished line, and the letters of points in their order.
TERMINAL = r"""[.:;!?”")]$"""
LETTERS = "a b c d đ e g h i k l m n o p q r s t u v x y".split()


def to_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line) with trimmed lines, empty ones left out. A null text has no lines."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip_line(F.col("line"))).filter("line <> ''")


def by_line(frame: tuple[int, int] | None = None):
    w = W.partitionBy("doc_id").orderBy("line_no")
    return w if frame is None else w.rowsBetween(*frame)


def flag_headings(lines: DataFrame, patterns: Mapping[str, str] = HEADINGS, appendix: str = APPENDIX) -> DataFrame:
    """Add ``kind`` (the first pattern that fits, ``appendix`` or null), ``number`` and ``title``."""
    kind = F.coalesce(*[F.when(F.col("line").rlike(p), k) for k, p in patterns.items()], F.when(F.col("line").rlike(appendix), "appendix"))
    part = lambda g: F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("line", p, g)) for k, p in patterns.items()])
    return lines.withColumn("kind", kind).withColumns({"number": part(1), "title": strip(part(2))})


def _beside(step: int, most: int) -> Column:
    """The next line (``step`` 1) or the one before (-1), if it is within ``most`` lines of the text; else null."""
    near = F.abs(F.lead("line_no", step).over(by_line()) - F.col("line_no")) <= most
    return F.when(near, F.lead("line", step).over(by_line()))


def _beside_marks(rows: DataFrame, marks: Column) -> DataFrame:
    """``_before``, the line before in small letters, and ``_next``, the next line, as columns of their own, so that each is computed once a row, and only where ``marks`` holds."""
    return rows.withColumns({"_before": F.when(marks, F.lower(_beside(-1, LINES_BEFORE))), "_next": F.when(marks, _beside(1, LINES_AFTER))})


def _introduced(introducers: Sequence[str]) -> Column:
    """The line ``_before`` is unfinished and one of ``introducers`` stands in its last 30 characters."""
    said = F.right("_before", F.lit(30)).rlike("|".join(rf"\Q{w}\E" for w in introducers)) if introducers else F.lit(False)
    return ~F.col("_before").rlike(TERMINAL) & said


def reject_references(
    headings: DataFrame, suffix: str = CITATION_SUFFIX, introducers: Sequence[str] = INTRODUCERS, phrase_ends: Sequence[str] = PHRASE_ENDS, article_rest: str = ARTICLE_REST
) -> DataFrame:
    """D3: ``kind`` becomes null where the heading is a citation; ``candidate`` keeps what it was.

    A chapter or section is cited if a connective follows its number, or an introducer ends the unfinished line before; a chapter also by ``,`` or ``;`` at its end. Within
    an article either is cited if the next line goes on with a clause or a small letter. An article is cited unless ``article_rest`` follows its number, by
    ``;`` at its end, and if the unfinished line before ends in one of ``phrase_ends`` or in the number of a clause, article or point. A title over two lines that is cut after ``,`` stays a heading.
    """
    before = F.col("_before")
    ends = before.rlike("|".join([*(rf"\Q{w}\E\z" for w in phrase_ends), r"(?:khoản|điều|điểm)\s+\d+$"]))
    sure = lambda c: F.coalesce(c, F.lit(False))
    introduced = sure(_introduced(introducers))
    article = F.col("title").rlike(article_rest) & ~F.col("line").endswith(";") & ~sure(~before.rlike(TERMINAL) & ends)
    # kinds that do not depend on whether an article is open
    cited = (
        F.when(F.col("kind") == "article", ~article)
        .when(F.col("kind").isin("chapter", "section"), F.col("title").rlike(suffix) | introduced | ((F.col("kind") == "chapter") & F.col("line").rlike("[,;]$")))
        .otherwise(False)
    )
    goes_on = F.col("kind").isin("chapter", "section") & sure(F.col("_next").rlike(r"^(?:\d+\.\s|\p{Ll})"))
    out = _beside_marks(headings, F.col("kind").isNotNull()).withColumns({"_cited": F.when(F.col("kind").isNull(), False).otherwise(sure(cited)), "_goes_on": goes_on})
    # a heading that goes on is one only where no article is open, so it never changes whether one is
    opens = F.when(~F.col("_cited") & ~F.col("_goes_on") & F.col("kind").isin("chapter", "section", "article"), F.col("kind") == "article")
    inside = sure(F.last(opens, ignorenulls=True).over(by_line((W.unboundedPreceding, -1))))
    out = out.withColumn("_kind", F.when(~(F.col("_cited") | (F.col("_goes_on") & inside)), F.col("kind")))
    kept = {c: F.when(F.col("_kind").isNotNull(), F.col(c)) for c in ("number", "title")}
    return out.withColumns(kept).withColumnRenamed("kind", "candidate").withColumnRenamed("_kind", "kind").drop("_cited", "_goes_on", "_before", "_next")


def flag_appendix_start(headings: DataFrame, ahead: int = 150, introducers: Sequence[str] = INTRODUCERS, appendix: str = APPENDIX, suffix: str = APPENDIX_SUFFIX) -> DataFrame:
    """Add ``appendix_start``: an appendix heading after some article that is no citation and no end of a sentence.

    It is not one if ``suffix`` follows on its line, if an introducer or the number of a clause, article, point or form ends the unfinished line before, if the next line is a clause or point
    or begins with a small letter, or if a chapter or an article of a higher number than the open one comes within ``ahead`` lines.
    """
    kind = F.col("candidate") if "candidate" in headings.columns else F.col("kind")
    upto = by_line((W.unboundedPreceding, W.currentRow))
    number = F.when(F.col("kind") == "article", F.col("number").try_cast("int"))
    opened = F.when(F.col("kind").isin("chapter", "section", "article"), F.coalesce(number, F.lit(0)))
    out = headings.withColumns({"_open": F.coalesce(F.last(opened, ignorenulls=True).over(upto), F.lit(0)), "_any": F.max((F.col("kind") == "article").cast("int")).over(upto) == 1})
    window = W.partitionBy("doc_id").orderBy("line_no").rangeBetween(1, ahead - 1)
    higher = F.max(number).over(window) > F.col("_open")
    chapter = F.max((kind == "chapter").cast("int")).over(window) == 1
    before = F.col("_before")
    cited = strip(F.regexp_replace("line", appendix, "")).rlike(suffix) | _introduced(introducers) | (~before.rlike(TERMINAL) & before.rlike(r"(?:khoản|điều|điểm|mẫu)\s+\d*$"))
    goes_on = F.col("_next").rlike(r"^(?:\d+\.\s+|[a-zđ]\)\s+|\p{Ll})")
    no = F.lit(False)
    for c in (F.col("_higher"), F.col("_chapter_ahead"), cited, goes_on):
        no = no | F.coalesce(c, F.lit(False))
    named = F.coalesce(kind, F.lit("")) == "appendix"
    out = _beside_marks(out.withColumns({"_higher": higher, "_chapter_ahead": chapter}), named)
    return out.withColumn("appendix_start", F.when(named & F.coalesce(F.col("_any"), F.lit(False)), ~no).otherwise(False)).drop("_open", "_any", "_higher", "_chapter_ahead", "_before", "_next")


def join_title_lines(headings: DataFrame, most: int = 4) -> DataFrame:
    """Add ``full_title`` and ``title_lines``, the lines that a heading's title takes besides its own.

    An article's title goes on over lines without an empty one between, that are no heading, clause or point: where there is no title yet, where the last part ends in
    ``,``, ``:``, ``-`` or a connective, and where the line begins with a small letter; up to ``most`` parts. A chapter or section without a title on its own line takes up to
    ``most`` lines before the next heading.
    """
    marker = r"^(?:(?iu:Điều|Chương|Mục)(?![\p{L}\p{N}_])|(?:\d+\.|[a-zđ]\))(?=[\p{L}\p{N}_]))"
    own = F.col("_own")
    # the lines that follow a heading, for folds that read each of them once
    nexts = [F.struct((F.lead("line_no", n).over(by_line()) == F.col("line_no") + n).alias("near"), F.lead("line", n).over(by_line()).alias("line"), F.lead("kind", n).over(by_line()).alias("kind")) for n in range(1, most + 1)]
    marks = F.col("kind").isin("article", "chapter", "section")
    headings = headings.withColumn("_nexts", F.when(marks, F.array(*nexts))).withColumn("_own", F.when(marks, strip(F.regexp_replace("title", r"^[.:\-\s–—]+", ""))))
    first = F.when(own != "", own)

    def goes_on(a: Column, x: Column) -> Column:
        fits = x["near"] & ~x["line"].rlike(marker)
        wants = (a["parts"] == 0) | a["last"].rlike(r"(?iu)(?:[,:\-]|(?<![\p{L}\p{N}_])(?:của|về|và|đối\s+với|trong|cho)\s*)$") | x["line"].rlike(r"^\p{Ll}")
        step = F.when(a["open"] & (a["parts"] < most), fits & wants)
        return once(F.coalesce(step, F.lit(False)), lambda go: _state(F.when(go, F.concat_ws(" ", a["t"], x["line"])).otherwise(a["t"]), a["n"] + go.cast("int"), a["parts"] + go.cast("int"), go, F.when(go, x["line"]).otherwise(a["last"])))

    def stands_below(a: Column, x: Column) -> Column:
        step = F.when(a["open"], x["kind"].isNull() & x["line"].isNotNull() & ~x["line"].rlike(r"^(?iu:Điều|Chương|Mục)\s+[\dIVXLCDM]"))
        return once(F.coalesce(step, F.lit(False)), lambda go: _state(F.when(go, F.concat_ws(" ", a["t"], x["line"])).otherwise(a["t"]), a["n"] + go.cast("int"), a["parts"], go, a["last"]))

    heads = F.when(F.col("kind") == "article", F.aggregate("_nexts", _state(first, F.lit(0), (own != "").cast("int"), F.lit(True), own), goes_on))
    below = F.aggregate("_nexts", _state(F.lit(None), F.lit(0), F.lit(0), own == "", own), stands_below)
    above = F.when(F.col("kind").isin("chapter", "section"), below)
    out = headings.withColumn("_t", F.coalesce(heads, above))
    title = F.when(F.col("kind") == "article", F.col("_t.t")).otherwise(F.coalesce(first, F.col("_t.t")))
    return out.withColumns({"full_title": title, "title_lines": F.col("_t.n")}).drop("_t", "_nexts", "_own")


def _state(title: Column, lines: Column, parts: Column, open_: Column, last: Column) -> Column:
    """What a fold over the lines below a heading holds: the title so far, the lines it took, its parts, whether it goes on, and its last part."""
    named = {"t": title.cast("string"), "n": lines.cast("int"), "parts": parts.cast("int"), "open": open_.cast("boolean"), "last": last.cast("string")}
    return F.struct(*[c.alias(k) for k, c in named.items()])


def carry_hierarchy(headings: DataFrame) -> DataFrame:
    """Add the chapter, section and article that hold each line.

    A new chapter clears the section; a chapter or section heading closes the article until the next one; from the first appendix start on (if the column is
    there) lines belong to none.
    """
    upto = by_line((W.unboundedPreceding, W.currentRow))
    value = lambda kind: F.when(F.col("kind") == kind, F.col("number"))
    out = headings.withColumn("_chapters", F.sum(F.when(F.col("kind") == "chapter", 1).otherwise(0)).over(upto))
    in_chapter = W.partitionBy("doc_id", "_chapters").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("kind").isin("chapter", "section", "article"), F.struct("kind", "number")), ignorenulls=True).over(upto)
    out = out.withColumns({"chapter": F.last(value("chapter"), ignorenulls=True).over(upto), "section": F.last(value("section"), ignorenulls=True).over(in_chapter), "_last": last})
    out = out.withColumn("article", F.when(F.col("_last.kind") == "article", F.col("_last.number")))
    if "appendix_start" in headings.columns:
        ended = F.max(F.col("appendix_start").cast("int")).over(upto) == 1
        out = out.withColumn("in_appendix", ended).withColumns({c: F.when(~F.col("in_appendix"), F.col(c)) for c in ("chapter", "section", "article")})
    return out.drop("_chapters", "_last")


def sectionize(lines: DataFrame, boundary: Column) -> DataFrame:
    """(doc_id, seq from 0, first_line, content): a new unit at each line where ``boundary`` holds, lines joined by a space; lines before the first are unit 0."""
    marked = lines.withColumn("_start", F.coalesce(boundary, F.lit(False)).cast("int"))
    unit = F.sum("_start").over(by_line((W.unboundedPreceding, W.currentRow)))
    grouped = marked.withColumn("_unit", unit).groupBy("doc_id", "_unit").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("_unit")) - 1
    return grouped.select("doc_id", seq.alias("seq"), F.col("ls")[0]["line_no"].alias("first_line"), F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("content"))


@dataclass
class Piece:
    clause: int | None
    point: str | None
    lines: list[str]


def clauses_and_points(lines: Sequence[str], quotes: bool = False) -> list[Piece]:
    """D8 for one article: the lead, clauses ``N.`` (the first is 1, then up by one or two) and points ``a)`` (the first a or b, then up by one to three letters).

    Amounts and percentages are no clauses. ``quotes``: numbered lines within quotation marks are no clauses either.
    """
    import re

    out = [Piece(None, None, [])]
    clause, point, inside = 0, None, False
    for line in lines:
        m = re.match(r"^(\d+)\.\s*(.*)$", line)
        amount = re.match(r"^\d{1,3}(?:\.\d{3})+\s*(?:đồng|triệu|nghìn|tỷ)|^\d+\.\d+\s*%", line)
        if m and not amount and not (quotes and inside) and (int(m[1]) == 1 if not clause else clause < int(m[1]) <= clause + 2):
            clause, point = int(m[1]), None
            out.append(Piece(clause, None, [m[2]]))
        else:
            p = re.match(r"^(\w)\)\s*(.*)$", line)
            letter = p and p[1].lower()
            at = LETTERS.index(letter) if letter in LETTERS else -1
            if p and at >= 0 and (letter in "ab" if point is None else point < at <= point + 3):
                point = at
                out.append(Piece(clause or None, letter, [p[2]]))
            else:
                out[-1].lines.append(line)
        inside ^= (line.count("“") - line.count("”")) % 2 == 1 or line.count('"') % 2 == 1
    return out


def split_clauses_points(lines: DataFrame, quotes: bool = False) -> DataFrame:
    """(doc_id, article, piece from 0, clause, point, content) of lines (doc_id, article, line_no, line); rows without an article form one unit of a document.

    The guard depends on the last accepted number, so the lines of one article are folded together, as arrays in Arrow batches.
    """

    @F.pandas_udf("array<struct<clause: int, point: string, content: string>>")
    def fold(articles: pd.Series) -> pd.Series:
        pieces = [clauses_and_points(list(ls), quotes) for ls in articles]
        return pd.Series([[{"clause": p.clause, "point": p.point, "content": "\n".join(p.lines)} for p in ps] for ps in pieces], dtype=object)

    grouped = lines.groupBy("doc_id", "article").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    cut = grouped.select("doc_id", "article", F.posexplode(fold(F.transform("ls", lambda x: x["line"]))).alias("piece", "p"))
    return cut.select("doc_id", "article", "piece", "p.*")


def legal_units(pieces: DataFrame) -> DataFrame:
    """Pieces with text, an empty lead left out, and ``content_type`` other, article, clause or point."""
    w = W.partitionBy("doc_id", "article")
    many = F.count(F.lit(1)).over(w) > 1
    kind = F.when(F.col("point").isNotNull(), "point").when(F.col("clause").isNotNull(), "clause").when(F.col("article").isNull() | many, "other").otherwise("article")
    return pieces.withColumn("content_type", kind).filter(strip(F.col("content")) != "")


def forms(lines: DataFrame, pattern: str = r"^(?iu:Mẫu\s+số)\s+(\d+)", most_words: int = 1200) -> DataFrame:
    """Units cut at form headings, also where heading and number stand on two lines; a unit over ``most_words`` is cut again by words."""
    two = F.col("line").rlike(r"(?iu)^Mẫu\s+số$") & F.lead("line").over(by_line()).rlike(r"^\d+")
    units = sectionize(lines, F.col("line").rlike(pattern) | F.coalesce(two, F.lit(False)))
    ws = F.split("content", " ")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / most_words).cast("int")), lambda i: F.array_join(F.slice(ws, i * most_words + 1, most_words), " "))
    return units.select("doc_id", "seq", "first_line", F.posexplode(parts).alias("part", "content"))


def catalog(lines: DataFrame, sector: str, tier: str, entry: str, batch: int = 20) -> DataFrame:
    """Entries numbered by ``entry`` under the sector and tier that hold them, ``batch`` to a unit; lines after an entry belong to it."""
    upto = by_line((W.unboundedPreceding, W.currentRow))
    out = lines.withColumns({"_sector": F.when(F.col("line").rlike(sector), F.col("line")), "_tier": F.when(F.col("line").rlike(tier), F.col("line"))})
    out = out.withColumns({"sector": F.last("_sector", ignorenulls=True).over(upto), "_s": F.count("_sector").over(upto)})
    tiers = W.partitionBy("doc_id", "_s").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumns({"tier": F.last("_tier", ignorenulls=True).over(tiers), "_t": F.count("_tier").over(tiers)})
    group = W.partitionBy("doc_id", "_s", "_t").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.filter("_sector IS NULL AND _tier IS NULL").withColumn("_n", F.sum(F.col("line").rlike(entry).cast("int")).over(group)).filter("_n > 0")
    units = out.withColumn("unit", F.floor((F.col("_n") - 1) / batch).cast("int")).groupBy("doc_id", "_s", "_t", "unit")
    rows = units.agg(F.first("sector").alias("sector"), F.first("tier").alias("tier"), F.max("_n").alias("last_entry"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return rows.select("doc_id", "sector", "tier", "unit", "last_entry", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


#: Kind of an appendix block -> words of its first lines; the first kind that fits is taken.
APPENDIX_KINDS = {"occupation": ("nghề",), "region": ("vùng",), "retirement": ("tuổi nghỉ hưu",), "form": ("mẫu số",)}


def appendix_kind(lines: DataFrame, kinds: Mapping[str, Sequence[str]] = APPENDIX_KINDS, first: int = 100) -> DataFrame:
    """(doc_id, block, kind) of lines (doc_id, block, line_no, line) by words in each block's first ``first`` lines; else ``generic``."""
    turn = F.row_number().over(W.partitionBy("doc_id", "block").orderBy("line_no"))
    top = lines.withColumn("_turn", turn).filter(F.col("_turn") <= first)
    has = {k: F.bool_or(F.greatest(F.lit(False), *[F.lower("line").contains(w) for w in ws])) for k, ws in kinds.items()}
    flags = top.groupBy("doc_id", "block").agg(*[c.alias(k) for k, c in has.items()])
    return flags.select("doc_id", "block", F.coalesce(*[F.when(F.col(k), F.lit(k)) for k in kinds], F.lit("generic")).alias("kind"))


def word_limited_units(lines: DataFrame, boundary: Column, most_words: int = 600) -> DataFrame:
    """As ``sectionize``, and a unit also ends once it holds ``most_words`` words; cuts follow the running word count of the unit."""
    marked = lines.withColumn("_unit", F.sum(F.coalesce(boundary, F.lit(False)).cast("int")).over(by_line((W.unboundedPreceding, W.currentRow))))
    upto = W.partitionBy("doc_id", "_unit").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum(word_total(F.col("line"))).over(upto), F.lit(0)) / most_words)
    fresh = (F.col("_unit") != F.lag("_unit").over(by_line())) | (F.col("_cut") != F.lag("_cut").over(by_line()))
    staged = marked.withColumn("_cut", cut).withColumn("_fresh", F.coalesce(fresh, F.lit(True)))
    return sectionize(staged.select("doc_id", "line_no", "line", "_fresh"), F.col("_fresh"))


