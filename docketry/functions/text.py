"""Column functions over text: cleaning, identifiers, tokens, references and citations.

All are built-in expressions. Patterns name Unicode classes, so accented letters are letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for a missing value.
NULL_WORDS = ("chưa xác định", "chưa có", "đã biết", "không rõ", "n/a", "none", "null", "undefined", "unknown", "0", "")
# The words of a number field that stand for no number.
NO_NUMBER = ("chưa xác định", "đã biết", "0", "null", "none")
# Words of a declared type that stand for no type.
NO_TYPE = ("chưa xác định", "đã biết", "null", "none")
# Stop words of the lexical index.
INDEX_STOP_WORDS = (
    "của cho các những được trong theo nào gì như thế khi quy định pháp luật phải khoản điều về có hay với tại ở này đó ra sao bao nhiêu "
    "một hai ba thực hiện áp dụng trường hợp vấn đề liên quan là và hoặc thời gian số lại thì đã sẽ tôi em mình cho_biết hỏi xin_hỏi"
).split()
# Stop words of the answer comparison.
ANSWER_STOP_WORDS = "và hoặc của cho các những được trong theo tại với có là thì mà ở này đó ra sao bao nhiêu như thế nào gì khi quy định pháp luật".split()

WHITE = r"[\s\p{Z}]"
#: The characters of WHITE.
WHITE_SIGNS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
TOKENS_PER_WORD = 1.3


# Names of kinds of documents; the title stands between such a name on a line and the first line of grounds or articles.
TITLE_BLOCK = r"(?su)(?:^|\n)\s*(?:BỘ LUẬT|LUẬT|NGHỊ ĐỊNH|THÔNG TƯ|QUYẾT ĐỊNH)\s*\n(.*?)(?=\n\s*(?:Căn cứ|Chương|CHƯƠNG|Điều|ĐIỀU))"


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def strip_line(line: Column) -> Column:
    """:func:`strip` of a column without a search at every blank. Where a line ends in U+0085, before which the pattern's ``$`` stands too, it is that pattern."""
    return F.when(line.endswith("\u0085"), strip(line)).otherwise(F.btrim(line, F.lit(WHITE_SIGNS)))


def clean_text(text: Column) -> Column:
    """No-break spaces to spaces, no BOM or CR, one space for a run of blanks, one empty line for several, trimmed. Null becomes empty."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " ﻿\r", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(out, rf"\n{WHITE}*\n+", "\n\n"))


def sanitize_null(text: Column, words: Sequence[str] = NULL_WORDS) -> Column:
    """The trimmed text, or null if it is one of ``words`` in any case."""
    out = strip(text)
    return F.when(~F.lower(out).isin(*words), out)


def clean_document_number(text: Column) -> Column:
    """First line, without the prefix "Số:" and any white space; null for empty texts and words for no number."""
    whole = strip(text)
    first = F.regexp_replace(strip(F.split(whole, "\n")[0]), "(?iu)^(?:Số:|Số)", "")
    out = F.regexp_replace(first, rf"{WHITE}+", "")
    return F.when((whole != "") & ~F.lower(whole).isin(*NO_NUMBER) & (out != ""), out)


def infer_document_type(number: Column, declared: Column, doc_id: Column) -> Column:
    """C4: the declared type, else one named in the number field, else by the prefix of the id or the suffix of the number."""
    # What names a type, and the ids and numbers that go with one.
    code = doc_id.startswith("BLLD")
    said = F.when((strip(declared) != "") & ~F.lower(strip(declared)).isin(*NO_TYPE), strip(declared))
    named = strip(F.nullif(F.regexp_extract(F.coalesce(number, F.lit("")), rf"(?iu)Loại{WHITE}+văn{WHITE}+bản:{WHITE}*([^\n]+)", 1), F.lit("")))
    named = F.when(~F.lower(named).isin("", "chưa xác định", "đã biết"), named)
    number = F.coalesce(number, F.lit(""))
    guess = (
        F.when(code, "Bộ luật")
        .when(doc_id.startswith("ND_") | number.contains("/NĐ-CP"), "Nghị định")
        .when(doc_id.startswith("TT_") | number.contains("/TT-"), "Thông tư")
        .when(doc_id.startswith("QD_") | number.contains("/QĐ-"), "Quyết định")
        .when(doc_id.startswith("LUAT_") | doc_id.startswith("Luat_") | number.contains("/QH"), "Luật")
        .otherwise("Văn bản quy phạm")
    )
    return F.when(code, "Bộ luật").otherwise(F.coalesce(said, named, guess))


def official_title(text: Column, kind: Column, number: Column, block: str) -> Column:
    """Type, number and the title that the pattern ``block`` (one group) finds in the first 2,500 characters; else type and number."""
    title = F.regexp_replace(strip(F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, 2500), block, 1)), rf"{WHITE}+", " ")
    title = strip(F.regexp_replace(title, r"^\([^)]+\)\s*", ""))
    return strip(F.concat_ws(" ", kind, F.concat(F.lit("số "), number), F.nullif(title, F.lit(""))))


def restore_metadata(raw: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_block: str = TITLE_BLOCK) -> DataFrame:
    """One row a document with its id, number, title, type, url, issue and effective dates, end of effect (null), status and authority.

    The fields are read from ``so_hieu``, ``loai_van_ban``, ``ngay_ban_hanh``, ``ngay_hieu_luc``, ``tinh_trang_hieu_luc``, ``source``, ``co_quan_ban_hanh`` and
    ``document_title``, or else from their English names; columns that are not there count as null. Dates, type and title are recovered from the text.
    """
    from docketry.functions.dates import legal_status, recover_dates

    def field(*names: str) -> Column:
        there = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in raw.columns]
        return F.coalesce(*there, F.lit(None).cast("string"))

    ident, text = F.col(id_col).cast("string"), F.col(text_col)
    said = field("so_hieu", "document_number")
    number = clean_document_number(said)
    kind = infer_document_type(said, field("loai_van_ban", "document_type"), ident)
    issue, effective = recover_dates(field("ngay_ban_hanh", "issue_date"), field("ngay_hieu_luc", "effective_from"), text)
    known = strip(field("document_title"))
    title = F.coalesce(F.when((known != "") & (known != ident), known), official_title(text, kind, number, title_block))
    return raw.select(
        F.col(id_col).alias("document_id"), number.alias("document_number"), title.alias("document_title"), kind.alias("document_type"), issue.alias("issue_date"),
        effective.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), legal_status(field("tinh_trang_hieu_luc", "legal_status"), effective).alias("legal_status"),
        sanitize_null(field("source", "source_url")).alias("source_url"), sanitize_null(field("co_quan_ban_hanh", "issuing_authority")).alias("issuing_authority"),
    )


def ascii_bounds(pattern: str) -> str:
    """A pattern whose ``\\b`` are ends of runs of ASCII letters, digits and ``_``, as in DuckDB; Java's take accented letters as parts of a word."""
    word = "[0-9A-Za-z_]"
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", pattern)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once a row however often it is used: within a lambda, an expression of a column is else computed anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words between white space of any script; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{WHITE}+"), lambda w: w != "")


def word_total(text: Column) -> Column:
    return F.size(words(text))


def estimate_tokens(text: Column, per_word: float = TOKENS_PER_WORD) -> Column:
    """ceil(words x ``per_word``), 0 for blank texts."""
    return F.ceil(word_total(text) * F.lit(per_word)).cast("int")


def floor_tokens(text: Column, per_word: float = TOKENS_PER_WORD) -> Column:
    """C10, the variant of logs: floor(words x ``per_word``)."""
    return F.floor(word_total(text) * F.lit(per_word)).cast("int")


def chunk_id(doc: Column, article: Column, clause: Column, point: Column, appendix: Column, suffix: Column, index: Column) -> Column:
    """C11: the parts that are there, joined by ``_``; the appendix only without an article; no white space."""
    tail = lambda c: F.nullif(F.regexp_replace(c.cast("string"), rf"{WHITE}+", ""), F.lit(""))
    return F.concat_ws("_", *map(tail, (doc, article, clause, point, F.when(article.isNull(), appendix), suffix, index)))


def content_hash_id(doc: Column, hierarchy: Column, content: Column, index: Column) -> Column:
    """The first 24 hexadecimal digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", doc, hierarchy, content, index.cast("string")), 256), 1, 24)


def infer_content_type(given: Column, point: Column, clause: Column, appendix: Column) -> Column:
    """The given type, else point, clause, appendix or article, by the first that is there."""
    there = lambda c: c.isNotNull() & (c != "")
    return F.coalesce(given, F.when(there(point), "point").when(there(clause), "clause").when(there(appendix), "appendix").otherwise("article"))


def expand_abbreviations(text: Column, rules: Mapping[str, str]) -> Column:
    """C14: each whole word of ``rules`` replaced in turn, whatever its case."""
    for short, long in rules.items():
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){_literal(short)}(?![\p{{L}}\p{{N}}_])", long.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def _literal(word: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in word)


def extract_references(text: Column, pattern: str = r"(?iu)điều\s*(\d+)", group: int = 1) -> Column:
    """Distinct matches of a group of ``pattern``, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group))


def source_site(url: Column, trusted: Mapping[str, str]) -> Column:
    """The host without ``www.``; the display name of a trusted domain if the host is it or below it."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    named = [F.when((host == d) | host.endswith("." + d), name) for d, name in trusted.items()]
    return F.coalesce(*named, host) if named else host


def split_sentences(text: Column) -> Column:
    """K1: pieces after ``;`` or a line end with white space, and at full stops before white space that are not next to a digit; trimmed, none empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?<=[;\n]){WHITE}+|(?<!\d)\.(?!\d){WHITE}+")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def lower_words(text: Column) -> Column:
    """Lower-case words, with everything but letters, digits and ``_`` as a break."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


def one_of(word: Column, words_: Sequence[str]) -> Column:
    """Whether a word is in a fixed list; a list of more than ten becomes a hash set."""
    return word.isin(*words_) if words_ else F.lit(False)


def keywords(text: Column, stop_words: Sequence[str] = ANSWER_STOP_WORDS) -> Column:
    """Words of two or more characters that are no stop words, repeats included."""
    return F.filter(lower_words(text), lambda w: (F.length(w) >= 2) & ~one_of(w, stop_words))


def index_terms(text: Column, stop_words: Sequence[str] = INDEX_STOP_WORDS) -> Column:
    """Unigrams of two or more characters that are no stop words, and pairs of neighbours of which at least one is no stop word."""
    stopped = lambda w: one_of(w, stop_words)

    def terms(every: Column) -> Column:
        marked = F.transform(every, lambda w: F.struct(w.alias("w"), stopped(w).alias("s")))
        return F.element_at(F.transform(F.array(marked), of_marked), 1)

    def of_marked(ws: Column) -> Column:
        single = F.transform(F.filter(ws, lambda x: ~x["s"] & (F.length(x["w"]) >= 2)), lambda x: x["w"])
        nexts = F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))
        pairs = F.zip_with(ws, nexts, lambda a, b: F.when(~(a["s"] & b["s"]), F.concat(a["w"], F.lit("_"), b["w"])))
        return F.concat(single, F.array_compact(pairs))

    # a lambda over an array of one element computes the words once, however often they are used
    return F.element_at(F.transform(F.array(lower_words(text)), terms), 1)


def phrases(text: Column, sizes: Sequence[int] = (2, 3)) -> Column:
    """Runs of two and three neighbouring words of two or more characters, joined by a space."""
    long = F.filter(lower_words(text), lambda w: F.length(w) >= 2)

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(long) - n + 1, F.lit(1)))
        return F.when(F.size(long) >= n, F.transform(places, lambda i: F.array_join(F.slice(long, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(runs, sizes))


def format_citation(title: Column, article: Column, clause: Column, point: Column) -> Column:
    """``[title, Điều a, Khoản c, Điểm p]``, the prefix added where it is missing, absent parts left out."""
    part = lambda c, prefix: F.when(c.isNotNull() & (c != ""), F.when(F.lower(c).startswith(prefix.lower()), c).otherwise(F.concat(F.lit(prefix + " "), c)))
    return F.concat(F.lit("["), F.concat_ws(", ", title, part(article, "Điều"), part(clause, "Khoản"), part(point, "Điểm")), F.lit("]"))


def source_tags(text: Column) -> Column:
    """Distinct numbers of ``[SOURCE n]`` tags, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[SOURCE\s+(\d+)\]"), 1)
    return F.array_distinct(F.transform(found, lambda n: n.try_cast("int")))


def token_f1(answer: Column, reference: Column, stop_words: Sequence[str] = ANSWER_STOP_WORDS) -> Column:
    """M4: F1 of the sets of keywords; 0 if either is empty or they share none."""
    a, b = F.array_distinct(keywords(answer, stop_words)), F.array_distinct(keywords(reference, stop_words))
    common = F.size(F.array_intersect(a, b))
    p, r = common / F.size(a), common / F.size(b)
    return F.when(common > 0, 2 * (p * r) / (p + r)).otherwise(0.0)
