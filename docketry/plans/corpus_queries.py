"""Queries over ``documents``, ``pages``, ``orders``, ``labels``, ``benchmark`` and ``embeddings`` for cleaning, structure, chunking and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import dates as D
from docketry.functions import text as T
from docketry.operators import chunking as K
from docketry.operators import structure as S
from docketry.operators import validation as V
from docketry.plans.tables import load, lower_words_sql
from docketry.sources import corpus as C

MD5 = lambda c: F.md5(c.cast("binary"))
TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
trim = TRIM.format


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def c1(spark, d):
    return docs(spark, d).select("doc_id", MD5(T.clean_text(F.col("text"))).alias("digest"))


CLEAN = trim(r"regexp_replace(regexp_replace(replace(replace(replace(coalesce({0}, ''), chr(160), ' '), chr(65279), ''), chr(13), ''), '[ \t]+', ' ', 'g'), '\n[\s\p{{Z}}]*\n+', chr(10) || chr(10), 'g')".format("text"))
C1 = f"SELECT doc_id, md5({CLEAN}) AS digest FROM documents"


def c2(spark, d):
    return load(spark, d, "orders").select("o_orderkey", T.sanitize_null(F.concat(F.lit(" "), "o_orderpriority", F.lit("\n")), ["1-urgent", "5-low"]).alias("priority"))


C2 = "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) NOT IN ('1-urgent', '5-low') THEN o_orderpriority END AS priority FROM orders"

NUMBER = lambda: F.when(F.col("o_orderkey") % 11 == 0, "0").otherwise(F.concat(F.lit(" SỐ: "), "o_orderkey", F.lit(" /20\t"), F.lit("20/"), F.element_at(F.array(*map(F.lit, ("NĐ-CP", "TT-B", "QĐ-X", "QH14", "ABC"))), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit("\nnoise")))
NUMBER_SQL = r"CASE WHEN o_orderkey % 11 = 0 THEN '0' ELSE ' SỐ: ' || o_orderkey || ' /20' || chr(9) || '20/' || ['NĐ-CP', 'TT-B', 'QĐ-X', 'QH14', 'ABC'][o_orderkey % 5 + 1] || chr(10) || 'noise' END"


def c3(spark, d):
    return load(spark, d, "orders").select("o_orderkey", T.clean_document_number(NUMBER()).alias("number"))


C3 = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey || '/2020/' || ['NĐ-CP', 'TT-B', 'QĐ-X', 'QH14', 'ABC'][o_orderkey % 5 + 1] END AS number FROM orders"


def c4(spark, d):
    declared = F.when(F.col("o_orderkey") % 7 == 0, F.lit(" Luật ")).when(F.col("o_orderkey") % 7 == 1, F.lit("Đã biết"))
    ident = F.concat(F.when(F.col("o_orderkey") % 13 == 0, "BLLD_").otherwise("X_"), "o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", T.infer_document_type(NUMBER(), declared, ident).alias("kind"))


C4 = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'Bộ luật' WHEN o_orderkey % 7 = 0 THEN 'Luật' WHEN contains(n, '/NĐ-CP') THEN 'Nghị định' WHEN contains(n, '/TT-') THEN 'Thông tư'
  WHEN contains(n, '/QĐ-') THEN 'Quyết định' WHEN contains(n, '/QH') THEN 'Luật' ELSE 'Văn bản quy phạm' END AS kind FROM (SELECT o_orderkey, {NUMBER_SQL} AS n FROM orders)"""


def c5(spark, d):
    day = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "d/M/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format(day, "d"), F.lit(".13."), F.date_format(day, "yyyy")))
    return load(spark, d, "orders").select("o_orderkey", D.parse_legal_date(F.concat(F.lit("ngày "), written, F.lit(" x"))).alias("day"))


C5 = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate::DATE END AS day FROM orders"


def c6_c7(spark, d):
    """Order dates as issue dates; every third order's start stands in a sentence, every third in its own field."""
    o = load(spark, d, "orders")
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("Nghị định này có hiệu lực thi hành kể từ ngày "), F.date_format(day, "d"), F.lit(" tháng "), F.date_format(day, "M"), F.lit("\n năm "), F.date_format(day, "yyyy")))
    body = body.when(k % 3 == 1, F.lit("có hiệu lực từ ngày ký"))
    issue, start = D.recover_dates(F.date_format(day, "dd/MM/yyyy"), F.when(k % 6 == 2, F.date_format(F.date_add(day, 10), "dd-MM-yyyy")), body)
    rows = o.select("o_orderkey", issue.alias("issue"), start.alias("start"))
    return rows.select("*", D.legal_status(F.when(k % 10 == 0, "Hết hiệu lực").otherwise("unknown"), F.col("start")).alias("status"), D.status_as_of(F.lit(None).cast("string"), F.col("start"), F.lit("1996-01-01").cast("date")).alias("status_1996"))


C6_C7 = """WITH b AS (SELECT o_orderkey, o_orderdate::DATE AS issue, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE WHEN o_orderkey % 6 = 2 THEN o_orderdate::DATE + 10 END AS start FROM orders)
SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'Hết hiệu lực' WHEN start IS NOT NULL THEN 'Còn hiệu lực' ELSE 'unknown' END AS status,
  CASE WHEN start > DATE '1996-01-01' THEN 'Chưa có hiệu lực' WHEN start IS NOT NULL THEN 'Còn hiệu lực' ELSE 'unknown' END AS status_1996 FROM b"""


def c10_c13(spark, d):
    t = docs(spark, d)
    blank = F.lit(None).cast("string")
    clause = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string"))
    return t.select(
        "doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.floor_tokens(F.col("text")).alias("floor_tokens"), T.chunk_id(F.col("source"), F.col("lang"), clause, blank, F.lit("app"), blank, F.col("n_chars")).alias("chunk_id"),
        T.content_hash_id(F.col("source"), F.col("lang"), F.col("text"), F.col("n_chars")).alias("hash_id"), T.infer_content_type(blank, blank, clause, blank).alias("content_type"),
    )


WORDS = r"len(list_filter(string_split_regex(coalesce({}, ''), '[\s\p{{Z}}]+'), lambda w: w <> ''))"
C10_C13 = f"""SELECT doc_id, ceil({WORDS.format("text")} * 1.3::DOUBLE)::INT AS tokens, floor({WORDS.format("text")} * 1.3::DOUBLE)::INT AS floor_tokens, concat_ws('_', source, lang, CASE WHEN doc_id % 3 = 0 THEN doc_id END, n_chars) AS chunk_id,
  substr(sha256(concat_ws('|', source, lang, text, n_chars)), 1, 24) AS hash_id, CASE WHEN doc_id % 3 = 0 THEN 'clause' ELSE 'article' END AS content_type FROM documents"""


def c14(spark, d):
    return load(spark, d, "orders").select("o_orderkey", T.expand_abbreviations(F.col("o_orderpriority"), {"URGENT": "at once", "not": "un", "medium": "mid"}).alias("priority"))


C14 = r"SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(o_orderpriority, '(?i)\burgent\b', 'at once', 'g'), '(?i)\bnot\b', 'un', 'g'), '(?i)\bmedium\b', 'mid', 'g') AS priority FROM orders"


def c15(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.extract_references(F.col("text"), r"(?:token = \"|@)([a-z0-9]{4})"), ",").alias("refs"))


C15 = r"""SELECT doc_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS refs FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:token = "|@)([a-z0-9]{4})', 1) AS r FROM documents)"""


def c16(spark, d):
    return load(spark, d, "pages").select("page_id", T.source_site(F.col("url"), {"example.com": "Example", "m.example.org": "Mobile"}).alias("site"))


C16 = r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS h FROM pages)
SELECT page_id, CASE WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'Example' WHEN h = 'm.example.org' OR h LIKE '%.m.example.org' THEN 'Mobile' ELSE h END AS site FROM h"""


def s4(spark, d):
    return C.extract_page_metadata(load(spark, d, "pages"), {"one": "th", "two": "de"})


def s5(spark, d):
    return load(spark, d, "pages").select("page_id", MD5(C.html_to_text(F.col("html"))).alias("digest"))


_H = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)\s*>|<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/div|/li|/tr|/h[1-6])[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _H = f"replace({_H}, '{_a}', '{_b}')"
_H = rf"regexp_replace(replace(replace(replace({_H}, chr(160), ' '), chr(65279), ''), chr(13), ''), '[ \t]+', ' ', 'g')"
S5 = "SELECT page_id, md5(" + trim(f"regexp_replace({_H}, ' ?\\n[ \\n]*', chr(10), 'g')") + ") AS digest FROM pages"

LINES = "lines AS (SELECT * FROM (SELECT doc_id, unnest(range(len(ls)))::INT AS line_no, " + trim("unnest(ls)") + r" AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents)) WHERE line <> '')"


def lines(spark, d):
    return S.to_lines(docs(spark, d))


def d1(spark, d):
    return lines(spark, d).select("doc_id", "line_no", MD5(F.col("line")).alias("digest"))


D1 = f"WITH {LINES} SELECT doc_id, line_no, md5(line) AS digest FROM lines"

#: Headings of the invented prose: lines that begin with one of some short words.
PATTERNS = {"chapter": r"^(The|Der|La|De) (.*)$", "section": r"^(Of|Und|En|Et) (.*)$", "article": r"^(\p{Lu}\p{Ll}{0,6}) (.*)$"}
INTRO = ("and", "the", "of", "und", "de")
SUFFIX = r"^(?:of|and|die|la|que) "
REST = r"^[^aeiou]"


def headings(spark, d):
    return S.flag_headings(lines(spark, d), PATTERNS, appendix=r"^(?:Appendix|ERERATION)")


HEADS = f"""{LINES}, heads AS (
  SELECT *, CASE WHEN regexp_matches(line, '{PATTERNS["chapter"]}') THEN 'chapter' WHEN regexp_matches(line, '{PATTERNS["section"]}') THEN 'section' WHEN regexp_matches(line, '{PATTERNS["article"]}') THEN 'article' END AS kind,
         CASE WHEN regexp_matches(line, '{PATTERNS["article"]}') THEN split_part(line, ' ', 1) END AS number, CASE WHEN regexp_matches(line, '{PATTERNS["article"]}') THEN {trim("substr(line, instr(line, ' ') + 1)")} END AS title FROM lines)"""


def d2(spark, d):
    return headings(spark, d).select("doc_id", "line_no", "kind", "number", MD5(F.coalesce("title", F.lit(""))).alias("title"))


D2 = f"WITH {HEADS} SELECT doc_id, line_no, kind, number, md5(coalesce(title, '')) AS title FROM heads"


def sure(spark, d):
    return S.reject_references(headings(spark, d), SUFFIX, INTRO, INTRO, REST)


def d3(spark, d):
    return sure(spark, d).select("doc_id", "line_no", "kind", "number")


BESIDE = f"""{HEADS}, beside AS (
  SELECT *, CASE WHEN line_no - lag(line_no) OVER w <= 9 THEN lower(lag(line) OVER w) END AS b, CASE WHEN lead(line_no) OVER w - line_no <= 5 THEN lead(line) OVER w END AS n FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), intro AS (SELECT *, coalesce(NOT regexp_matches(b, '[.:;!?”")]$'), false) AS unfinished, coalesce(NOT regexp_matches(b, '[.:;!?”")]$') AND regexp_matches(right(b, 30), '{"|".join(INTRO)}'), false) AS introduced FROM beside)"""
SURE = f"""{BESIDE}, cite AS (SELECT *, CASE
    WHEN kind = 'article' THEN NOT (regexp_matches(title, '{REST}') AND NOT ends_with(line, ';') AND NOT (unfinished AND (regexp_matches(b, '(?:{"|".join(INTRO)})$') OR regexp_matches(b, '(?:khoản|điều|điểm)\\s+\\d+$'))))
    WHEN kind IS NOT NULL THEN regexp_matches(title, '{SUFFIX}') OR introduced OR (kind = 'chapter' AND regexp_matches(line, '[,;]$')) ELSE false END AS cited,
  kind IN ('chapter', 'section') AND coalesce(regexp_matches(n, '^(?:\\d+\\.\\s|\\p{{Ll}})'), false) AS goes_on FROM intro
), inner_ AS (SELECT *, coalesce(last_value(CASE WHEN NOT cited AND NOT goes_on AND kind IS NOT NULL THEN kind = 'article' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM cite
), sure AS (SELECT doc_id, line_no, line, CASE WHEN NOT (cited OR coalesce(goes_on, false) AND inside) THEN kind END AS kind, CASE WHEN NOT (cited OR coalesce(goes_on, false) AND inside) THEN number END AS number FROM inner_)"""
D3 = f"WITH {SURE} SELECT doc_id, line_no, kind, number FROM sure"


def d6(spark, d):
    return S.carry_hierarchy(sure(spark, d)).select("doc_id", "line_no", "chapter", "section", "article")


D6 = f"""WITH {SURE}, g AS (SELECT *, sum((kind = 'chapter')::INT) OVER w AS ch, last_value(CASE WHEN kind = 'chapter' THEN number END IGNORE NULLS) OVER w AS chapter,
    last_value(CASE WHEN kind IS NOT NULL THEN kind || ':' || number END IGNORE NULLS) OVER w AS l FROM sure WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, line_no, chapter, last_value(CASE WHEN kind = 'section' THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id, coalesce(ch, 0) ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section,
  CASE WHEN l LIKE 'article:%' THEN substr(l, 9) END AS article FROM g"""


def d7(spark, d):
    out = S.sectionize(sure(spark, d), F.col("kind").isNotNull())
    return out.select("doc_id", "seq", "first_line", MD5(F.col("content")).alias("digest"))


D7 = f"""WITH {SURE}, u AS (SELECT *, sum((kind IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS u FROM sure
), g AS (SELECT doc_id, u, min(line_no) AS first_line, md5(string_agg(line, ' ' ORDER BY line_no)) AS digest FROM u GROUP BY doc_id, u)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY u) - 1)::INT AS seq, first_line, digest FROM g"""


def d8(spark, d):
    rows = S.carry_hierarchy(sure(spark, d))
    return S.legal_units(S.split_clauses_points(rows)).select("doc_id", "article", "piece", "clause", "point", "content_type", MD5(F.col("content")).alias("digest"))


def d15(spark, d):
    rows = sure(spark, d).withColumn("block", F.floor(F.col("line_no") / 5))
    return S.appendix_kind(rows, {"a": ("erthion", "token"), "b": ("licensed",), "c": ("|",)}, first=3)


D15 = f"""WITH {LINES}, t AS (SELECT doc_id, line_no // 5 AS block, lower(line) AS line, row_number() OVER (PARTITION BY doc_id, line_no // 5 ORDER BY line_no) AS r FROM lines)
SELECT doc_id, block::BIGINT AS block, CASE WHEN bool_or(contains(line, 'erthion') OR contains(line, 'token')) THEN 'a' WHEN bool_or(contains(line, 'licensed')) THEN 'b' WHEN bool_or(contains(line, '|')) THEN 'c' ELSE 'generic' END AS kind
FROM t WHERE r <= 3 GROUP BY doc_id, line_no_block(block)""".replace("line_no_block(block)", "block")


def k1(spark, d):
    out = docs(spark, d).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("place", "sentence"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sentence")).alias("longest"))


K1 = r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(^|[^\d])\.[\s\p{Z}]+', '\1' || chr(1), 'g'), '([;\n])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents
), f AS (SELECT doc_id, list_filter(list_transform(p, lambda x: """ + trim("x") + """), lambda x: x <> '') AS p FROM s)
SELECT doc_id, len(p) AS n, list_max(list_transform(p, lambda x: len(x)))::INT AS longest FROM f WHERE len(p) > 0"""


def chunks(spark, d):
    return K.chunk_documents(docs(spark, d))


def k10(spark, d):
    out = chunks(spark, d)
    return out.select("doc_id", "chunk_index", "chunk_id", "tokens", MD5(F.col("content")).alias("digest"))


#: Titles of the five appendices of a made law; each has the words of its kind.
TITLES = ("NGHỀ NẶNG NHỌC", "ĐỊA BÀN CỦA VÙNG I", "TUỔI NGHỈ HƯU", "BIỂU MẪU", "QUY ĐỊNH KHÁC")
MADE_LAW = f"""
concat(array('Chương I', 'QUY ĐỊNH CHUNG'),
  transform(slice(ls, 1, m), (x, i) -> concat(CASE WHEN i % 8 = 0 THEN concat('Điều ', div(i, 8) + 1, '. ') WHEN i % 8 IN (1, 2, 5) THEN concat(div(i % 8, 2) + 1, '. ') WHEN i % 8 IN (3, 4) THEN concat(substr('ab', i % 8 - 2, 1), ') ') ELSE '' END, x)),
  flatten(transform(slice(ls, m + 1, n), (x, j) -> concat(
    CASE WHEN j = 0 OR div(5 * (j - 1), n - m) <> div(5 * j, n - m) THEN array(concat('Phụ lục ', element_at(array('I', 'II', 'III', 'IV', 'V'), int(div(5 * j, n - m) + 1))), element_at(array{TITLES!r}, int(div(5 * j, n - m) + 1))) ELSE array() END,
    CASE div(5 * j, n - m)
      WHEN 0 THEN concat(CASE WHEN j % 6 = 0 THEN array('II. KHAI THÁC') ELSE array() END, CASE WHEN j % 3 = 1 THEN array('Điều kiện lao động loại V') ELSE array() END, array(string(j + 1), x))
      WHEN 1 THEN concat(CASE WHEN j % 4 = 3 THEN array(concat(j, '. Vùng II, gồm các địa bàn:')) ELSE array() END, array(x))
      WHEN 2 THEN concat(CASE WHEN j % 5 = 0 THEN array(concat('Lao động ', IF(j % 2 = 0, 'nam', 'nữ'))) ELSE array() END, array(x))
      WHEN 3 THEN concat(CASE WHEN j % 4 = 2 THEN array(concat('Mẫu số ', j)) ELSE array() END, array(x))
      ELSE array(x) END))))"""


def laws(spark, d):
    """Every document as a law: the first half of its lines under articles, clauses and points, the second in five appendices, of occupations, regions, retirement, forms and others."""
    rows = docs(spark, d).withColumn("ls", F.expr(r"filter(split(coalesce(text, ''), '\\r?\\n'), x -> trim(x) <> '')")).withColumn("n", F.size("ls")).withColumn("m", F.expr("int(n - div(n, 2))"))
    return rows.filter("n > 0").select("doc_id", F.array_join(F.expr(MADE_LAW), "\n").alias("text"), F.concat("doc_id", F.lit("/2020/NĐ-CP")).alias("so_hieu"), F.concat(F.lit("Ngày "), F.col("doc_id") % 28 + 1, F.lit("/2/2020")).alias("ngay_ban_hanh"))


def k10_legal(spark, d):
    out = K.chunk_legal_documents(laws(spark, d))
    return out.select("document_id", "chunk_index", "chunk_id", "chapter_number", "section_number", "article_number", "clause_number", "point_number", "content_type", "appendix_number", "appendix_title", MD5(F.col("content")).alias("digest"))


def c9(spark, d):
    out = T.restore_metadata(docs(spark, d).withColumn("so_hieu", F.concat("doc_id", F.lit("/2020/NĐ-CP"))).withColumn("ngay_ban_hanh", F.lit("Ngày 1/2/2020")))
    return out.select("document_id", "document_number", "document_title", "document_type", "issue_date", "effective_from", "legal_status", "source_url")


C9 = """SELECT doc_id AS document_id, doc_id || '/2020/NĐ-CP' AS document_number, 'Nghị định số ' || doc_id || '/2020/NĐ-CP' AS document_title, 'Nghị định' AS document_type, DATE '2020-02-01' AS issue_date,
  NULL::DATE AS effective_from, 'unknown' AS legal_status, source AS source_url FROM documents"""


def v14(spark, d):
    """Documents and how many of their words no chunk holds: none may be lost."""
    return V.text_loss(docs(spark, d).select("doc_id", "text"), chunks(spark, d))


V14 = f"SELECT doc_id, len(list_distinct({lower_words_sql('text')}))::INT AS words, 0::BIGINT AS lost FROM documents"


def v1(spark, d):
    rules = {"text": F.length("text") >= 200, "lang": F.col("lang").isin("en", "fr"), "source": F.col("source") != "src3"}
    good, bad = V.validate(docs(spark, d).select("doc_id", "text", "lang", "source"), rules)
    return good.select("doc_id", F.lit("").alias("violations")).unionByName(bad.select("doc_id", F.array_join("violations", ",").alias("violations")))


V1 = "SELECT doc_id, concat_ws(',', CASE WHEN len(text) < 200 THEN 'text' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang' END, CASE WHEN source = 'src3' THEN 'source' END) AS violations FROM documents"


def v2(spark, d):
    return V.duplicate_ids(load(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


V2 = "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders) WHERE t > 1"


def v3(spark, d):
    return V.token_profile(docs(spark, d), "text")


_T = f"ceil({WORDS.format('text')} * 1.3::DOUBLE)::INT"
V3 = f"""WITH t AS (SELECT {_T} AS t FROM documents), c AS (SELECT count(*) AS n, min(t) AS least, max(t) AS most, avg(t) AS mean, median(t)::DOUBLE AS median, count(*) FILTER (t < 100) AS class_0,
  count(*) FILTER (t >= 100 AND t <= 350) AS class_1, count(*) FILTER (t > 350 AND t <= 800) AS class_2, count(*) FILTER (t > 800) AS class_3 FROM t)
SELECT *, round(100.0 * class_0 / n, 2)::DOUBLE AS percent_0, round(100.0 * class_1 / n, 2)::DOUBLE AS percent_1, round(100.0 * class_2 / n, 2)::DOUBLE AS percent_2, round(100.0 * class_3 / n, 2)::DOUBLE AS percent_3 FROM c"""


def v4(spark, d):
    return V.type_distribution(docs(spark, d).withColumn("kind", F.when(F.col("lang") != "en", F.col("lang"))), "kind")


V4 = "SELECT CASE WHEN lang = 'en' THEN 'article' ELSE lang END AS value, count(*) AS n FROM documents GROUP BY 1"


def v5(spark, d):
    rows = docs(spark, d).join(load(spark, d, "labels"), "doc_id", "left").withColumn("site", F.when(F.col("source") == "src1", "unknown").otherwise(F.col("source")))
    return V.coverage(rows, ["text", "lang", "quality", "toxic", "site"])


V5 = """WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)), t AS (SELECT count(*) AS n FROM j)
SELECT field, there, unknown, round(100.0 * there / n, 2)::DOUBLE AS percent FROM (
  SELECT 'text' AS field, count(*) FILTER (text <> '') AS there, 0::BIGINT AS unknown FROM j UNION ALL SELECT 'lang', count(lang), 0 FROM j UNION ALL SELECT 'quality', count(quality), 0 FROM j
  UNION ALL SELECT 'toxic', count(toxic), 0 FROM j UNION ALL SELECT 'site', count(*) FILTER (source <> 'src1'), count(*) FILTER (source = 'src1') FROM j), t"""


def v6(spark, d):
    out = V.corpus_summary(docs(spark, d), "source", "text")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_chars", "mean_words")})


V6 = f"""WITH s AS (SELECT source, len(text)::INT AS c, {WORDS.format("text")}::INT AS w FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c) - 1 AS ci, row_number() OVER (PARTITION BY source ORDER BY w) - 1 AS wi, count(*) OVER (PARTITION BY source) AS n FROM s)
SELECT source, count(*) AS n, min(c) AS least_chars, max(c) AS most_chars, round(avg(c), 6) AS mean_chars, min(w) AS least_words, max(w) AS most_words, round(avg(w), 6) AS mean_words,
  min(c) FILTER (ci = n // 2) AS median_chars, min(c) FILTER (ci = least(floor(0.95 * n), n - 1)) AS p95_chars, min(w) FILTER (wi = n // 2) AS median_words, min(w) FILTER (wi = least(floor(0.95 * n), n - 1)) AS p95_words FROM r GROUP BY source"""


def v7(spark, d):
    vectors = load(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"), F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("vector"))
    return V.index_audit(docs(spark, d), vectors, "doc_id", "vector", 64)


V7 = """SELECT 'orphan_vector' AS problem, vec_id * 3 AS doc_id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unindexed_chunk', doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id * 3 FROM embeddings) UNION ALL SELECT 'dimension', vec_id * 3 FROM embeddings WHERE vec_id % 50 = 0"""


def questions(spark, d):
    b = load(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 4 == 0).alias("requires_refusal"), F.concat(F.lit("c"), F.col("item_id") % 3).alias("category"))


def gold(spark, d):
    return load(spark, d, "benchmark").filter("item_id % 5 <> 0").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 37).alias("doc_id"))


def v8(spark, d):
    return V.validate_questions(questions(spark, d), gold(spark, d), docs(spark, d), pattern=r"^\d{2,}$")


V8 = """WITH q AS (SELECT item_id AS query_id, text, item_id % 4 = 0 AS refuse FROM benchmark), g AS (SELECT item_id AS query_id, item_id * 37 AS doc_id FROM benchmark WHERE item_id % 5 <> 0)
SELECT query_id, 'id' AS problem FROM q WHERE query_id < 10 UNION ALL SELECT query_id, 'duplicate_text' FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY query_id) AS t FROM q) WHERE t > 1
UNION ALL SELECT query_id, 'refusal_with_gold' FROM q WHERE refuse AND query_id IN (SELECT query_id FROM g) UNION ALL SELECT query_id, 'no_gold' FROM q WHERE NOT refuse AND query_id NOT IN (SELECT query_id FROM g)
UNION ALL SELECT DISTINCT query_id, 'unknown_gold' FROM g WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""


def v10(spark, d):
    return V.question_groups(questions(spark, d), "category")


V10 = """SELECT 'c' || (item_id % 3) AS category, count(*) AS n, count(*) FILTER (item_id % 4 <> 0) AS answerable, count(*) FILTER (item_id % 4 = 0) AS refusals, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent,
  round(100.0 * count(*) FILTER (item_id % 4 = 0) / count(*), 2)::DOUBLE AS refusal_percent FROM benchmark GROUP BY 1"""


def v11(spark, d):
    return V.document_coverage(docs(spark, d), gold(spark, d))


V11 = "SELECT d.doc_id, 1::BIGINT AS chunks, (SELECT count(*) FROM benchmark b WHERE b.item_id % 5 <> 0 AND b.item_id * 37 = d.doc_id) AS citations FROM documents d"


def v12(spark, d):
    return V.table_checksum(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"])


V12 = "SELECT count(*) AS n, (sum(('0x' || substr(sha256(l_orderkey || '|' || l_linenumber || '|' || l_returnflag || '|' || l_partkey), 1, 12))::BIGINT::HUGEINT) % 281474976710656)::BIGINT AS checksum FROM lineitem"


def v13(spark, d):
    o = load(spark, d, "orders")
    edges = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.lit("replaced").alias("status"), F.col("o_orderdate").cast("date").alias("since"), (F.col("o_orderkey") + 1).alias("replaced_by"))
    asked = load(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("doc_id"))
    return V.validity_audit(asked, edges, F.lit("1995-06-01").cast("date"))


V13 = "SELECT l_partkey AS query_id, o_orderkey AS doc_id, 'replaced' AS status, o_orderkey + 1 AS suggested FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderstatus = 'F' AND o_orderdate::DATE <= DATE '1995-06-01'"

QUERIES = {
    "c1_clean_text": (c1, C1), "c2_sanitize_null": (c2, C2), "c3_clean_document_number": (c3, C3), "c4_infer_document_type": (c4, C4), "c5_parse_legal_date": (c5, C5), "c6_c7_dates_and_status": (c6_c7, C6_C7),
    "c10_c13_tokens_and_ids": (c10_c13, C10_C13), "c14_expand_abbreviations": (c14, C14), "c15_extract_references": (c15, C15), "c16_source_site": (c16, C16), "s4_page_metadata": (s4, None), "s5_html_to_text": (s5, S5),
    "d1_to_lines": (d1, D1), "d2_flag_headings": (d2, D2), "d3_reject_references": (d3, D3), "d6_carry_hierarchy": (d6, D6), "d7_sectionize": (d7, D7), "d8_d9_legal_units": (d8, None), "d15_appendix_kind": (d15, D15),
    "k1_split_sentences": (k1, K1), "k10_chunk_documents": (k10, None), "k10_legal_chunks": (k10_legal, None), "c9_restore_metadata": (c9, C9), "v1_validate": (v1, V1), "v2_duplicate_ids": (v2, V2), "v3_token_profile": (v3, V3), "v4_type_distribution": (v4, V4), "v5_coverage": (v5, V5),
    "v6_corpus_summary": (v6, V6), "v7_index_audit": (v7, V7), "v8_validate_questions": (v8, V8), "v10_question_groups": (v10, V10), "v11_document_coverage": (v11, V11), "v12_table_checksum": (v12, V12), "v13_validity_audit": (v13, V13), "v14_zero_text_loss": (v14, V14),
}
