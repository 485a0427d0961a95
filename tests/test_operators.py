"""Operators outside ``llm`` on hand-made rows with known answers."""

import re
import datetime
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions import dates as D
from docketry.functions import text as T
from docketry.operators import chunking as K
from docketry.operators import context as X
from docketry.operators import embeddings as EM
from docketry.operators import evaluation as E
from docketry.operators import guards as G
from docketry.operators import payroll as P
from docketry.operators import questions as Q
from docketry.operators import retrieval as R
from docketry.operators import structure as S
from docketry.sources import corpus as C
from docketry.streaming import history as H


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


LAW = """Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
1. Bộ luật này quy định tiêu chuẩn lao động.
a) Người lao động;
b) Người sử dụng lao động.
2. Theo quy định tại
Điều 5 của Bộ luật này thì được nghỉ.
1.000.000 đồng là mức phạt.
Mục 1
NGHỈ NGƠI
Điều 2. Thời giờ nghỉ ngơi
Nghỉ ít nhất 30 phút.
Chương II
HỢP ĐỒNG
Điều 3. Hợp đồng lao động
Hai bên tự nguyện giao kết.
Phụ lục I
Mẫu số 1"""


def test_cleaning(spark):
    assert value(spark, T.clean_text(F.lit("a  b﻿ \t c\r\n\n \n\nd "))) == "a b c\n\nd"
    assert [value(spark, T.sanitize_null(F.lit(x))) for x in (" N/A ", "Không rõ", "0", "x ")] == [None, None, None, "x"]
    assert value(spark, T.clean_document_number(F.lit("số: 12/2020 /NĐ-CP\nx"))) == "12/2020/NĐ-CP"
    assert value(spark, T.clean_document_number(F.lit("Đã biết"))) is None
    none = F.lit(None).cast("string")
    assert value(spark, T.infer_document_type(F.lit("12/2020/NĐ-CP"), none, F.lit("X"))) == "Nghị định"
    assert value(spark, T.infer_document_type(F.lit("Loại văn bản: Thông tư\n"), F.lit("null"), F.lit("X"))) == "Thông tư"
    assert value(spark, T.infer_document_type(none, F.lit("Luật"), F.lit("BLLD_2019"))) == "Bộ luật"
    assert value(spark, T.official_title(F.lit("NGHỊ ĐỊNH\n(kèm) Về  tiền lương\nĐiều 1"), F.lit("Nghị định"), F.lit("1/2020"), r"(?s)NGHỊ ĐỊNH\s+(.*?)\nĐiều")) == "Nghị định số 1/2020 Về tiền lương"
    assert [value(spark, T.estimate_tokens(F.lit(x))) for x in ("", " ", "a b c")] == [0, 0, 4]
    assert value(spark, T.chunk_id(F.lit("D"), none, F.lit("1"), none, F.lit("Phụ lục I"), none, F.lit(3))) == "D_1_PhụlụcI_3"
    assert value(spark, T.expand_abbreviations(F.lit("NLĐ và nlđx"), {"nlđ": "người lao động"})) == "người lao động và nlđx"
    assert value(spark, T.extract_references(F.lit("Điều 12, điều 5 ĐIỀU 12"))) == ["12", "5"]
    assert value(spark, T.format_citation(F.lit("Luật"), F.lit("12"), none, F.lit("Điểm a"))) == "[Luật, Điều 12, Điểm a]"
    assert value(spark, T.source_tags(F.lit("x [SOURCE 2][SOURCE 1] [SOURCE 2]"))) == [2, 1]
    assert value(spark, T.index_terms(F.lit("Người lao động và của các công ty"))) == ["người", "lao", "động", "công", "ty", "người_lao", "lao_động", "động_và", "các_công", "công_ty"]
    assert value(spark, T.phrases(F.lit("a bb cc dd"))) == ["bb cc", "cc dd", "bb cc dd"]
    assert value(spark, T.token_f1(F.lit("lao động nghỉ"), F.lit("Lao động, làm!"))) == pytest.approx(2 / 3)


def test_dates(spark):
    day = datetime.date
    cases = {"ngày 1/2/2020": day(2020, 2, 1), "2020-02-01": day(2020, 2, 1), "31/02/2020 2020-01-01": None, "Đã biết": None, "x": None, "1.2.2020": day(2020, 2, 1)}
    assert {k: value(spark, D.parse_legal_date(F.lit(k))) for k in cases} == cases
    none = F.lit(None).cast("string")
    body = F.lit("Nghị định này có hiệu lực thi hành kể từ ngày 15 \n tháng 2 năm 2021.")
    assert value(spark, D.recover_dates(F.lit("01/01/2020"), none, body)[1]) == day(2021, 2, 15)
    assert value(spark, D.recover_dates(F.lit("01/01/2020\nNgày hiệu lực: 5/5/2020"), none, body)[1]) == day(2020, 5, 5)
    assert value(spark, D.recover_dates(F.lit("01/01/2020"), none, F.lit("có hiệu lực từ ngày ký"))[1]) == day(2020, 1, 1)
    now = F.lit(day(2024, 6, 1))
    asked = {"hiện nay": day(2024, 6, 1), "tháng 5 năm 2020": day(2020, 5, 1), "vào năm 2022": day(2022, 12, 31), "ngày 3 tháng 4 năm 2021": day(2021, 4, 3), "7/8/2019 thì": day(2019, 8, 7), "không": None}
    assert {k: value(spark, D.temporal_intent(F.lit(k), now)) for k in asked} == asked
    assert value(spark, D.legal_status(F.lit("đã biết"), F.lit(day(2020, 1, 1)))) == "Còn hiệu lực"


def test_structure_of_a_law(spark):
    docs = spark.createDataFrame([(1, LAW), (2, None), (3, "")], "doc_id long, text string")
    rows = S.carry_hierarchy(S.flag_appendix_start(S.reject_references(S.flag_headings(S.to_lines(docs)))))
    found = {r.line: r for r in rows.collect()}
    assert found["Điều 5 của Bộ luật này thì được nghỉ."].kind is None
    assert found["Điều 5 của Bộ luật này thì được nghỉ."].article == "1"
    assert (found["Mục 1"].chapter, found["Mục 1"].section, found["Mục 1"].article) == ("I", "1", None)
    assert (found["Nghỉ ít nhất 30 phút."].section, found["Nghỉ ít nhất 30 phút."].article) == ("1", "2")
    assert (found["Điều 3. Hợp đồng lao động"].chapter, found["Điều 3. Hợp đồng lao động"].section) == ("II", None)
    assert found["Phụ lục I"].appendix_start and found["Mẫu số 1"].article is None
    units = S.legal_units(S.split_clauses_points(rows.filter("article = '1'"))).orderBy("piece").collect()
    assert [(u.clause, u.point, u.content_type) for u in units] == [(None, None, "other"), (1, None, "clause"), (1, "a", "point"), (1, "b", "point"), (2, None, "clause")]
    assert "1.000.000 đồng" in units[-1].content


def kinds(spark, text):
    rows = S.reject_references(S.flag_headings(S.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))).orderBy("line_no").collect()
    return [(r.kind, r.number) for r in rows if r.candidate]


def test_citations_and_headings(spark):
    assert kinds(spark, "Điều 1. Tên dài,\ngồm hai dòng\nMục 2. Quyền,") == [("article", "1"), ("section", "2")]
    assert kinds(spark, "Chương I, II,") == [(None, None)]
    assert kinds(spark, "Điều 12 Nghị định này\nĐiều 3: Có\nĐiều 4 – Có\nĐiều 5.;") == [(None, None), ("article", "3"), ("article", "4"), (None, None)]
    assert kinds(spark, "được quy định tại khoản 1\nĐiều 142.") == [(None, None)]
    assert kinds(spark, "hồ sơ quy định tại phần này\nChương II") == [(None, None)]  # within the last 30 characters
    assert kinds(spark, "hồ sơ quy định tại phần này.\nChương II") == [("chapter", "II")]
    assert kinds(spark, "Điều 1. Tên\nChương II\n2. khoản\nMục 3\nsau đó\nMục 4\nTÊN PHẦN\nChương V\nchữ thường") == [
        ("article", "1"), (None, None), (None, None), ("section", "4"), ("chapter", "V"),
    ]


def starts(spark, text):
    rows = S.flag_appendix_start(S.reject_references(S.flag_headings(S.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))))
    return [r.line for r in rows.filter("appendix_start").orderBy("line_no").collect()]


def test_appendix_starts(spark):
    law = "Điều 1. Tên\nnội dung."
    assert starts(spark, f"{law}\nPhụ lục I\nTÊN") == ["Phụ lục I"] and starts(spark, "Phụ lục I\nTÊN") == []
    assert starts(spark, f"{law}\nPhụ lục I ban hành kèm theo Nghị định\nTÊN") == []
    assert starts(spark, f"{law}\ntheo quy định tại\nPhụ lục I\nTÊN") == starts(spark, f"{law}\nxem điều 5\nPhụ lục I\nTÊN") == []
    assert starts(spark, f"{law}\nPhụ lục I\n2. hai") == starts(spark, f"{law}\nPhụ lục I\na) một") == starts(spark, f"{law}\nPhụ lục I\nvà sau đó") == []
    assert starts(spark, f"{law}\nPhụ lục I\nTÊN\nĐiều 2. Sau") == starts(spark, f"{law}\nPhụ lục I\nTÊN\nChương III") == []
    assert starts(spark, f"{law}\nMẫu số 3\nTÊN\nĐiều 1. Cũ") == ["Mẫu số 3"]


def test_legal_chunks(spark):
    """Articles, clauses, points and appendices end to end; every line of an article or appendix is in some chunk of its own article."""
    w = lambda n, k=0: " ".join(f"từ{k}x{i}" for i in range(n))
    text = "\n".join([
        "LUẬT", "VỀ LAO ĐỘNG", "Căn cứ Hiến pháp;", "Chương I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", f"Luật này {w(20)}.", "Mục 1", "Tên mục", "Điều 2. Quyền của", "người lao động", "1. Ngắn một.", "2. Ngắn hai.",
        f"3. Dài {w(200, 3)}.", "4. Mở đầu:", *[f"{c}) điểm {w(110, ord(c))};" for c in "abcde"], "theo quy định tại", "Điều 9 của Luật này", "5. Cuối.", "Chương II", "Điều 3. Hết", f"Câu. {w(700, 5)}. {w(300, 6)}.",
        "Phụ lục I", "DANH SÁCH", "Mẫu số 2", f"Nội dung {w(60, 8)}",
    ])
    docs = spark.createDataFrame([("ND_1", text, "01/2020/NĐ-CP", "1/2/2020"), ("B", None, None, None), ("C", " ", "x", None)], "doc_id string, text string, so_hieu string, ngay_ban_hanh string")
    rows = K.chunk_legal_documents(docs).orderBy("document_id", "chunk_index").collect()
    assert {r.document_id for r in rows} == {"ND_1"} and [r.chunk_index for r in rows] == list(range(len(rows))) and len({r.chunk_id for r in rows}) == len(rows)
    assert set(rows[0].asDict()) == set(K.CHUNK_FIELDS) and len(K.CHUNK_FIELDS) == 25
    first = rows[0]
    assert (first.article_number, first.article_title, first.chapter_number, first.chapter_title, first.section_number, first.content_type) == ("Điều 1", "Phạm vi", "Chương I", "QUY ĐỊNH CHUNG", None, "article")
    assert (first.document_number, first.document_type, str(first.issue_date), first.parent_article, first.chunk_id) == ("01/2020/NĐ-CP", "Nghị định", "2020-02-01", "ND_1_Điều1", "ND_1_Điều1_0")
    assert first.document_title == "Nghị định số 01/2020/NĐ-CP VỀ LAO ĐỘNG"
    second = [r for r in rows if r.article_number == "Điều 2"]
    assert {r.article_title for r in second} == {"Quyền của người lao động"} and {r.section_title for r in second} == {"Tên mục"}
    assert second[0].clause_number == "Khoản 1 đến Khoản 3" or second[0].clause_number == "Khoản 1 đến Khoản 2"
    points = [r.point_number for r in second if r.content_type == "point"]
    assert points and points[0].startswith("Điểm a") and points[-1].endswith("e") and all("4. Mở đầu:" in r.content for r in second if r.content_type == "point")
    third = [r for r in rows if r.article_number == "Điều 3"]
    assert len(third) > 1 and {(r.chapter_number, r.section_number) for r in third} == {("Chương II", None)}
    config = K.ChunkConfig()
    assert all(config.tokens(r.content) <= config.most for r in rows)
    last = rows[-1]
    assert last.article_number is None and last.content_type == "form" and last.content.startswith("Phụ lục I\nDANH SÁCH\n\nMẫu số 2")
    words = {a: set(" ".join(r.content for r in rows if r.article_number == a).split()) for a in ("Điều 1", "Điều 2", "Điều 3", None)}
    lines, at = text.split("\n"), None
    for line in lines[5:]:
        at = line.split(".")[0] if re.match(r"Điều [123]\.", line) else None if line.startswith("Phụ lục") else at
        if not line.startswith(("Chương", "Mục", "Tên mục")):
            assert {x.strip(".") for x in line.split()} <= {x.strip(".") for x in words[at]}, line[:60]


def test_clause_guard():
    lines = ["lead", "2. no", "1. one", "3. three", "6. no", "a) point", "e) no", "c) point", "50.5 % no", "4. four"]
    assert [(p.clause, p.point) for p in S.clauses_and_points(lines)] == [(None, None), (1, None), (3, None), (3, "a"), (3, "c"), (4, None)]
    quoted = ["1. one", "“2. quoted", "3. quoted”", "2. two"]
    assert [p.clause for p in S.clauses_and_points(quoted, quotes=True)] == [None, 1, 2]


def test_title_over_lines(spark):
    docs = spark.createDataFrame([(1, "Điều 1. Quyền và\nnghĩa vụ của\nngười lao động.\nkhông")], "doc_id long, text string")
    first = S.join_title_lines(S.flag_headings(S.to_lines(docs))).orderBy("line_no").first()
    assert (first.full_title, first.title_lines) == ("Quyền và nghĩa vụ của người lao động. không", 3)  # small letters go on, up to four parts


def test_catalog_and_forms(spark):
    text = "NGHỀ A\nLoại IV\n1. một\n2. hai\nthêm\n3. ba\nLoại V\n1. bốn"
    rows = S.catalog(S.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")), "^NGHỀ", "^Loại", r"^\d+\.", batch=2)
    assert sorted((r.sector, r.tier, r.unit, r.content) for r in rows.collect()) == [("NGHỀ A", "Loại IV", 0, "1. một\n2. hai\nthêm"), ("NGHỀ A", "Loại IV", 1, "3. ba"), ("NGHỀ A", "Loại V", 0, "1. bốn")]
    forms = S.forms(S.to_lines(spark.createDataFrame([(1, "Mẫu số 1\nx y z\nMẫu số\n2\nw")], "doc_id long, text string")), most_words=4)
    assert [(r.seq, r.part) for r in forms.orderBy("seq", "part").collect()] == [(0, 0), (0, 1), (1, 0)]
    limited = S.word_limited_units(S.to_lines(spark.createDataFrame([(1, "\n".join(["a b c"] * 5))], "doc_id long, text string")), F.lit(False), 6)
    assert limited.count() == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["one two three.", "a;\n", "1.5 x", "word " * 30, "\n\n", "end. "]), max_size=12))
def test_packing_loses_no_word_and_keeps_to_its_limit(parts):
    config = K.ChunkConfig(least=6, target=12, most=20, overlap=5)
    text = " ".join(parts)
    pieces = K.pack_text(text, config)
    assert Counter(text.replace(".", " ").split()).keys() <= Counter(" ".join(pieces).replace(".", " ").split()).keys()
    assert all(config.tokens(p) <= config.most for p in pieces)


def test_merges():
    config = K.ChunkConfig(least=10, target=20, most=30, overlap=2, header=4)
    w = lambda n: " ".join(["w"] * n)
    assert K.merge_short([w(3), w(3), w(12)], config, " ") == [w(6), w(12)]
    assert K.merge_tail([w(15), w(3)], config, " ") == [w(18)]
    assert K.merge_headers([w(1), w(1), w(9), w(1)], config, " ") == [w(11), w(1)]
    assert K.group_points([w(5), w(5), w(5), w(2)], "lead", config) == [f"lead\n{w(5)}\n{w(5)}", f"lead\n{w(5)}\n{w(2)}"]
    with pytest.raises(ValueError, match="not in order"):
        K.ChunkConfig(least=10, target=5)


def test_payroll(spark):
    f, t = F.lit(False), F.lit(True)
    rates = [value(spark, P.overtime_pay(F.lit(100.0), F.lit(1.0), F.lit(d), n, o)).rate for d, n, o in (("normal", f, t), ("weekend", f, t), ("holiday", f, t), ("normal", t, f), ("normal", t, t), ("weekend", t, t), ("holiday", t, t))]
    assert rates == [150, 200, 300, 130, 210, 270, 390]
    years = [value(spark, P.rounded_years(F.lit(float(m)))) for m in (0, 12, 13, 18, 19, 12.5)]
    assert years == [0, 1, 1.5, 1.5, 2, 2]
    assert value(spark, P.severance(F.lit(10.0), F.lit(6.0), F.lit(0.0), F.lit(0.0), t)).months == 2
    assert [value(spark, P.accident_benefit(F.lit(1.0), F.lit(x), f)).months for x in (5.0, 10.0, 11.0, 81.0, 3.0)] == [1.5, 1.5, 1.9, 30, None]
    assert value(spark, P.unemployment_benefit(F.lit(1000.0), F.lit(60.0), F.lit(100.0))).amount == 2500
    assert value(spark, P.unemployment_benefit(F.lit(1000.0), F.lit(6.0), F.lit(100.0))).error


def test_retrieval_modes_and_lsh(spark):
    draw = np.random.default_rng(0)
    points = draw.normal(size=(200, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(999, None)], "doc_id long, vector array<double>")
    queries = vectors.filter("doc_id < 10").select(F.col("doc_id").alias("query_id"), "vector", F.concat(F.lit("alpha w"), "doc_id").alias("text"))
    docs = vectors.select("doc_id", F.concat(F.lit("alpha w"), F.col("doc_id") % 20, F.lit(" beta")).alias("text"))
    exact = R.retrieve("dense", queries, docs, vectors, 5).collect()
    assert {(r.query_id, r.doc_id) for r in exact if r.rank == 1} == {(i, i) for i in range(10)}
    near = {(r.query_id, r.doc_id) for r in R.dense_topk_lsh(queries, vectors, 5).collect()}
    assert len(near & {(r.query_id, r.doc_id) for r in exact}) >= 0.9 * len(exact)
    lexical = R.retrieve("bm25", queries, docs, vectors, 3).filter("rank = 1").collect()
    assert all(r.doc_id % 20 == r.query_id and r.score == 1 for r in lexical)
    assert R.retrieve("hybrid", queries, docs, vectors, 4).groupBy("query_id").count().filter("count = 4").count() == 10
    with pytest.raises(ValueError, match="none of"):
        R.retrieve("x", queries, docs, vectors, 3)


def test_corrective_merge(spark):
    schema = "query_id int, doc_id int, score double, status string, relevant boolean"
    first = spark.createDataFrame([(1, 10, 0.5, "PARTIAL", True), (2, 20, 0.5, "PARTIAL", True), (3, 30, 0.5, "PARTIAL", True), (4, 40, 0.5, "INSUFFICIENT", True)], schema)
    second = spark.createDataFrame([(1, 11, 0.9, "SUFFICIENT", True), (2, 21, 0.6, "PARTIAL", True), (3, 31, 0.2, "INSUFFICIENT", True)], schema)
    assert sorted((r.query_id, r.doc_id) for r in R.corrective_merge(first, second).collect()) == [(1, 11), (2, 20), (2, 21), (3, 30)]


def test_p_values():
    assert E.p_value_t(-2.965, 249) == pytest.approx(0.0033, abs=5e-5)
    assert E.p_value_t(0.0, 10) == 1.0 and E.p_value_t(1.96, 100_000) == pytest.approx(0.05, abs=1e-3)


def test_answers_and_citations(spark):
    a = value(spark, E.answer_correctness(F.lit("Theo Điều 125 người lao động bị sa thải"), F.lit("người lao động bị sa thải"), F.array(F.lit("D_Điều 12")), F.array().cast("array<string>"), F.lit(False), F.lit(False)))
    assert (a.status, a.article_recall) == ("CORRECT", 1.0)  # a part of a number counts unless strict
    a = value(spark, E.answer_correctness(F.lit("Điều 125"), F.lit("x"), F.array(F.lit("D_Điều 12")), F.array().cast("array<string>"), F.lit(False), F.lit(False), strict=True))
    assert a.status == "INCORRECT"
    c = value(spark, E.citation_metrics(F.array(F.lit("[Luật, Điều 5]"), F.lit("[Luật, Điều 9]")), F.array(F.lit("điều5")), F.array(F.lit("điều5")), F.lit(False), F.lit(False)))
    assert (c.total, c.valid, c.gold_matching, c.precision, c.accuracy, c.invalid_rate) == (2, 1, 1, 0.5, 0.0, 0.5)
    assert value(spark, E.error_type(F.lit("INCORRECT"), F.lit(False), F.lit(1.0), F.lit(False), F.lit(False))) == "RETRIEVAL"
    assert value(spark, E.faithfulness(F.lit("Điều 7 quy định nghỉ phép năm"), F.lit("điều 8 nghỉ phép năm"), F.lit(False))).status == "UNSUPPORTED"


def test_claims(spark):
    rows = [(1, "Điều 5 quy định 12 ngày nghỉ phép. Người lao động được hưởng lương.", "điều 5: 12 ngày nghỉ phép, người lao động được hưởng nguyên lương"), (2, "Điều 9 quy định nghỉ phép năm.", "điều 5 nghỉ phép"), (3, " ", "x"), (4, "Xin chào bạn nhé, rất vui!", "x")]
    out = {r.answer_id: r for r in G.verify_claims(spark.createDataFrame(rows, "answer_id int, answer string, context string")).collect()}
    assert [out[k].action for k in (1, 2, 3, 4)] == ["ALLOW", "BLOCK_REFUSAL", "BLOCK_REFUSAL", "ALLOW"]
    assert (out[1].n_entailed, out[2].n_contradicted) == (2, 1)


def test_strips_and_context(spark):
    assert value(spark, X.strips_of(F.lit("Điều 5. Nghỉ\n1. một hai 2. ba\n" + "Câu này dài. " * 30)))[:3] == ["Điều 5. Nghỉ", "1. một hai", "2. ba"]
    rows = spark.createDataFrame([(1, 1, 1, "w " * 10), (1, 2, 2, "w " * 10), (1, 1, 3, "w"), (1, 3, 4, "w")], "query_id int, doc_id int, rank int, content string")
    out = {r.doc_id: r.included for r in X.pack_context(rows, budget=20, separator=5).collect()}
    assert out == {1: True, 2: False, 3: False}
    answers = spark.createDataFrame([(1, "a [SOURCE 1] b [SOURCE 12] [SOURCE 3]")], "answer_id int, text string")
    sources = spark.createDataFrame([(1, 1, "$one\\"), (1, 12, "two")], "answer_id int, n int, citation string")
    r = X.resolve_citations(answers, sources).first()
    assert (r.text, r.resolved, r.invalid) == ("a $one\\ b two ", [1, 12], [3])
    sub = spark.createDataFrame([(1, 0, "q0", 1, "x"), (1, 1, "q1", 1, "y"), (1, 0, "q0", 2, "z")], "query_id int, sub_no int, sub_query string, rank int, content string")
    assert X.sectioned_context(sub).first().context == "## q0\n[SOURCE 1] x\n[SOURCE 2] z\n\n## q1\n[SOURCE 3] y"


def test_questions(spark):
    rows = spark.createDataFrame([(1, "So sánh Luật A và Luật B về nghỉ phép"), (2, "Điều 3 và Điều 5 quy định gì"), (3, "nghỉ phép và lương thưởng thế nào"), (4, "thử việc")], "query_id int, text string")
    subs = Q.decompose(rows, {"a": ["luật a"], "b": ["luật b"]}, r" và lương")
    assert Counter(r.query_id for r in subs.collect()) == {1: 2, 2: 3, 3: 2, 4: 1}
    assert Q.dag_valid(subs).filter("NOT valid").count() == 0
    same = spark.createDataFrame([(1, 0, "một hai ba bốn năm", []), (1, 1, "một hai ba bốn năm", [0]), (1, 2, "khác hẳn nội dung này", [7])], "query_id int, sub_no int, sub_query string, depends_on array<int>")
    asked = spark.createDataFrame([(1, "một hai ba bốn năm sáu")], "query_id int, text string")
    assert [(r["first"], r.second) for r in Q.similar_pairs(same).collect()] == [(0, 1)]
    fixed = {r.sub_no: r.sub_query for r in Q.repair_subqueries(asked, same).collect()}
    assert fixed == {0: "một hai ba bốn năm sáu", 2: "khác hẳn nội dung này"} and not Q.dag_valid(same).first().valid
    assert value(spark, Q.expand_query(F.lit("Xin hỏi nghỉ việc"), {"nghỉ việc": ["chấm dứt hợp đồng"], "lương": ["tiền lương"]})) == "nghỉ việc chấm dứt hợp đồng"
    assert value(spark, Q.flag_ambiguous(F.lit("Trợ cấp bao nhiêu"), ["trợ cấp"], ["thôi việc"]))
    assert value(spark, Q.rewrite_query(F.lit("ad ơi nlđ nghỉ ạ"), r"^ad ơi ", r" ạ$", {"nlđ": "người lao động"})) == "người lao động nghỉ"


def test_embed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id int, text string")
    model = lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert {r.doc_id: list(r.v) for r in rows.select("doc_id", EM.embed(F.col("text"), model, 2).alias("v")).collect()} == {1: [1, 1], 2: [2, 1]}
    with pytest.raises(Exception, match="blank text"):
        rows.unionByName(rows.select("doc_id", F.lit(" ").alias("text"))).select(EM.embed(F.col("text"), model, 2)).collect()
    vectors = spark.createDataFrame([(1, [1.0], "m"), (2, [1.0, 2.0], "m")], "doc_id int, vector array<double>, model string")
    assert EM.check_compat(vectors, spark.createDataFrame([(2, "m")], "dimension int, model string")).count() == 1
    assert EM.get_by_id(vectors, [2]).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "ND_1.txt").write_text("thân văn bản\n2")
    (raw / "X.txt").write_text("không có")
    (raw / "ND_1_meta.json").write_text('{"so_hieu": "1/2020",\n "doc_id": "ND_1"}')
    assert sorted((r.id, r.text, r.so_hieu) for r in C.read_corpus(spark, str(raw)).collect()) == [("ND_1", "thân văn bản\n2", "1/2020"), ("X", "không có", None)]
    (tmp_path / "q.json").write_text('[{"question_id": "Q001", "gold_sources": [{"document_id": "d", "article_number": "Điều 1", "chunk_ids": []}, {"document_id": "d", "chunk_ids": ["c", "c"]}]}, {"question_id": "Q002", "gold_sources": []}]')
    gold = C.explode_gold(C.read_questions(spark, str(tmp_path / "q.json")))
    assert sorted(map(str, (tuple(r) for r in gold.collect()))) == sorted(map(str, [("Q001", "d", "Điều 1", None), ("Q001", "d", None, "c")]))
    pages = spark.createDataFrame([(1, "<table><tr><td> Số hiệu </td> <td>12/2020</td></tr></table><p>Loại văn bản: Nghị định</p>"), (2, None)], "page_id int, html string")
    assert [tuple(r) for r in C.extract_page_metadata(pages, {"number": "số hiệu", "kind": "loại"}).orderBy("page_id").collect()] == [(1, "12/2020", "Nghị định"), (2, None, None)]
    rows = spark.createDataFrame([(1, "s1", datetime.datetime(2024, 1, 1), "q", '["a"]'), (2, "s2", datetime.datetime(2024, 1, 2), "q", "broken")], "id int, session_id string, ts timestamp, query string, citations string")
    C.append_history(rows, str(tmp_path / "h"))
    C.append_history(rows, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    C.export_history(rows, str(tmp_path / "csv"), "csv", session="s1")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(C.CSV_COLUMNS)
    assert [r.citations for r in C.parse_history_json(rows, ["citations"]).orderBy("id").collect()] == [["a"], []]
    C.write_chunks(rows, str(tmp_path / "chunks"), ["id", "query"])
    C.write_metrics(rows.select("id"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "chunks")).count() == spark.read.option("header", True).csv(str(tmp_path / "metrics")).count() == 2
    part = lambda **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} string" for k in c))
    log = C.unify_logs(part(query="a", answer="x"), part(query="b", answer="y", rewritten_query="bb"), part(query="c", answer="z", route_taken="plain"))
    assert {(r.system, tuple(r.sub_queries or ())) for r in log.collect()} == {("plain", ()), ("corrective", ("bb",)), ("adaptive", ())}


def test_streams(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1 + h // 24, h % 24, m)
    schema = "id long, ts timestamp, route_taken string, is_refused boolean, total_latency_ms double, total_tokens long"
    one = [(1, at(1), "a", False, 10.0, 3), (2, at(2), "a", True, 20.0, 3), (2, at(2, 5), "a", True, 20.0, 3), (3, at(30), "b", False, 5.0, 1)]
    two = [(4, at(3), "a", False, 99.0, 9), (5, at(31), "b", False, 7.0, 1), (3, at(30, 10), "b", False, 5.0, 1)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(one, schema).coalesce(1).write.parquet(folder)
    seen: dict = {}

    def write(batch, number):
        for r in batch.collect():
            seen[r.start.day, r.route_taken] = (r.n, r.mean_latency_ms)

    stats = H.windowed_stats(H.deduplicated(spark.readStream.schema(schema).parquet(folder)), F.window("ts", "1 day"), late=None)
    for rows in (None, two):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        H.upsert_each_batch(stats, str(tmp_path / "state"), write).awaitTermination(120)
    assert seen == {(1, "a"): (2, 15.0), (2, "b"): (2, 6.0)}  # id 4 came too late, ids 2 and 3 once each


def test_results_do_not_depend_on_partitions(spark):
    draw = random.Random(1)
    rows = spark.createDataFrame([(draw.randrange(4), float(draw.randrange(30))) for _ in range(500)], "g int, v double")
    a, b = (sorted(map(str, E.latency_profile(r, ["g"], "v").collect())) for r in (rows, rows.repartition(13)))
    assert a == b


def test_candidate_pool_keeps_every_wanted_row(spark):
    chunks = spark.range(200).withColumnRenamed("id", "doc_id")
    pool = lambda wanted, size: sorted(r.doc_id for r in EM.candidate_pool(chunks, spark.createDataFrame([(k,) for k in wanted], "doc_id long"), size).collect())
    assert pool(range(0, 200, 4), 10) == [*range(0, 200, 4)]
    filled = pool([3, 7, 7, 999], 10)
    assert len(filled) == len(set(filled)) == 10 and {3, 7} <= set(filled)


def test_sections_end_at_whole_sources(spark):
    sizes = [(0, 1, 60), (0, 2, 80), (0, 3, 5), (1, 1, 20), (1, 2, 300), (2, 1, 200)]  # the second does not fit and ends its section
    rows = spark.createDataFrame([(1, s, f"q{s}", r, "x" * n) for s, r, n in sizes], "query_id int, sub_no int, sub_query string, rank int, content string")
    found = X.sectioned_context(rows, 120).first().context
    assert found == f"## q0\n[SOURCE 1] {'x' * 60}\n\n## q1\n[SOURCE 2] {'x' * 20}\n\n## q2"


def test_dense_topk_meets_vectors_of_its_own_length_only(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, None), (9, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    found = R.dense_topk(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 9)
    assert sorted((r.query_id, r.doc_id, r.score) for r in found.collect()) == [
        (1, 1, 1.0), (1, 2, 0.0), (1, 9, 0.0), (2, 1, 0.0), (2, 2, 1.0), (2, 9, 0.0), (3, 3, 1.0), (9, 1, 0.0), (9, 2, 0.0), (9, 9, 0.0),
    ]
    assert R.dense_topk(vectors.withColumnRenamed("doc_id", "query_id"), vectors.filter("doc_id > 99"), 9).collect() == []


def test_decompose_by_cases(spark):
    rows = spark.createDataFrame([(1, "pay before and AFTER 2020"), (2, None), (3, "plain")], "query_id int, text string")
    found = Q.decompose(rows, {}, " and ", {"before .* after": (("until: {}", ()), ("since: {}", ()), ("change of {}!", (0, 1)))}).collect()
    assert sorted((r.query_id, r.sub_no, r.sub_query, tuple(r.depends_on)) for r in found) == [
        (1, 0, "until: pay before and AFTER 2020", ()), (1, 1, "since: pay before and AFTER 2020", ()), (1, 2, "change of pay before and AFTER 2020!", (0, 1)), (2, 0, "", ()), (3, 0, "plain", ()),
    ]
    blank = spark.createDataFrame([(1, 0, "?"), (1, 1, "!")], "query_id int, sub_no int, sub_query string")
    assert [tuple(r) for r in Q.similar_pairs(blank).collect()] == [(1, 0, 1)]


def test_metrics_of_counted_gold(spark):
    asked = spark.createDataFrame([(1, False), (2, False), (3, False)], "query_id int, requires_refusal boolean")
    found = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8), (2, 12, 1, 0.5)], "query_id int, doc_id int, rank int, score double")
    listed = spark.createDataFrame([(1, 11), (1, 20), (1, 21), (2, 22)], "query_id int, doc_id int")
    sizes = spark.createDataFrame([(1, 3), (2, 1)], "query_id int, n_gold long")
    held = listed.join(found, ["query_id", "doc_id"], "left_semi")
    for f in (E.retrieval_metrics, E.retrieval_error_flags):
        assert sorted(map(str, f(asked, found, listed).collect())) == sorted(map(str, f(asked, found, held, sizes=sizes).collect()))
