"""The plan of laws: what is computed for a line, a sentence or a text is computed once."""

import dataclasses

from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import chunking as K
from docketry.operators import structure as S

LAW = "Chương I\nQUY ĐỊNH\nĐiều 1. Phạm vi\nNội dung một.\nĐiều 2.\nĐối tượng\náp dụng\n1. Một.\na) Điểm.\nPhụ lục I\nTên\n" + "một câu. " * 30


def test_headings_are_small_expressions(spark):
    """The patterns of a title and of the lines beside a heading stand in the plan a few times, not once for every way through the title's lines."""
    lines = S.to_lines(spark.createDataFrame([("L", LAW)], "doc_id string, text string"))
    rows = S.flag_appendix_start(S.join_title_lines(S.reject_references(S.flag_headings(lines))))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("RLIKE") + plan.count("lower(") < 60
    found = {r.line_no: (r.kind, r.full_title, r.title_lines) for r in rows.collect() if r.kind}
    assert found == {0: ("chapter", "QUY ĐỊNH", 1), 2: ("article", "Phạm vi", 0), 4: ("article", "Đối tượng áp dụng", 2), 9: ("appendix", None, None)}


def test_texts_are_cut_once(spark):
    """Folds in Python stand in the plan once each: one of articles, three of appendices' lines, one of their texts and one of small headers."""
    out = K.chunk_legal_documents(spark.createDataFrame([("L", LAW)], "doc_id string, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 6, plan.count("ArrowEvalPython")


def test_packing_counts_each_sentence_once():
    calls = []

    @dataclasses.dataclass(frozen=True)
    class Counted(K.ChunkConfig):
        def tokens(self, text):
            calls.append(len(text))
            return super().tokens(text)

    text = " ".join(f"w{k} a b." for k in range(3000))
    pieces = K.pack_text(text, Counted())
    assert len(pieces) > 10 and len(calls) < 2 * 3000 and sum(calls) < 4 * len(text)
    assert all(K.ChunkConfig().tokens(p) <= 800 + 50 for p in pieces)
    points, lead = [f"a) {'x ' * (k % 40)}" for k in range(500)], "đầu"
    config, slow = K.ChunkConfig(), []
    for k in range(len(points)):  # a pack at a time, from whole texts
        if slow and config.tokens("\n".join([lead, *points[slow[-1][0] : k + 1]])) <= config.target:
            slow[-1].append(k)
        else:
            slow.append([k])
    packs = [list(p) for p in K.point_packs(points, lead, config)]
    assert packs == slow or packs == [*slow[:-2], slow[-2] + slow[-1]]


def test_strip_line_is_strip(spark):
    ends = [chr(c) for c in [*range(1, 0x100), *range(0x1FF0, 0x2070), 0x1680, 0x180E, 0x3000, 0xFEFF, 0x200B]]
    texts = [t for c in ends for t in (c, f"{c}a b{c}", f" {c} x{c}{c} ", f"a {c}", f"a{c}\n", f"{c}\u0085", f"a \u0085{c}")] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(~T.strip(F.col("t")).eqNullSafe(T.strip_line(F.col("t")))).collect() == []


def test_words_in_python_are_word_total(spark):
    texts = [f"{c}a{c}b {c}" for c in map(chr, [*range(1, 0x100), 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF])] + ["", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.word_total(F.col("t")).alias("n")).collect()
    assert [(r.t, K.words_of(r.t)) for r in rows] == [(r.t, r.n) for r in rows]
