"""Appendices of laws: units of every kind, limits with carry, and small headers, against loops over lines."""

import math
import random
import re

import pytest

from docketry.operators import appendices as A
from docketry.operators import chunking as K
from docketry.operators import structure as S
from docketry.plans import corpus_queries as Q


def size(lines):
    return sum(len(x.split()) for x in lines)


def slow_blocks(lines):
    """[(number, title, [line])], a line at a time; ``lines`` are those of an appendix without empty ones."""
    found = [["Phụ lục", []]]
    for k, line in enumerate(lines):
        before = lines[k - 1] if k else ""
        cited = before and before[-1] not in ".:”\";" and before.lower().endswith(("theo", "tại", "khoản", "điều"))
        name = re.match(r"phụ\s+lục(?:\s+([IVXLCDM\d]+))?\b", line, re.I)
        catalog = line.isupper() and re.match(r"DANH\s+MỤC\b", line) and found[-1][0] == "Phụ lục"
        if k and not cited and (name or catalog):
            found.append(["Danh mục" if not name else f"Phụ lục {name[1]}" if name[1] else "Phụ lục", []])
        found[-1][1].append(line)
    out = []
    for number, block in found:
        titles = [x for x in block[1:6] if not x.startswith(("(", "TM.", "BỘ", "CỘNG HÒA", "Mẫu"))]
        out.append((number, " - ".join(titles[:2]) or None, block))
    return out


def slow_cut(lines, most):
    out = [[]]
    for line in lines:
        out[-1].append(line)
        if size(out[-1]) >= most:
            out.append([])
    return [x for x in out if x]


def slow_groups(lines, most, least):
    """Groups of people: [(head, lines)]."""
    out, head, now = [], None, []
    for line in lines:
        if re.fullmatch(r"lao\s+động\s+(nam|nữ)", line, re.I):
            if head and size(now) >= least:
                out.append((head, now))
                now = []
            head = line
            now = [*now, line]
            continue
        now = [*now, line]
        if size(now) >= most:
            out.append((head, now))
            now = []
    return [*out, (head, now)] if now else out


def slow_units(lines):
    """[(content_type, number, title, content)] of the lines of one document's appendices."""
    out = []
    for number, title, block in slow_blocks(lines):
        top = "\n".join(block[:100]).lower()
        add = lambda kind, text: out.append((kind, number, title, text))  # noqa: B023, E731
        lead, units = [], []
        if "nặng nhọc" in top or "điều kiện lao động loại" in top:
            sector, tier, entries, at, opened = ("I", "Quy định chung"), "Điều kiện lao động chung", [], 0, False

            def close(some):
                for k in range(0, len(some), 15):
                    text = "\n\n".join(f"{n}. {t}\nĐặc điểm điều kiện lao động: {' '.join(d)}" for n, t, d in some[k : k + 15])
                    units.append(f"{title or A.OCCUPATIONS_TITLE}\nLĨNH VỰC {sector[0]}: {sector[1]}\nPHÂN LOẠI: {tier}\n{'-' * 40}\n{text}")  # noqa: B023

            while at < len(block):
                line = block[at]
                s, t = re.match(r"([IVXLCDM]+)\.\s+(.+)$", line), re.match(r"Điều\s+kiện\s+lao\s+động\s+loại\s+([IVX]+)", line, re.I)
                if s and all(c.isupper() or c in " ,–-" for c in s[2]):
                    close(entries)
                    sector, tier, entries, opened = (s[1], s[2].strip()), "Điều kiện lao động chung", [], True
                elif t:
                    close(entries)
                    tier, entries, opened = f"Điều kiện lao động loại {t[1]}", [], True
                elif re.fullmatch(r"\d+", line):
                    opened = True
                    at += 1
                    entries.append((line, block[at] if at < len(block) else "", []))
                elif entries:
                    entries[-1][2].append(line)
                elif not opened:
                    lead.append(line)
                at += 1
            close(entries)
            kind = "table"
        elif "vùng i" in top and "địa bàn" in top:
            for line in block:
                if re.match(r"\d+\.\s+Vùng\s+[IVX]+", line):
                    units.append([line])
                else:
                    (units[-1] if units else lead).append(line)
            units, kind = [f"{title or A.REGIONS_TITLE}\n\n" + "\n".join(u) for u in units], "table"
        elif "tuổi nghỉ hưu" in top or "lao động nam" in top:
            units, kind = ["\n".join(x) for _, x in slow_groups(block, 1000, 10)], "table"
        elif "mẫu số" in top or any(re.match(r"mẫu(\s+số)?\s+\d", x, re.I) for x in block[:30]):
            for k, line in enumerate(block):
                if re.match(r"mẫu(\s+số)?\s+\d", line, re.I) or (k and block[k - 1] in ("Mẫu", "MẪU") and re.match(r"số\s+\d", line, re.I)):
                    units.append([line])
                else:
                    (units[-1] if units else lead).append(line)
            if not units:
                units, lead = [lead], []
            units = ["\n".join(p) for u in units for p in (slow_cut(u, 800) if size(u) > 1200 else [u])]
            kind = "form"
        else:
            units, kind = ["\n".join(x) for x in slow_cut(block, 600)], "appendix"
        if lead:
            add("appendix", "\n".join(lead))
        for text in units:
            add(kind, text)
    return out


def units_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = A.appendix_units(S.to_lines(docs)).orderBy("doc_id", "block", "unit", "part").collect()
    return [[(r.content_type, r.appendix_number, r.appendix_title, r.content) for r in rows if r.doc_id == k] for k in range(len(texts))], rows


def test_units_match_loops(spark):
    draw = random.Random(7)
    words = lambda: " ".join(draw.choices(["một", "hai", "Ba", "bốn.", "I.", "5"], k=draw.choice([1, 3, 12, 90, 400])))
    marks = ["Phụ lục I", "PHỤ LỤC", "Phụ lục 2 kèm", "DANH MỤC NGHỀ", "nghề nặng nhọc", "II. KHAI THÁC", "Điều kiện lao động loại V", "7", "8", "1. Vùng I, gồm các địa bàn:", "2. Vùng IV", "tuổi nghỉ hưu", "Lao động nam",
             "LAO ĐỘNG NỮ", "Mẫu số 3/A", "Mẫu", "số 4", "(kèm theo)", "theo quy định tại", "BỘ"]
    texts = ["\n".join(draw.choice(marks) if draw.random() < 0.45 else words() for _ in range(draw.randint(1, 60))) for _ in range(60)]
    kinds = [("Phụ lục I\nnặng nhọc", "7", "8", "II. KHAI THÁC"), ("Phụ lục II\nđịa bàn vùng I", "3. Vùng II,"), ("Phụ lục III\ntuổi nghỉ hưu", "Lao động nam", "Lao động nữ"), ("Phụ lục IV", "Mẫu số 1", "Mẫu", "số 9"), ("Phụ lục V", "x")]
    texts += ["\n".join("\n".join([k[0], *(draw.choice(k[1:]) if draw.random() < 0.4 else words() for _ in range(40))]) for k in kinds) for _ in range(20)]
    found, rows = units_of(spark, texts)
    for text, got in zip(texts, found, strict=True):
        assert got == slow_units([" ".join(x.split()) for x in text.split("\n")]), text
    assert {r.content_type for r in rows} == {"table", "form", "appendix"} and len({(r.doc_id, r.block, r.unit, r.part) for r in rows}) == len(rows)


def test_word_spans():
    assert A.word_spans([3, 3, 3], [False] * 3, 5) == [(0, 2, -1), (2, 3, -1)]
    assert A.word_spans([2, 2, 1, 2, 9], [True, False, True, True, False], 100, 10) == [(0, 5, 3)]  # groups under ten words move on
    assert A.word_spans([2, 9, 2, 1], [True, False, True, False], 100, 10) == [(0, 2, 0), (2, 4, 2)]
    assert A.word_spans([], [], 5) == []


def test_small_headers_join_up_to_a_limit(spark):
    config = K.ChunkConfig()
    assert K.header_runs([25] * 60, [True] * 60, config) == [k // 2 for k in range(60)]  # what two make is no small header
    assert K.header_runs([1, 1, 600, 1], [True, True, False, True], config) == [0, 0, 0, 1]
    assert K.header_runs([1, 620], [True, True], config) == [0, 1] and K.header_runs([], [], config) == []
    draw = random.Random(3)
    for _ in range(200):
        sizes = [draw.choice([1, 5, 20, 26, 27, 300, 600, 615]) for _ in range(draw.randint(1, 30))]
        kinds = [draw.random() < 0.8 for _ in sizes]
        parts, k = [[n, h] for n, h in zip(sizes, kinds, strict=True)], 0
        tokens = lambda n: math.ceil(n * 1.3)
        want = []
        while k < len(parts):
            n, h = parts[k]
            if h and tokens(n) < 35 and k + 1 < len(parts) and tokens(n) + tokens(parts[k + 1][0]) <= 800:
                parts[k + 1][0] += n
            else:
                want.append(n)
            k += 1
        runs = K.header_runs(sizes, kinds, config)
        assert [sum(n for n, r in zip(sizes, runs, strict=True) if r == k) for k in range(runs[-1] + 1)] == want
    law = "\n".join(["Điều 1. Tên", "Nội dung.", *[line for k in range(60) for line in (f"Phụ lục {k}", " ".join(f"T{k}x{i}" for i in range(23)))]])
    rows = K.chunk_legal_documents(spark.createDataFrame([("L", law)], "doc_id string, text string")).collect()
    assert max(config.tokens(r.content) for r in rows) <= config.most and len(rows) > 25
    assert sorted(" ".join(r.content for r in rows if r.appendix_number).split()) == sorted(" ".join(law.split("\n")[2:]).split())


def test_laws_of_the_given_texts(spark):
    """The query over whole tables: chunks of appendices are those of loops over the lines, in order, after cutting and joining."""
    d = "/root/testdata/sf0.001"
    laws = {r.doc_id: r.text for r in Q.laws(spark, d).collect()}
    rows = Q.k10_legal(spark, d).collect()
    config, of = K.ChunkConfig(), {}
    for r in sorted(rows, key=lambda r: (r.document_id, r.chunk_index)):
        of.setdefault(r.document_id, []).append(r)
    assert set(of) == set(laws) and {"article", "clause", "point", "table", "form", "appendix"} <= {r.content_type for r in rows}
    assert {r.appendix_title.split(" - ")[0] for r in rows if r.appendix_title} == set(Q.TITLES)
    hashed = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
    seen = 0
    for doc, text in laws.items():
        assert [r.chunk_index for r in of[doc]] == list(range(len(of[doc]))) and len({r.chunk_id for r in of[doc]}) == len(of[doc])
        lines = [re.sub(r"^\s+|\s+$", "", x) for x in text.split("\n")]
        if "Phụ lục I" not in lines:
            continue
        pieces = []
        for kind, number, title, content in slow_units(lines[lines.index("Phụ lục I") :]):
            for piece in K.pack_text(content, config, f"{number} {title}" if title else number):
                pieces += [(kind, part) for part in K.pack_text(piece, config)]
        joined, held = [], None
        for kind, part in pieces:
            if held and config.tokens(held) < 35 and config.tokens(held) + config.tokens(part) <= 800:
                joined.pop()
                part = held + "\n\n" + part
            joined.append((kind, hashed(part)))
            held = part
        assert [(r.content_type, r.digest) for r in of[doc] if r.appendix_number] == joined, doc
        seen += len(joined)
    assert seen > 300


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_no_lines_no_units(spark, text):
    assert A.appendix_units(S.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).isEmpty()
    assert K.chunk_legal_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).isEmpty()
