"""Prefix trie, benchmark decontamination and spelling variants against brute force, with nulls, empty tables, repeats, ties, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import decontamination, prefix_trie, spelling


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- prefix trie


def rebuilt(rows):
    """{conv_id: [(role, text)]} by the contract of the query; ties in turn by digest, as the operator has it."""
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def slow_trie(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = Counter()
    children = Counter(p[:-1] for p in nodes if p)
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(nodes[p[:-1]]) if p else None
        out[(min(members), len(p), parent, len(members), children[p], sum(not children[q] for q in under), sum((len(nodes[q]) - 1) * words(q) for q in under), sha)] += 1
    return out


def trie(spark, rows, **sizes):
    turns = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, digest string, place int")
    return rows_of(prefix_trie.prefix_trie(prefix_trie.regrown(prefix_trie.numbered(prefix_trie.digested(turns))), **sizes))


@pytest.mark.parametrize("block, step", [(4, 1024), (2, 2), (1, 1)])
def test_trie_matches_brute_force(spark, block, step):
    draw = random.Random(block)
    texts = ["a b", "c", "", None, "d  e\tf", "ü x"]
    rows = []
    for c in range(90):
        base = [(draw.choice(["u", None]), draw.choice(texts)) for _ in range(draw.choice([1, 2, 3, 9]))]
        if c % 3:  # copies of another conversation, some longer or shorter
            other = [r for r in rows if r[0] == draw.choice([0, 20, 40, c - c % 20])]
            base = [(r[2], r[3]) for r in other[: draw.randint(1, 9)]] or base
        rows += [(c, k if draw.random() < 0.95 else None, *t) for k, t in enumerate(base)]
    rows = [r for r in rows if r[0] not in (60, 61)]  # 62 to 79 have no base
    rows += [(5, 0, "u", "a b"), (5, 0, "u", "a b"), (7, 1, "u", "same"), (7, 1, "u", "turn"), (None, 0, "u", "x"), (-3, 0, "u", "neg"), (10**12 + 1, 0, "u", "far")]
    rows += [(81, k, "u", f"long {k % 7}") for k in range(60)] + [(82, k, "u", f"long {k % 7}") for k in range(61)] + [(83, 0, "u", "w " * 50_000)]
    want = slow_trie(rebuilt(rows))
    assert any(r[1] == 0 and r[3] > 80 for r in want) and trie(spark, rows, block=block, step=step) == want


def test_trie_of_few(spark):
    assert trie(spark, []) == Counter() and trie(spark, [(None, 0, "u", "x")]) == Counter()
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)  # loses its first three turns, and there is no conversation 0
    want = slow_trie(rebuilt([(c, 0, "u", "x")]))
    assert trie(spark, [(c, 0, "u", "x")]) == want and next(iter(want))[1:6] == (0, None, 1, 0, 1)


# --- decontamination


def slow_leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for name, text in items:
        ws = words(text)
        m = min(window, len(ws))
        for k in range(len(ws) - m + 1 if ws else 0):
            wins[tuple(ws[k : k + m])].add("" if name is None else str(name))
    sizes = {len(w) for w in wins}
    out = Counter()
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for m in sizes:
            for k in range(len(ws) - m + 1):
                if tuple(ws[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found |= wins[tuple(ws[k : k + m])]
        out[(doc_id, len(ws), len(hit), len(found), ",".join(sorted(found)), bool(hit))] += 1
    return out


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, words string")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, window int")
    got = decontamination.contamination(d, i, **options)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.items), r.contaminated) for r in got.collect())


def test_leaks_match_brute_force(spark):
    draw = random.Random(12)
    word = lambda: draw.choice(["a", "b", "C", "d", "été", "ÉTÉ", "7", "e"])
    items = [(k if k % 9 else None, draw.choice([" ", "-", "\x00"]).join(word() for _ in range(draw.choice([0, 1, 3, 4, 9, 10, 11, 30])))) for k in range(60)]
    items += [(5, "q w e r t z u i o p a s"), (6, "q w e r t z u i o p a s"), (70, None), (71, "  ,. "), (72, "zz zz zz zz zz zz zz zz zz zz zz"), (73, "solo"), (5, "two rows of one item")]
    docs = [(k, ", ".join(word() for _ in range(draw.randint(0, 80)))) for k in range(60)]
    docs += [(100 + k, f"x {items[draw.randrange(60)][1].upper() if k % 2 else items[draw.randrange(60)][1]} y") for k in range(40)]
    docs += [(None, "Q W e r T z u i o P A s"), (1, None), (2, ""), (3, "zz " * 40), (3, "zz " * 40), (4, "SOLO"), (8, "word " * 30_000 + "q w e r t z u i o p a s " + "word " * 30_000), (9, "two rows of one item")]
    assert leaks(spark, docs, items) == slow_leaks(docs, items)
    assert leaks(spark, docs, items, window=4, width=2) == slow_leaks(docs, items, 4)


def test_leaks_of_few(spark):
    assert leaks(spark, [], [(1, "a")]) == Counter()
    assert leaks(spark, [(1, "a b")], []) == leaks(spark, [(1, "a b")], [(1, None), (2, "!")]) == Counter({(1, 2, 0, 0, "", False): 1})


def test_leaks_shuffled(spark, monkeypatch):
    """Beyond the size of a broadcast the same rows come by shuffles."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs = [(k, f"a b c d e f g h {k % 3}") for k in range(30)]
    assert leaks(spark, docs, [(1, "b c d"), (2, "g h 1"), (3, "h 9")]) == slow_leaks(docs, [(1, "b c d"), (2, "g h 1"), (3, "h 9")])


# --- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(words, least=7, times=10):
    words = {w: n for w, n in words if w is not None and len(w) >= least}
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = Counter()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None)] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 6), st.lists(st.text("abÿ", min_size=2, max_size=7), max_size=30))
def test_scan_of_a_list(short, words):
    words = sorted({w.encode("latin-1") for w in words if len(w) in (short, short + 1)})
    n = len(words)
    for low, high in ((0, short + 1),):
        found = spelling.SortedLists(words, np.zeros(n, int), np.full(n, low), np.full(n, high), short)
        got = sorted((int(x), int(y)) for a, b in found.pairs() for x, y in zip(a, b, strict=True))
        assert got == sorted((x, y) for x in range(n) for y in range(n) if len(words[x]) == short and near(words[x], words[y]) and (len(words[y]) > short or y > x))


def test_scan_skips_ranges():
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abcdefghij", k=7)).encode() for _ in range(4000)})
    n = len(words)
    found = spelling.SortedLists(words, np.zeros(n, int), np.zeros(n, int), np.full(n, 8), 7)
    list(found.pairs())
    assert found.visited < n * n * 7 / 40 and found.skipped > found.visited / 2  # most prefixes are two edits away


@pytest.mark.parametrize("most", [20_000, 6])
def test_variants_match_brute_force(spark, most):
    draw = random.Random(most)
    words = {}
    for _ in range(60):
        w = "".join(draw.choices("abcdé", k=draw.choice([6, 7, 8, 9, 15])))
        words[w] = draw.choice([2, 30, 500, 9000])
        for _ in range(draw.choice([0, 3, 8])):  # edits of edits
            at, c = draw.randrange(len(w) + 1), draw.choice("abÿ")
            w = draw.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words[w] = draw.choice([2, 3, 40, 40])
    words |= {"x" * 3000: 50, "x" * 3001: 2, "aaaaaaa": 40, "aaaaaaaa": 4, "baaaaaa": 40}
    rows = [*words.items(), (None, 5), ("", 5)]
    df = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, form string")
    want = slow_variants(rows)
    assert any(r[1] and r[1] != r[2] for r in want) and rows_of(spelling.spelling_variants(df, most=most)) == want


def test_counts_of_words(spark):
    docs = [(k, "Spelling speLLing  élément-Éléments x abcdefgh" + "!" * k) for k in range(200)] + [(None, "spelling"), (3, None), (4, ""), (3, "Spelling"), (3, "Spelling"), (9, "q" * 70_000), (10, "q" * 70_000)]
    want = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.word_counts(df, damage=31).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and len(got) > 5
    assert spelling.spelling_variants(spelling.word_counts(df.limit(0))).isEmpty()
