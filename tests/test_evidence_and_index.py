"""Stored index, evidence from texts, second searches, expansion by a table and exact quantiles, against loops and rebuilds."""

import datetime
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docketry.operators import evaluation as E
from docketry.operators import evidence as EV
from docketry.operators import quantiles as N
from docketry.operators import questions as Q
from docketry.operators import retrieval as R
from docketry.operators.lexical import LexicalIndex, phrase_hits
from docketry.sources.scratch import clear, new_folder, written


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_index_after_changes_equals_a_rebuild(spark):
    draw = random.Random(2)
    text = lambda: " ".join(draw.choices(["cat", "dog", "và", "của", "a", "Lao", "động", "x1", "!"], k=draw.randint(0, 30)))
    first = [(k, text()) for k in range(60)] + [(98, None), (99, "")]
    more = [(k, text()) for k in range(40, 90)] + [(99, "cat cat")]
    index = LexicalIndex.create(texts(spark, first), buckets=4)
    index.add(texts(spark, more))
    index.remove(spark.createDataFrame([(3,), (45,), (1234,)], "doc_id long"))
    index.add(texts(spark, [(3, "dog cat")]))
    now = {**dict(first), **dict(more)}
    del now[45]
    now[3] = "dog cat"
    whole = LexicalIndex.create(texts(spark, list(now.items())), buckets=4)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(index.postings()) == rows(whole.postings()) and rows(index.lengths()) == rows(whole.lengths()) and index.lengths().count() == len(now)
    asked = spark.createDataFrame([(1, "cat lao động"), (2, "dog và cat"), (3, "nothing"), (4, None)], "query_id long, text string")
    want = rows(R.bm25_topk(asked, texts(spark, list(now.items())), 5))
    assert rows(R.bm25_topk(asked, index, 5)) == want and len(want) == 10
    plain = LexicalIndex.create(texts(spark, list(now.items())), positional=False)
    assert rows(R.bm25_topk(asked, plain, 5)) == want
    with pytest.raises(ValueError):
        phrase_hits(asked.select("query_id", F.col("text").alias("phrase")), plain)
    words = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
    phrases = [(1, "cat dog"), (2, "lao động cat"), (3, "và của"), (4, "x1 x1 x1"), (5, "cat"), (6, "của cat"), (6, None)]
    hits = phrase_hits(spark.createDataFrame(phrases, "query_id long, phrase string"), index)
    slow = Counter()
    for q, p in phrases:
        ws = words(p)
        for d, t in now.items():
            ts = words(t)
            n = sum(ts[k : k + len(ws)] == ws for k in range(len(ts) - len(ws) + 1))
            if n and len(ws) > 1 and q != 3:  # both words of the third are stop words
                slow[(q, p, d, n)] += 1
    assert Counter(map(tuple, hits.collect())) == slow and len(slow) > 10


def test_a_search_of_a_stored_index_reads_no_text(spark):
    folder = new_folder(spark, "texts")
    texts(spark, [(1, "cat dog"), (2, "dog")]).write.parquet(folder)
    index = LexicalIndex.create(spark.read.parquet(folder))
    scans = [line for df in (index.postings(texts(spark, [(1, "dog")]).select(F.col("text").alias("term"))), index.lengths()) for line in df._jdf.queryExecution().toString().split("\n") if "Location" in line or "FileScan" in line]
    assert scans and not any(folder.rsplit("/", 1)[1] in line for line in scans)


def test_folder_is_cleared(spark):
    rows = written(spark.range(3), "some")
    assert rows.count() == 3
    clear(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(rows.inputFiles()[0]).count()


def chunks(spark, rows):
    return spark.createDataFrame([(*r[:3], k, *r[3:]) for k, r in enumerate(rows, 1)], "query_id long, doc_id string, score double, rank int, query string, content string")


def test_evidence_from_texts(spark):
    ask = "Tích lũy nghỉ phép năm tối đa"
    questions = [(1, ask), (2, "nghỉ phép và thử việc"), (3, " "), (4, "không có gì"), (5, "thời tiết hôm nay"), (6, "luật công đoàn phần trăm"), (7, "nghỉ phép")]
    rows = [
        (1, "a", 0.9, ask, "tích lũy ngày nghỉ phép tối đa"), (1, "b", 0.9, ask, "nghỉ phép tối đa"), (2, "c", 0.8, questions[1][1], "thử việc và nghỉ phép"), (2, "d", 0.3, questions[1][1], "thử việc nghỉ phép"),
        (3, "e", 0.9, " ", "x"), (5, "f", 0.9, questions[4][1], "thời tiết hôm nay"), (6, "g", 0.9, questions[5][1], "kinh phí 2 % theo luật công đoàn"), (7, "h", 0.9, "nghỉ phép", None), (7, "i", 0.9, "nghỉ phép", "nghỉ phép hằng năm"),
    ]
    rules = {"conditions": {"tích lũy": [["tích lũy"]], "thử việc": [["thử việc"]]}, "strict": ["tích lũy"], "out_of_scope": ["thời tiết"], "external": ["luật công đoàn", "luật việc làm"]}
    graded, verdict = EV.grade_evidence(spark.createDataFrame(questions, "query_id long, text string"), chunks(spark, rows), **rules)
    assert {r.doc_id: r.relevant for r in graded.collect()} == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": False, "g": True, "h": False, "i": True}
    found = {r.query_id: (r.n_relevant, r.status, r.confidence) for r in verdict.collect()}
    assert found[1] == (1, "SUFFICIENT", 0.95) and found[2][:2] == (1, "PARTIAL") and found[3] == (0, "INSUFFICIENT", 1.0) and found[4] == (0, "INSUFFICIENT", 1.0)
    assert found[5] == (0, "INSUFFICIENT", 0.95) and found[6][1] == "SUFFICIENT" and found[7][1] == "SUFFICIENT"


def test_periods_of_validity(spark):
    day = datetime.date
    registry = spark.createDataFrame([("a", day(2020, 1, 1), day(2021, 1, 1), "ACTIVE"), ("a", day(2021, 1, 1), None, "REPEALED"), ("b", day(2030, 1, 1), None, "ACTIVE"), ("c", None, day(2019, 1, 1), None), ("d", day(2019, 1, 1), None, "FUTURE_ACTIVE")],
                                     "doc_id string, effective_from date, effective_to date, legal_status string")
    rows = [(1, "a", day(2020, 6, 1)), (2, "a", day(2021, 1, 1)), (3, "a", day(2019, 6, 1)), (1, "b", day(2020, 6, 1)), (1, "c", day(2020, 6, 1)), (1, "d", day(2020, 6, 1)), (1, "z", day(2020, 6, 1)), (4, "a", None)]
    asked = spark.createDataFrame([(*r, "x") for r in rows], "query_id long, doc_id string, as_of date, legal_status string")
    got = {(r.query_id, r.doc_id): r.in_force for r in EV.in_force(asked, registry).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 0.0, (3, "a"): 0.8, (1, "b"): 0.8, (1, "c"): 0.0, (1, "d"): 0.8, (1, "z"): 1.0, (4, "a"): 0.0}


def test_evidence_scores_and_verdicts(spark):
    registry = spark.createDataFrame([("old", None, None, "REPEALED")], "doc_id string, effective_from date, effective_to date, legal_status string")
    issues, subjects = {"pay": ["lương"], "leave": ["nghỉ phép"]}, {"all": ["công ty"], "women": ["thai sản"]}
    rows = [
        (1, "x", 0.6, "lương thai sản", "lương, nếu thai sản 6 tháng"), (1, "old", 0.9, "lương thai sản", "lương thai sản"), (2, "y", 0.9, "nghỉ phép", "lương tháng"), (3, "z", 0.5, "nghỉ phép", "lương"),
        (4, "v", 0.9, "lương ở công ty", "lương"), (4, "w", 0.2, "lương ở công ty", "lương 5 ngày trong trường hợp này"),
    ]
    scored = EV.score_evidence(chunks(spark, rows).withColumn("as_of", F.lit("2024-01-01").cast("date")), registry, issues, subjects, "all")
    got = {r.doc_id: (r.subject, r.issue, r.condition, r.in_force, r.mismatch, r.chunk_score) for r in scored.collect()}
    assert got["x"] == (1.0, 1.0, 1.0, 1.0, False, 0.9) and got["old"][3:] == (0.0, False, 0.0) and got["y"][1:] == (0.0, 0.2, 1.0, True, 0.515) and got["v"][2] == 0.2 and got["w"][2] == 1.0
    questions = spark.createDataFrame([(k,) for k in range(1, 6)], "query_id long")
    found = {r.query_id: (r.n, r.best, r.bonus, r.composite, r.refused, r.reason) for r in EV.evidence_report(questions, scored).collect()}
    assert found[1] == (2, 0.9, 0.0, 0.9, False, None) and found[2] == (1, 0.515, 0.0, 0.515, False, None) and found[3][3:] == (0.0, True, "issue_mismatch")
    assert found[4] == (2, 0.815, 0.15, 0.965, False, None) and found[5] == (0, 0.0, 0.0, 0.0, True, "no_candidates")


def test_second_searches(spark):
    """Only questions without enough evidence are asked again; what is kept follows both verdicts."""
    contents = {"good": "alpha beta gamma", "half": "alpha", "gone": "delta", "both": "alpha beta delta"}
    docs = spark.createDataFrame(list(contents.items()), "doc_id string, content string")
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "nothing here"), (3, "alpha và zeta eta"), (4, "delta! beta")], "query_id long, text string")
    hits = {"alpha beta": ["good", "both"], "nothing here": ["gone"], "alpha và zeta eta": ["half", "good"], "nothing": ["half"], "alpha beta gamma": ["good", "both"], "delta! beta": ["half"], "delta beta": ["both"]}
    again = {"nothing here": "nothing", "alpha và zeta eta": "alpha beta gamma", "delta! beta": "delta beta"}
    searched = []

    def search(asked):
        rows = [(r.query_id, d, 0.9, k) for r in asked.collect() for k, d in enumerate(hits[r.text], 1)]
        searched.append(sorted({r[0] for r in rows}))
        return spark.createDataFrame(rows, "query_id long, doc_id string, score double, rank int")

    rewrite = lambda t: F.element_at(F.create_map(*[F.lit(x) for p in again.items() for x in p]), t)
    kept, records = EV.corrective_retrieve(questions, search, docs, rewrite)
    assert searched == [[1, 2, 3, 4], [2, 3, 4]]
    got = defaultdict(list)
    for r in kept.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert dict(got) == {1: ["good", "both"], 3: ["good", "both"], 4: ["both"]}
    found = {r.query_id: (r.first, r.second, r.retries, r.n_kept, r.refused) for r in records.collect()}
    assert found == {1: ("SUFFICIENT", None, 0, 2, False), 2: ("INSUFFICIENT", "INSUFFICIENT", 1, 0, True), 3: ("PARTIAL", "SUFFICIENT", 1, 2, False), 4: ("INSUFFICIENT", "SUFFICIENT", 1, 1, False)}


def test_expansion_by_a_table(spark):
    entries = [(k, f"key{k} word", [f"term{k}", "Lao động x"]) for k in range(2000)] + [(5000, "nghỉ  Việc", ["chấm dứt hợp đồng", "thôi việc"]), (6000, "", ["never"]), (6001, "việc", ["Term7"])]
    dictionary = spark.createDataFrame(entries, "entry long, key string, terms array<string>")
    questions = spark.createDataFrame([(1, "Xin hỏi, tôi nghỉ việc theo Điều 35?"), (2, "key7 word KEY8 Word key9 wordy"), (3, None), (4, "  ")], "query_id long, text string")
    out = Q.expand_questions(questions, dictionary, {"BLLD": ["điều 35"]})
    got = {r.query_id: r for r in out.collect()}
    assert got[1].search == "Điều 35 BLLD chấm dứt hợp đồng thôi việc Term7 nghỉ việc theo Điều 35 Bộ luật Lao động"
    assert got[1].rewritten == "tôi nghỉ việc theo Điều 35? (chấm dứt hợp đồng, thôi việc, Term7)" and got[1].terms == ["chấm dứt hợp đồng", "thôi việc", "Term7"]
    assert got[2].terms == ["term7", "Lao động x", "term8", "Lao động x"] and got[2].search == "term7 Lao động x term8 key7 word KEY8 key9"
    assert (got[3].search, got[4].search) == (None, "  ")
    tree = out._jdf.queryExecution().analyzed().toString()
    assert "term1999" not in tree  # the dictionary is no part of the plan


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_quantiles(spark, small_ranges):
    draw = random.Random(9)
    rows = [("hot", draw.random()) for _ in range(5000)] + [("few", float(draw.randrange(3))) for _ in range(50)] + [(None, 1.5), ("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: (r.low, r.mid, r.p95, r.top) for r in N.index_quantiles(df.repartition(7), ["g"], "v", shares).collect()}
    values = defaultdict(list)
    for g, v in rows:
        if v is not None:
            values[g].append(v)
    want = {g: tuple(sorted(vs)[min(int(q * len(vs)), len(vs) - 1)] for q in shares.values()) for g, vs in values.items()}
    assert got == want
    whole = N.index_quantiles(df, [], "v", {"mid": 0.5}).collect()
    every = sorted(v for _, v in rows if v is not None)
    assert [r.mid for r in whole] == [every[len(every) // 2]]
    ranges = N.counted_ranges(df, ["g"], "v")
    assert ranges.filter("g = 'hot'").select("part").distinct().count() > 1  # a hot group is in several ranges
    prof = {r.g: r for r in E.latency_profile(df, ["g"], "v").collect()}
    s = sorted(values["hot"])
    assert prof["hot"].median == (s[2499] + s[2500]) / 2 and prof["hot"].n == 5000 and prof["one"].p95 == 2.0 and prof["hot"].share == 5000 / 5052
    assert N.index_quantiles(df.limit(0), ["g"], "v", {"mid": 0.5}).isEmpty()


def test_word_bounds_are_those_of_the_sql(spark):
    import duckdb

    from docketry.functions.text import ascii_bounds

    texts_ = ["ñde x", "deñ", "la de la", "ade", "de", "lade b", "ungenß", "ungen", "ungen.", "\\be", ""]
    for pattern in (r"\b(?:of|und|de)\b", r"ungen\b", r"\bungen", r"\\be"):
        rows = spark.createDataFrame([(t,) for t in texts_], "t string").select("t", F.col("t").rlike(ascii_bounds(pattern)).alias("got"))
        assert {r.t: r.got for r in rows.collect()} == {t: duckdb.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in texts_}


def test_lexical_search_by_shards_equals_all_scores(spark, monkeypatch):
    """Shards and blocks, frequent and rare terms, equal texts and questions give what sorting all scores gives."""
    draw = random.Random(5)
    word = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(draw.choices(word, weights=[60 / (k + 1) for k in range(60)], k=n))
    rows = [(k, text(draw.randint(0, 40))) for k in range(300)] + [(1000 + k, "w1 w2 w59") for k in range(40)] + [(2000, None), (2001, "")]
    asked = [(k, text(draw.randint(0, 12))) for k in range(30)] + [(50 + k, "w59 w2") for k in range(9)] + [(90, None), (91, "nothing")]
    docs, questions = texts(spark, rows), spark.createDataFrame(asked, "query_id long, text string")
    monkeypatch.setattr(R, "SHARD_DOCS", 32)
    monkeypatch.setattr(R, "BLOCK_QUESTIONS", 7)
    want = R.bm25_topk(questions, docs, 5, keep=F.lit(True)).collect()
    assert sorted(R.bm25_topk(questions, docs, 5).collect()) == sorted(want) and len(want) > 150
    assert sorted(R.bm25_topk(questions, LexicalIndex.create(docs), 5).collect()) == sorted(want)
    assert R.bm25_topk(questions, texts(spark, []), 5).count() == 0


def test_lexical_search_writes_no_pairs(spark):
    """What a search writes for 40 equal questions over 400 documents is far fewer rows than the 16,000 pairs, and questions of the same terms are looked for once."""
    docs = texts(spark, [(k, f"cat dog x{k}") for k in range(400)])
    asked = spark.createDataFrame([(k, "cat dog") for k in range(40)], "query_id long, text string")
    clear(spark)
    assert R.bm25_topk(asked, docs, 3).count() == 120
    base = spark.conf.get("spark.checkpoint.dir") + f"/docketry-{spark.sparkContext.applicationId}"
    import glob

    assert sum(spark.read.parquet(f).count() for f in glob.glob(base + "/bm25-found-*")) <= 12


def test_lsh_hashes_all_rows_and_shuffles_no_pairs(spark, monkeypatch):
    """Random projections find what brute force finds, by shards and blocks; narrow buckets find less; the plan joins no pairs."""
    import numpy as np

    draw = np.random.default_rng(1)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(draw.normal(size=(400, 16)))] + [(900, None), (901, [None] * 16), (902, [0.0] * 16), (903, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    queries = vectors.filter("doc_id % 25 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(R, "SHARD_ROWS", 100)
    monkeypatch.setattr(R, "BLOCK_ROWS", 6)
    pairs = lambda df: {(r.query_id, r.doc_id) for r in df.collect()}
    near = R.dense_topk_lsh(queries, vectors, 5)
    exact, found = pairs(R.dense_topk(queries, vectors, 5)), pairs(near)
    assert len(exact & found) >= 0.9 * len(exact) and len(pairs(R.dense_topk_lsh(queries, vectors, 5, bucket=0.02, tables=1))) < len(exact)
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()


def test_counts_of_terms_are_those_of_the_postings(spark, monkeypatch):
    """Whatever a task holds at a time; repeated ids, null ids and texts, and stop words too. Rows of postings are not shuffled."""
    monkeypatch.setattr(R, "COUNTED_TERMS", 5)
    rows = [(1, "cat dog a của và cat"), (2, "dog cat, DOG"), (2, "cat dog dog"), (2, "cat"), (None, "cat x1"), (None, "cat x1"), (4, None), (5, " "), (6, "của và"), (7, "a")] + [(k, f"w{k % 7} dog") for k in range(10, 60)]
    docs = texts(spark, rows)
    want = R.bm25_postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    got = R.bm25_term_counts(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString()


def test_phrases_of_a_table_equal_those_of_an_index(spark):
    draw = random.Random(8)
    rows = [(k, " ".join(draw.choices(["cat", "dog", "và", "của", "x1"], k=draw.randint(0, 25)))) for k in range(80)] + [(90, None), (91, "")]
    docs = texts(spark, rows)
    asked = spark.createDataFrame([(1, "cat dog"), (2, "Cat  dog"), (3, "cat dog"), (4, "dog và cat"), (5, "và của"), (6, "x1 x1 x1"), (7, "cat"), (8, None)], "query_id long, phrase string")
    got = phrase_hits(asked, docs).collect()
    assert sorted(got) == sorted(phrase_hits(asked, LexicalIndex.create(docs)).collect()) and {r.query_id for r in got} == {1, 2, 3, 4, 6}
    assert len({tuple(sorted((r.doc_id, r.n) for r in got if r.query_id == q)) for q in (1, 2, 3)}) == 1
