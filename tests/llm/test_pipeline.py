import random

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    draw = random.Random(1)
    words = [f"word{k}" for k in range(400)]
    text = lambda: " ".join(draw.choices(words, k=120)).capitalize() + "."
    rows = [(i, text(), "en", draw.choice(["a", "a", "b", None]), 1) for i in range(160)]
    rows += [(i, "| ".join(draw.choices(words, k=80)) + " ###" * 40, "en", "a", 1) for i in range(160, 260)]
    rows += [(1000 + i, rows[5][1], "en", "a", 1) for i in range(30)]
    rows += [(2000, rows[7][1] + " token = 0123456789abcdef0123456789abcdef", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(i, int(i < 160), 0) for i in range(260)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == COLUMNS, name
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    assert set(range(160)) <= set(ids[1]) and not set(range(160, 260)) & set(ids[1])
    assert set(ids[2]) >= set(range(160)) and not set(ids[2]) & set(range(1000, 1030)) and len(ids[2]) == len(set(ids[2]))
    assert ids[3] == ids[2]
    hidden = seen[3].filter("doc_id = 2000").collect()
    assert all("0123456789abcdef" not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text) for r in hidden)
    assert set(ids[4]) <= set(ids[3]) and max(map(ids[4].count, ids[4])) <= 3
    assert seen[5].filter("piece = 0").count() == len(ids[4])


def test_run_has_no_sql():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_copies_stage_drops_edited_texts(spark, tmp_path):
    draw = random.Random(4)
    words = [f"word{k}" for k in range(400)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(30, 300))), "en", "a", 1) for i in range(150)]
    for i in range(150):  # some words replaced: similarities on both sides of 0.8
        copy = rows[i][1].split()
        for at in draw.sample(range(len(copy)), max(1, len(copy) * draw.randint(1, 5) // 100)):
            copy[at] = "other"
        rows.append((1000 + i, " ".join(copy), "en", "a", 1))
    base = rows[0][1].split()  # a large class, each text with another last word
    rows += [(2000 + k, " ".join([*base, f"end{k}"]), "en", "a", 1) for k in range(300)]
    rows += [(5000, None, "en", "a", 1), (5001, " ", "en", "a", 1), (5002, "one two", "en", "a", 1), (None, "ONE  two", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    alike = lambda i: 5 * len(shingles(rows[i][1]) & shingles(rows[150 + i][1])) >= 4 * len(shingles(rows[i][1]) | shingles(rows[150 + i][1]))
    copies = {1000 + i for i in range(150) if alike(i)}
    assert 30 < len(copies) < 120 and len(kept & copies) <= 0.15 * len(copies)  # fingerprints of the others differ in over eight bits
    assert {*range(150), *(set(range(1000, 1150)) - copies), 5000, 5002} <= kept
    assert not kept & {*range(2000, 2300), 5001, None}


def test_components_and_joined_classes_against_union_find(spark):
    from docketry.llm.simhash import joined, star_components

    def roots(pairs):
        up = {}
        find = lambda k: k if up.setdefault(k, k) == k else find(up[k])
        for u, v in pairs:
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
        return {k: find(k) for k in up if find(k) != k}

    draw = random.Random(6)
    first = [(draw.randrange(-300, 300), draw.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)]
    later = [(draw.randrange(-400, 400), draw.randrange(-400, 400)) for _ in range(80)] + [(1059, -400), (5, 5), (7, 8), (8, 7)]
    frame = lambda pairs: spark.createDataFrame(pairs, "u long, v long")
    labels = star_components(frame(first))
    assert sorted(map(tuple, labels.collect())) == sorted(roots(first).items())
    assert sorted(map(tuple, joined(labels, frame(later)).collect())) == sorted(roots(first + later).items())
    assert star_components(frame([])).count() == 0
