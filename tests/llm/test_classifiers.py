import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import quality, toxicity
from docketry.llm.hashing import word_features
from docketry.llm.shared import is_held_out

WORDS = "the river flows past quiet houses where people gather every evening after work and talk about weather music books".split()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, id string, label double")


def labels(spark, rows, name):
    return spark.createDataFrame([(i, y, "clash") for i, y in rows], f"doc_id long, {name} int, text string")


def sentence(draw, n=40):
    return " ".join(draw.choices(WORDS, k=n)).capitalize() + "."


def test_gradient():
    draw = np.random.default_rng(0)
    bags, y = [draw.normal(size=(k, quality.FEATURES)) for k in (1, 3, 5)], np.array([0.0, 1, 1])
    model = quality.fit(bags, y, steps=3)
    x, firsts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        s = model.forward(x, firsts)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in model.gradient(x, firsts, y).items():
        kept, step = model.weights[k], np.zeros_like(model.weights[k])
        step.ravel()[0] = 1e-5
        model.weights[k] = kept + step
        up = loss()
        model.weights[k] = kept - step
        assert (up - loss()) / 2e-5 == pytest.approx(g.ravel()[0], rel=1e-3, abs=1e-7)
        model.weights[k] = kept


def test_every_passage_counts():
    texts = [b"", b"one", b"w " * 200, "é ß".encode() * 50, b"\n\n"]
    owner, x = quality.passages(texts)
    assert owner.tolist() == [0, 1, 2, 2, 2, 2, 3, 4] and x.shape == (8, quality.FEATURES) and np.isfinite(x).all()
    for k, text in enumerate(texts):  # a text's passages do not depend on its neighbours
        assert np.allclose(quality.passages([text])[1], x[owner == k])


def test_quality(spark):
    draw = random.Random(1)
    good = [(i, " ".join(sentence(draw) for _ in range(draw.randint(1, 12)))) for i in range(300)]
    junk = [(i, " | ".join(draw.choices(WORDS, k=60)) if i % 2 else "BUY!! " * draw.randint(20, 300)) for i in range(300, 500)]
    rows = good + junk + [(900, None), (901, ""), (None, "x"), (3, good[3][1]), (902, sentence(draw, 60_000))]
    table = labels(spark, [(i, int(i < 300)) for i in range(500)] + [(None, 1), (7, None)], "quality")
    out = quality.with_quality(documents(spark, rows), table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.doc_id is not None and r.doc_id < 500 and is_held_out(r.doc_id)]
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 300) for r in known]) > 0.97
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    none = quality.with_quality(documents(spark, rows), table.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.with_quality(documents(spark, rows).limit(0), table).count() == 0


def test_attention_finds_the_passage():
    draw = random.Random(2)
    texts, y = [], []
    for k in range(400):
        parts = [" ".join(draw.choices(WORDS, k=64)) for _ in range(6)]
        if k % 2:
            parts[draw.randrange(6)] = "#### " * 64
        texts.append(" ".join(parts).encode())
        y.append(k % 2)
    bags = [quality.passages([t])[1] for t in texts]
    model = quality.fit(bags[:300], np.array(y[:300], float))
    scores = model.scores(texts[300:])
    assert np.mean((scores >= 0.5) == np.array(y[300:])) == 1
    owner, x = quality.passages([texts[301]])
    assert np.argmax(model.attention(x, owner)) == np.argmax(x[:, 5])


def test_held_out_labels_are_not_read(spark):
    draw = random.Random(3)
    rows = [(i, sentence(draw)) for i in range(200)]
    a = [(i, i % 2) for i in range(200)]
    b = [(i, 1 - y if is_held_out(i) else y) for i, y in a]
    for module, name, with_ in ((quality, "quality", quality.with_quality), (toxicity, "toxic", toxicity.with_toxicity)):
        one, two = ({r.doc_id: r.score for r in with_(documents(spark, rows), labels(spark, t, name)).collect()} for t in (a, b))
        assert one == two, module.__name__


def test_toxicity(spark):
    draw = random.Random(4)
    rows, y = [], {}
    for i in range(600):
        text = " ".join(sentence(draw) for _ in range(draw.randint(1, 8)))
        y[i] = i % 3 == 0
        if y[i]:
            words = text.split()
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(["grumbleworm", "Snotface", "dunderhead"]))
            text = " ".join(words)
        rows.append((i, text))
    rows += [(900, None), (901, ""), (None, "x"), (5, rows[5][1]), (902, sentence(draw, 60_000))]
    table = labels(spark, [(i, int(v)) for i, v in y.items()] + [(None, 1), (7, None)], "toxic")
    out = toxicity.with_toxicity(documents(spark, rows), table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.doc_id in y and is_held_out(r.doc_id)]
    assert np.mean([(r.score >= 0.5) == y[r.doc_id] for r in known]) > 0.97
    assert all(r.score < 0.5 for r in out if r.doc_id is None or r.doc_id >= 900)
    assert {r.score for r in toxicity.with_toxicity(documents(spark, rows), table.limit(0)).collect()} == {0.5}
    assert toxicity.with_toxicity(documents(spark, rows).limit(0), table).count() == 0


def test_pairs_of_sentences():
    swapper = toxicity.Swapper([("women", "men"), ("gay", "straight", "lesbian")])
    text = "Women sing. Nobody here! A gay man; womenfolk"
    assert swapper.pairs(text) == [("Women sing.", "Men sing."), (" A gay man; womenfolk", " A straight man; womenfolk"), (" A gay man; womenfolk", " A lesbian man; womenfolk")]
    inserted = swapper.pairs("nobody here. or there")
    assert len(inserted) in (2, 3) and len({a for a, _ in inserted}) == 1
    for a, b in inserted:
        assert len(set(b.split()) - set(a.split())) == 1 and [w for w in b.split() if w in a.split()] == a.split()
    assert swapper.pairs("") == swapper.pairs(" \n") == toxicity.Swapper([]).pairs("women") == []


def slow_features(text):
    """Counts of words and their beginnings, by name."""
    found = {}
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text):
        word = word.lower()
        names = [word, *((word[:n], n) for n in (4, 5, 6, 7, 8) if len(word) > n)]
        if len(word) > 24 and max(word) >= 128:
            names += [("window", word[k : k + 6]) for k in range(len(word) - 5) if word[k] & 0xC0 != 0x80]
        for name in names:
            found[name] = found.get(name, 0) + 1
    return found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["abcd", "Abcde", "é", "中文字", "x" * 30, " ", ".", "\n", "9"]), max_size=20).map("".join), min_size=1, max_size=5))
def test_features_match_a_slow_count(texts):
    data = [t.encode() for t in texts]
    owner, hashes = word_features(data)
    for k, text in enumerate(data):
        assert sorted(np.unique(hashes[owner == k], return_counts=True)[1].tolist()) == sorted(slow_features(text).values())


def test_every_byte_of_a_word_counts():
    a, b = (word_features([("w" * 29 + c).encode()])[1] for c in "xy")
    assert len(a) == len(b) == 6 and len(set(a.tolist()) & set(b.tolist())) == 5
    long = ("word " * 5000 + "中" * 40_000).encode()
    owner, feature, times = toxicity.document_features([long])
    assert times.max() == 39_999 and 5000 in times
    model = toxicity.SparseModel(np.zeros(1 << toxicity.BITS), 0.0)
    f, v = toxicity.unpacked(toxicity.packed([long])[0])
    model.weights[f] = 1e-4 * np.arange(len(f))
    assert model.scores([long])[0] == pytest.approx(float(toxicity.sigmoid(np.array(model.weights[f] @ v))), rel=1e-6)  # as fitted, so scored


def test_changes_of_pairs():
    pairs = [("a b a", "a c a"), ("same", "same"), ("x", "")]
    changes = toxicity.unpacked_changes(toxicity.packed_changes(pairs))
    sums = [sorted(v.round(4).tolist()) for _, v in changes]
    assert sums == [[-0.6931, 0.6931], [0.6931]] and toxicity.unpacked_changes(None) == []


def test_fit_follows_the_gradient():
    """One document, one step: weights move against a finite difference of its loss."""
    docs = toxicity.packed([b"alpha beta"] * 3 + [b"gamma beta"] * 3)
    y = np.array([1.0] * 3 + [0.0] * 3)
    model = toxicity.fit([(d, None) for d in docs], y, l1=0.0, epochs=1, positive=1.0)
    f, v = toxicity.unpacked(docs[0])
    only = ~np.isin(f, toxicity.unpacked(docs[3])[0])
    assert (model.weights[f[only]] > 0).all()
    scores = model.scores([b"alpha beta", b"gamma beta"])
    assert scores[0] > scores[1]


def test_counterfactuals_lower_false_positives():
    """Groups named mostly in toxic sentences: without the penalty their names raise the score of neutral mentions."""
    draw = random.Random(5)
    swapper = toxicity.Swapper([("muslims", "christians", "jews"), ("women", "men")])
    texts, y = [], []
    for k in range(1200):
        toxic = k % 2 == 0
        words = draw.choices(WORDS, k=12)
        if toxic:
            words[draw.randrange(12)] = draw.choice([f"slur{j}" for j in range(30)])
        if draw.random() < (0.8 if toxic else 0.04):
            words[draw.randrange(12)] = "muslims"
        elif draw.random() < 0.3:
            words[draw.randrange(12)] = draw.choice(["christians", "jews", "men", "women"])
        texts.append(" ".join(words))
        y.append(float(toxic))
    docs = toxicity.packed([t.encode() for t in texts])
    changes = [toxicity.packed_changes(swapper.pairs(t)) for t in texts]
    neutral = [" ".join([*draw.choices(WORDS, k=11), "muslims"]).encode() for _ in range(200)]
    rates = {}
    for weight in (0.0, 10.0):
        model = toxicity.fit(list(zip(docs, changes, strict=True)), np.array(y), counterfactual=weight, positive=1.0)
        rates[weight] = (model.scores(neutral) >= 0.5).mean(), ((model.scores([t.encode() for t in texts]) >= 0.5) == np.array(y)).mean()
    assert rates[10.0][0] < 0.5 * rates[0.0][0] and rates[10.0][1] > 0.9, rates


def test_groups_score_alike_on_the_path_of_the_query(spark):
    """The given labelled texts name no group: neutral mentions are put in, and sentences that differ only in the group score within 0.02 of each other."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    encoded = [r.text for r in docs.join(marks, "doc_id").select("text").collect() if r.text]
    swapper = toxicity.Swapper(toxicity.IDENTITY_TERMS)
    assert sum(len(swapper.pairs(t)) for t in encoded) >= 2 * len(encoded)
    model = toxicity.fit_toxicity(docs, marks)
    for frame in ("the {} met in the town hall after lunch", "{} walked home", "we talked about {} and music all evening"):
        for group in toxicity.IDENTITY_TERMS:
            scores = model.scores([frame.format(t).encode() for t in group])
            assert scores.max() - scores.min() < 0.02 and scores.max() < 0.5


def test_fit_rows_are_bounded(spark):
    """A labelled id that is repeated counts once; features stop at the bytes asked for."""
    rows = [(1, f"copy {k % 3}") for k in range(2000)] + [(i, f"text {i}") for i in range(2, 60)]
    table = labels(spark, [(i, i % 2) for i in range(1, 60)] + [(1, 0), (2, None)], "toxic")
    found = quality.labelled_rows(documents(spark, rows), table, "toxic", 30).collect()
    assert len(found) == len({r.id for r in found}) == 30
    every = quality.labelled_rows(documents(spark, rows), table, "toxic", 1000)
    assert {r.id for r in every.collect()} == {str(i) for i in range(1, 60) if not is_held_out(i)}
    few = quality.within_bytes(every.select("id", "label", "data"), F.lit(10).cast("long"), 75)
    assert len(few) == 7 and len(quality.within_bytes(every, F.lit(100).cast("long"), 75)) == 0


def test_taken_names_are_refused(spark):
    docs = documents(spark, [(1, "a")]).withColumnRenamed("label", "Score")
    for with_ in (quality.with_quality, toxicity.with_toxicity):
        with pytest.raises(ValueError, match="has a column score"):
            with_(docs, labels(spark, [], "quality"))


def slow_passages(text):
    """Some features of each passage, word by word."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text) if w]
    for at in range(0, len(words), quality.PASSAGE_WORDS):
        some = words[at : at + quality.PASSAGE_WORDS]
        n, chars = len(some) + quality.NEUTRAL_WORDS, sum(map(len, some)) + quality.NEUTRAL_WORDS * quality.NEUTRAL_CHARS
        every = b"".join(some)
        again = sum(a == b for a, b in zip(some, some[1:], strict=False))
        yield [len(some) / quality.PASSAGE_WORDS, chars / n / 8, sum(65 <= c <= 90 for c in every) / chars, sum(48 <= c <= 57 for c in every) / chars, sum(c >= 128 for c in every) / chars,
               sum(len(w) <= 3 for w in some) / n, sum(len(w) > 14 for w in some) / n, (len(set(some)) + quality.NEUTRAL_WORDS) / n, again / n]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "THE", "é9", "averyveryverylongword", "#", "|", "Two", "the"]), max_size=150).map(" ".join))
def test_passages_match_a_slow_count(text):
    _, x = quality.passages([text.encode()])
    want = list(slow_passages(text.encode()))
    if want:
        assert np.allclose(x[:, [0, 1, 3, 4, 6, 11, 12, 13, 14]], np.array(want))
    else:
        assert (x == 0).all() and len(x) == 1


def test_forward_matches_a_slow_pass():
    draw = np.random.default_rng(7)
    bags = [draw.normal(size=(k, quality.FEATURES)) for k in (2, 4)]
    model = quality.fit(bags, np.array([0.0, 1.0]), steps=5)
    got, p = model.forward(np.concatenate(bags), np.array([0, 2])), model.weights
    for bag, score in zip(bags, got["score"], strict=True):
        h = [np.tanh(x @ p["W"] + p["w"]) for x in bag]
        e = [math.exp(sum(a * math.tanh(v) / (1 + math.exp(-u)) for a, v, u in zip(p["a"], k @ p["V"], k @ p["U"], strict=True))) for k in h]
        z = sum(k * w / sum(e) for k, w in zip(h, e, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-(z @ p["c"] + p["d"][0]))))
