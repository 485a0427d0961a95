"""Toxicity: a counterfactual-regularised classifier.

A sparse logistic model over hashed words and word beginnings of whole texts, fitted by follow-the-regularised-leader. Each labelled
sentence that names a group is repeated with the group's term swapped for every other term of its kind; a labelled document whose sentences name no group
gets neutral mentions, each term of one kind put into one of its sentences. The model pays for the squared difference of the scores of such a
pair of sentences, whatever the label, so that naming a group does not by itself move the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.hashing import word_features
from docketry.llm.quality import batches_of, labelled_rows, sigmoid, within_bytes
from docketry.llm.shared import held_out, new_column, table, text_bytes

#: Bits of a feature's number; labelled documents that a model is fitted on (chosen by a hash of the id); documents a feature must be in.
BITS, FIT_DOCS, LEAST_DOCS = 20, 9000, 3
#: Bytes of features that a model is fitted on, at most.
FIT_BYTES = 192 << 20

#: Terms of one group are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives"), ("immigrant", "native"), ("deaf", "blind"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


class Swapper:
    """Pairs of sentences that differ only in the group that they name."""

    def __init__(self, groups: Sequence[Sequence[str]]) -> None:
        self.groups = [tuple(g) for g in groups if len(g) > 1]
        self.others = {a: [b for b in group if b != a] for group in self.groups for a in group}
        self.pattern = re.compile(rf"\b({'|'.join(map(re.escape, self.others))})\b", re.I) if self.others else None

    def swapped(self, sentence: str) -> list[str]:
        """The sentence with each identity term swapped for each other one of its group, keeping a capital first letter."""
        out = []
        for m in self.pattern.finditer(sentence) if self.pattern else ():
            for word in self.others[m[0].lower()]:
                out.append(sentence[: m.start()] + (word.capitalize() if m[0][0].isupper() else word) + sentence[m.end() :])
        return out

    def mentions(self, sentence: str, draw: int) -> list[str]:
        """The sentence with each term of one group put between two of its words; ``draw`` chooses the group and the place."""
        if not self.groups:
            return []
        group, words = self.groups[draw % len(self.groups)], sentence.split()
        at = draw // len(self.groups) % (len(words) + 1)
        return [" ".join([*words[:at], term, *words[at:]]) for term in group]

    def pairs(self, text: str) -> list[tuple[str, str]]:
        """(sentence, counterfactual) of a labelled text: all swaps, or neutral mentions in one sentence where no term occurs."""
        sentences = [m[0] for m in _SENTENCE.finditer(text) if m[0].strip()]
        found = [(s, other) for s in sentences for other in self.swapped(s)]
        if not found and sentences:
            draw = zlib.crc32(text.encode("utf-8", "replace"))
            sentence = sentences[draw % len(sentences)]
            found = [(sentence, other) for other in self.mentions(sentence, draw >> 8)]
        return found


def document_features(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, times) with each feature of a text once."""
    owner, hashes = word_features(texts)
    key, times = np.unique(owner.astype(np.int64) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), times


PACKED = np.dtype([("feature", "<u4"), ("value", "<f4")])


def packed(texts: Sequence[bytes]) -> list[bytes]:
    """For each text its features and log(1 + times)."""
    owner, feature, times = document_features(texts)
    both = np.empty(len(feature), PACKED)
    both["feature"], both["value"] = feature, np.log1p(times)
    return [part.tobytes() for part in np.split(both, np.searchsorted(owner, np.arange(1, len(texts))))] if texts else []


def packed_changes(pairs: Sequence[tuple[str, str]]) -> bytes:
    """What each pair of texts differs in: a row of feature and difference, a row of zeros after each pair."""
    out = []
    a, b = (packed([p[k].encode("utf-8", "replace") for p in pairs]) for k in (0, 1))
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, PACKED), np.frombuffer(y, PACKED)
        feature, place = np.unique(np.r_[x["feature"], y["feature"]], return_inverse=True)
        change = np.bincount(place, np.r_[x["value"], -y["value"]].astype(float), minlength=len(feature)).astype("<f4")
        rows = np.zeros(int(np.count_nonzero(change)) + 1, PACKED)
        rows["feature"][:-1], rows["value"][:-1] = feature[change != 0], change[change != 0]
        out.append(rows)
    return np.concatenate(out).tobytes() if out else b""


def unpacked(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data or b"", PACKED)
    return both["feature"], both["value"]


def unpacked_changes(data: bytes | None) -> list[tuple[np.ndarray, np.ndarray]]:
    feature, value = unpacked(data)
    value = value.astype(float)
    ends = np.flatnonzero(value == 0)
    return [(feature[a:b], value[a:b]) for a, b in zip(np.r_[0, ends[:-1] + 1][: len(ends)], ends, strict=True) if b > a]


@dataclass
class SparseModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """Probability of each text; weights of most features are zero, so only the others are counted."""
        out = np.full(len(texts), self.bias)
        for at, some in batches_of(texts):
            owner, hashes = word_features(some)
            feature = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
            there = self.weights[feature] != 0
            key, times = np.unique(owner[there].astype(np.int64) << BITS | feature[there], return_counts=True)
            out[at : at + len(some)] += np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)] * np.log1p(times), minlength=len(some))
        return sigmoid(out)


def fit(rows: Sequence[tuple[bytes, bytes | None]], y: np.ndarray, counterfactual: float = 1.0, l1: float = 3.0, l2: float = 1.0, rate: float = 0.1,
        positive: float = 3.0, epochs: int = 4, seed: int = 5) -> SparseModel:
    """Fit on packed documents, each with the changes of its pairs of sentences (or None), and labels 0 and 1.

    The loss of a document is its log loss (times ``positive`` for label 1) plus ``counterfactual`` times the mean squared difference of the
    scores of its pairs. Labels of one kind, or none, give a model that answers their mean (0.5 without any).
    """
    if len(set(y.tolist())) < 2:
        base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return SparseModel(np.zeros(1 << BITS), float(np.log(base / (1 - base))))
    documents, pairs = [unpacked(a) for a, _ in rows], [unpacked_changes(b) for _, b in rows]
    in_docs = np.zeros(1 << BITS, np.int32)
    for feature, _ in documents:
        in_docs[feature] += 1
    used = in_docs >= LEAST_DOCS
    documents = [(f[used[f]], v[used[f]]) for f, v in documents]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, moved = 0.0, 1.0
    draw = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(n[at])) / rate + l2), 0.0)

    def step(at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        more = n[at] + g * g
        z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / rate * w
        n[at] = more

    for _ in range(epochs):
        for k in draw.permutation(len(documents)):
            feature, value = documents[k]
            w = weights(feature)
            g = float(sigmoid(np.array(w @ value + bias)) - y[k]) * (positive if y[k] else 1.0)
            step(feature, w, g * value)
            bias -= rate * g / np.sqrt(moved)
            moved += g * g
            for feature, change in pairs[k] if counterfactual else ():
                w = weights(feature)
                gap = float(w @ change)
                if gap:
                    step(feature, w, 2 * counterfactual / len(pairs[k]) * gap * change)
    return SparseModel(weights(np.arange(1 << BITS)), float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_DOCS, most_bytes: int = FIT_BYTES, terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
                 id_col: str = "doc_id", text_col: str = "text", **options) -> SparseModel:
    """Fit on at most ``most`` labelled documents and ``most_bytes`` of their features; these and the pairs of sentences are made in the tasks."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        swapper = Swapper(terms)
        for pdf in batches:
            for at, some in batches_of(pdf["data"].tolist()):
                part = pdf.iloc[at : at + len(some)]
                changes = [packed_changes(swapper.pairs(t.decode("utf-8", "replace"))) for t in some]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "label": part["label"].to_numpy(), "doc": packed(some), "changes": changes})

    rows = labelled_rows(docs, labels, label, most, id_col, text_col)
    encoded = rows.mapInPandas(encode, "id string, label int, doc binary, changes binary")
    found = within_bytes(encoded, (F.octet_length("doc") + F.octet_length("changes")).cast("long"), most_bytes)
    return fit(list(zip(found["doc"], found["changes"], strict=True)), found["label"].to_numpy().astype(float), **options)


def score(model: SparseModel, data: Column, spark: SparkSession) -> Column:
    """Score from 0 to 1 of a column of UTF-8 bytes."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(SparseModel(*shared.value).scores(texts.tolist()))

    return of(data)


def with_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "score", **options) -> DataFrame:
    """Add the score, likelier label 1 the higher. Null texts are empty and score as such, very long ones as a whole; every row stays, repeated ones score alike;
    without usable labels all scores are 0.5. Labels of held-out ids are never learned from; null ids and null labels are no labels. A column ``name`` must not exist;
    other columns may have any name. An empty table gives no rows.
    """
    new_column(docs, name)
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options)
    return docs.withColumn(name, score(model, text_bytes(text_col), docs.sparkSession))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
