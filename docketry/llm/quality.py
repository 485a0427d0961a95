"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

Every passage of a whole text is encoded from its characters and words; gated attention weights, learned from document labels
only, decide how much each passage counts; the weighted passage representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.hashing import mixed
from docketry.llm.shared import bounded_batches, hash_sample, held_out, new_column, stash, table, text_bytes

#: Words of a passage; labelled documents that a model is fitted on (chosen by a hash of the id).
PASSAGE_WORDS, FIT_DOCS = 64, 6000
#: Bytes of features that a model is fitted on, at most.
FIT_BYTES = 192 << 20
#: Neutral words that a passage's shares are taken over besides its own, and their length.
NEUTRAL_WORDS, NEUTRAL_CHARS = 3, 5
#: Buckets of hashed word endings in a passage's features.
ENDINGS = 32
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 1 << 20
SYMBOLS = b"|#%$&*!.,"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CLASSES = np.zeros((256, 5), bool)  # upper, lower, digit, symbol, above ASCII
_CLASSES[65:91, 0] = _CLASSES[97:123, 1] = _CLASSES[48:58, 2] = _CLASSES[128:, 4] = True
_CLASSES[33:127, 3] = ~_CLASSES[33:127, :3].any(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def passages(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, features) of every passage of ``PASSAGE_WORDS`` words; a text without words has one passage of zeros."""
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    firsts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(firsts, starts, "right") - 1
    per_text = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    heads = np.flatnonzero(place % PASSAGE_WORDS == 0)
    empty = np.flatnonzero(per_text == 0)
    if not len(heads):
        return empty, np.zeros((len(empty), FEATURES))
    count = np.diff(np.r_[heads, len(owner)]).astype(float)
    of = np.repeat(np.arange(len(heads)), count.astype(int))
    total = lambda values: np.add.reduceat(values.astype(float), heads)
    within = lambda mask: (c := np.r_[0, np.cumsum(mask, dtype=np.int64)])[ends] - c[starts]
    size = (ends - starts).astype(float)
    upper, lower, digit, symbol, high = (within(_CLASSES[raw, k]) for k in range(5))
    letters = upper + lower + high
    chars = total(size)
    # a hash of each word: the sum over its bytes of values that depend on byte and place
    spot = np.arange(len(raw), dtype=np.uint64) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)])).astype(np.uint64)
    bytes_ = mixed((raw.astype(np.uint64) + np.uint64(1)) * _P + spot * np.uint64(0x2545F4914F6CDD1D))
    bytes_[space] = 0
    h = np.add.reduceat(bytes_, starts)
    order = np.lexsort((h, of))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])]
    distinct = np.bincount(of[order][new], minlength=len(heads))
    again = np.r_[False, (h[1:] == h[:-1]) & (of[1:] == of[:-1])]
    tail = sum(raw[np.maximum(ends - k, starts)].astype(np.uint64) * np.uint64(257**k) for k in (1, 2, 3))
    bucket = (mixed(tail * _P) >> np.uint64(59)).astype(np.int64)
    # shares are taken over a few neutral words more, so that a short passage says little
    n, chars, mean = count + NEUTRAL_WORDS, chars + NEUTRAL_WORDS * NEUTRAL_CHARS, (chars + NEUTRAL_WORDS * NEUTRAL_CHARS) / (count + NEUTRAL_WORDS)
    squares = (total(size**2) + NEUTRAL_WORDS * NEUTRAL_CHARS**2) / n
    endings = np.bincount(of * ENDINGS + bucket, minlength=len(heads) * ENDINGS).reshape(-1, ENDINGS) / n[:, None]
    stats = [
        count / PASSAGE_WORDS, mean / 8, np.sqrt(np.maximum(squares - mean**2, 0)) / 8, total(upper) / chars, total(digit) / chars, total(symbol) / chars, total(high) / chars,
        total((upper > 1) & (lower == 0)) / n, total(letters == 0) / n, total((upper == 1) & (lower > 0)) / n, total(symbol > 1) / n, total(size <= 3) / n, total(size > 14) / n,
        (distinct + NEUTRAL_WORDS) / n, total(again) / n, *(4 * total(within(raw == s)) / chars for s in SYMBOLS),
    ]
    rows = np.concatenate([np.stack(stats, 1), endings], 1)
    if len(empty):
        owner_all = np.r_[owner[heads], empty]
        order = np.argsort(owner_all, kind="stable")
        return owner_all[order], np.concatenate([rows, np.zeros((len(empty), rows.shape[1]))])[order]
    return owner[heads], rows


FEATURES = 15 + len(SYMBOLS) + ENDINGS


def batches_of(texts: Sequence[bytes], most: int = BATCH_BYTES) -> Iterator[tuple[int, Sequence[bytes]]]:
    """(first number, texts) in stretches of about ``most`` bytes."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """h = tanh(xW + w); attention softmax of (tanh(hV) * sigmoid(hU)) a within a document; score sigmoid of sum(attention h) c + d."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        """``firsts``: the place of each document's first passage; documents hold at least one."""
        p = self.weights
        sizes = np.diff(np.r_[firsts, len(x)])
        h = np.tanh(x @ p["W"] + p["w"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, firsts), sizes))
        att = e / np.repeat(np.add.reduceat(e, firsts), sizes)
        z = np.add.reduceat(att[:, None] * h, firsts)
        return {"h": h, "v": v, "u": u, "att": att, "z": z, "sizes": sizes, "score": sigmoid(z @ p["c"] + p["d"][0])}

    def gradient(self, x: np.ndarray, firsts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, firsts)
        wide = lambda per_doc: np.repeat(per_doc, f["sizes"], axis=0)
        d_logit = (f["score"] - y) / len(y)
        d_z = wide(d_logit[:, None] * p["c"])
        d_att = (d_z * f["h"]).sum(1)
        d_h = f["att"][:, None] * d_z
        mean = wide(np.add.reduceat(f["att"] * d_att, firsts))
        d_e = f["att"] * (d_att - mean)
        d_v = d_e[:, None] * p["a"] * f["u"] * (1 - f["v"] ** 2)
        d_u = d_e[:, None] * p["a"] * f["v"] * f["u"] * (1 - f["u"])
        d_h = d_h + d_v @ p["V"].T + d_u @ p["U"].T
        d_x = d_h * (1 - f["h"] ** 2)
        return {
            "W": x.T @ d_x, "w": d_x.sum(0), "V": f["h"].T @ d_v, "U": f["h"].T @ d_u, "a": (f["v"] * f["u"]).T @ d_e,
            "c": f["z"].T @ d_logit, "d": np.array([d_logit.sum()]),
        }

    def attention(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))["att"]

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, some in batches_of(texts):
            owner, x = passages(some)
            out[at : at + len(some)] = self.forward((x - self.mean) / self.scale, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))["score"]
        return out


def fit(bags: Sequence[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 1500, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
    """Fit by Adam on bags of passages with labels 0 and 1; without labels of both kinds the model answers their mean (0.5 without any)."""
    draw = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, hidden), "w": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "d": (1,)}
    p = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k not in "wd" else np.zeros(s) for k, s in shapes.items()}
    if len(set(y.tolist())) < 2:
        base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return AttentionModel(p | {"c": np.zeros(hidden), "d": np.array([np.log(base / (1 - base))])})
    every = np.concatenate(bags)
    model = AttentionModel(p, every.mean(0), every.std(0) + 0.02)
    bags = [(b - model.mean) / model.scale for b in bags]
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    order: list[int] = []
    for t in range(1, steps + 1):
        if len(order) < batch:
            order = [*order, *draw.permutation(len(bags)).tolist()]
        some, order = order[:batch], order[batch:]
        x = np.concatenate([bags[k] for k in some])
        firsts = np.cumsum([0, *(len(bags[k]) for k in some)])[:-1]
        grad = model.gradient(x, firsts, y[some])
        now = rate * (1 - t / (steps + 1))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] -= now * (m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8) + decay * p[k])
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, data, label), one row for each of at most ``most`` labelled ids that are not held out, by a hash of the id; ids are joined by broadcast of so many.

    Of a repeated id the label with the smaller hash counts, and the text whose SHA-256 is least.
    """
    bounded_batches(docs.sparkSession)
    few = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("label")).dropna().filter(~held_out(F.col("id")))
    few = hash_sample(few.groupBy("id").agg(F.min_by("label", F.xxhash64("id", "label")).alias("label")), most, "id", "label")
    few = stash(few, "fit-ids")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_bytes(text_col).alias("data")).join(F.broadcast(few), "id")
    one = rows.groupBy("id").agg(F.min(F.struct(F.sha2("data", 256).alias("sha"), "data", "label")).alias("m"))
    return one.select("id", "m.data", "m.label")


def within_bytes(encoded: DataFrame, size: Column, most_bytes: int) -> pd.DataFrame:
    """Encoded rows, one an id and in the order of a hash of the id, while their ``size`` in bytes adds up to ``most_bytes`` at most.

    Only the ids and sizes, at most as many as ids were sampled, are looked at before the rows that fit are fetched. A row that alone is too large is left out.
    """
    encoded = stash(encoded.withColumns({"size": size, "turn": F.xxhash64("id")}), "fit-rows")
    chosen, held = [], 0
    for row in encoded.select("id", "size", "turn").orderBy("turn", "id").collect():
        if held + row["size"] <= most_bytes:
            held += row["size"]
            chosen.append((row["id"],))
    kept = F.broadcast(encoded.sparkSession.createDataFrame(chosen, "id string"))
    return encoded.join(kept, "id").toPandas().sort_values(["turn", "id"], kind="stable", ignore_index=True)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_DOCS, most_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel:
    """Fit on at most ``most`` labelled documents and ``most_bytes`` of their passages' features, which are encoded in the tasks."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, some in batches_of(pdf["data"].tolist()):
                owner, x = passages(some)
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                bags = [b.astype(np.float32).tobytes() for b in np.split(x, cuts[1:])]
                part = pdf.iloc[at : at + len(some)]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "label": part["label"].to_numpy(), "bag": bags})

    encoded = labelled_rows(docs, labels, label, most, id_col, text_col).mapInPandas(encode, "id string, label int, bag binary")
    found = within_bytes(encoded, F.octet_length("bag").cast("long"), most_bytes)
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(float) for b in found["bag"]]
    return fit(bags, found["label"].to_numpy().astype(float))


def score(model: AttentionModel, data: Column) -> Column:
    """Score from 0 to 1 of a column of UTF-8 bytes."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return of(data)


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "score", **options) -> DataFrame:
    """Add the score, likelier label 1 the higher. Null texts are empty and score as such, very long ones by all their passages; every row stays, repeated ones score alike;
    without usable labels all scores are 0.5. Labels of held-out ids are never learned from; null ids and null labels are no labels. A column ``name`` must not exist;
    other columns may have any name. An empty table gives no rows.
    """
    new_column(docs, name)
    return docs.withColumn(name, score(fit_quality(docs, labels, id_col=id_col, text_col=text_col, **options), text_bytes(text_col)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
