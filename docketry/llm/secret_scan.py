"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, the other on ordinary identifiers, both from all documents and seeded strings. A long run of
key characters that no pattern covers is reported when it is far likelier under the first model.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.shared import bounded_batches, new_column, table

# The kinds of base span in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Characters of a key; a candidate is a run of at least CANDIDATE_LEAST of them, DISTINCT_LEAST of them different.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE_LEAST, DISTINCT_LEAST = 20, 8
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}")
_STATE = {c: k + 1 for k, c in enumerate(ALPHABET)}  # 0 is the start of a string
_STATES = len(ALPHABET) + 1
_IS_KEY = np.zeros(256, bool)
_IS_KEY[list(ALPHABET.encode())] = True

#: Strings of each seeded kind.
SEEDED = 400
#: A candidate is reported from this mean log-likelihood ratio a character on.
THRESHOLD = 1.0


@dataclass
class MarkovPair:
    """Log-likelihood ratio of each character after each other one: random strings over ordinary identifiers."""

    ratio: np.ndarray  # (states, states)

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio a character; 0 for an empty text. Characters outside the alphabet count as a start."""
        states = [0, *(_STATE.get(c, 0) for c in text)]
        return float(self.ratio[states[:-1], states[1:]].mean()) if text else 0.0


_BYTE_STATE = np.zeros(256, np.int64)
_BYTE_STATE[list(ALPHABET.encode())] = np.arange(1, _STATES)


def transitions(texts: Iterable[str]) -> np.ndarray:
    """Counts of each character after each other one, or after the start; characters outside the alphabet end a string."""
    states = _BYTE_STATE[np.frombuffer("\n".join(["", *texts]).encode("utf-8", "replace"), np.uint8)]
    into = states[1:] > 0
    return np.bincount((states[:-1] * _STATES + states[1:])[into], minlength=_STATES * _STATES)


def train_markov(counted: DataFrame, smoothing: float = 0.5) -> MarkovPair:
    """Train both models from rows (is_random boolean, move int, n long), the counts of each transition, which may repeat.

    Spark sums them, so at most two small tables reach the driver. Without rows of a label its model is uniform.
    """
    summed = counted.groupBy("is_random", "move").agg(F.sum("n").alias("n")).collect()
    tables = np.full((2, _STATES**2), smoothing)
    for row in summed:
        tables[int(row["is_random"]), row["move"]] += row["n"]
    tables = tables.reshape(2, _STATES, _STATES)
    logs = np.log(tables / tables.sum(2, keepdims=True))
    return MarkovPair(logs[1] - logs[0])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind; leftmost and non-overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def worth_a_look(data: bytes) -> bool:
    """False only for texts in which neither a pattern nor a candidate can occur."""
    if len(data) >= CANDIDATE_LEAST:
        key = _IS_KEY[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        edges = np.concatenate([[0], edges, [len(key)]])
        if (np.diff(edges)[int(not key[0]) :: 2] >= CANDIDATE_LEAST).any():
            return True
    low = data.lower()
    return any(k in low for k in KEYWORDS)


def secret_spans(text: str | None, models: MarkovPair, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Base spans, and spans of kind ``random`` where the models find a random string in what base spans leave of a candidate."""
    if not text or not worth_a_look(text.encode("utf-8", "replace")):
        return []
    base = base_spans(text)
    added = []
    for start, end in uncovered(((m.start(), m.end()) for m in CANDIDATE.finditer(text)), base):
        piece = text[start:end]
        if len(piece) >= CANDIDATE_LEAST and len(set(piece)) >= DISTINCT_LEAST and models.score(piece) >= threshold:
            added.append((start, end, "random"))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def uncovered(runs: Iterable[tuple[int, int]], spans: Sequence[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of ``runs`` outside ``spans``; both are sorted by start, and each is walked once."""
    at, reach = 0, 0  # the next span, and the furthest end of those before it
    for start, end in runs:
        start = max(start, min(reach, end))
        while at < len(spans) and spans[at][0] < end:
            a, b, _ = spans[at]
            if a > start:
                yield start, a
            reach = max(reach, b)
            start = max(start, min(reach, end))
            at += 1
        if start < end:
            yield start, end


def seeded_strings(each: int = SEEDED, seed: int = 11) -> list[str]:
    """Random strings by construction: hexadecimal, upper case and digits, letters and digits, base 64."""
    draw = random.Random(seed)
    hexadecimal, upper, mixed = "0123456789abcdef", ALPHABET[26:62], ALPHABET[:62]
    kinds = (hexadecimal, upper, mixed, ALPHABET[:62] + "+/", ALPHABET[:62] + "-_")
    return ["".join(draw.choices(kind, k=draw.randint(20, 48))) for kind in kinds for _ in range(each)]


PLAIN_WORDS = "user name file path index count value list item node data test case page time date code line text main config client server request response handler version number".split()


def seeded_identifiers(each: int = SEEDED, seed: int = 12) -> list[str]:
    """Ordinary strings by construction: joined plain words, paths, dates, numbers, and runs of one character."""
    draw = random.Random(seed)
    words = lambda: draw.choices(PLAIN_WORDS, k=draw.randint(3, 6))
    out = [joint.join(words()) for joint in ("_", "-", "/", "") for _ in range(each)]
    out += ["".join(w.capitalize() for w in words()) for _ in range(each)] + ["_".join(words()).upper() for _ in range(each)]
    out += [f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}T{draw.randint(0, 23):02}-{draw.randint(0, 59):02}-00" for _ in range(each)]
    out += ["".join(draw.choices("0123456789", k=draw.randint(20, 30))) for _ in range(each)]
    return out + [c * 24 for c in ALPHABET for _ in range(4)]


_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DIGIT = re.compile(r"[0-9]")
_FOUND = (re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"), re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}"))
#: State of the capital and of the small letter of each state.
_UPPER, _LOWER = (np.array([0, *(_STATE[f(c)] for c in ALPHABET)]) for f in (str.upper, str.lower))


def ordinary_words(text: str) -> list[str]:
    """Words of a text outside runs of key characters that have a digit with 15 or more of them after it."""
    return _WORD.findall(_RUN.sub(lambda m: " " if _DIGIT.search(m[0], 0, len(m[0]) - 15) else m[0], text))


def word_transitions(texts: Iterable[Sequence[str]]) -> np.ndarray:
    """Transitions of all words, repeats included, alone and joined with the next of their text by each of four joints (``_``, ``-``, ``/``, a capital).

    The same as ``transitions`` of all those strings, without making them.
    """
    texts = [words for words in texts if words]
    total = np.zeros(_STATES**2, np.int64)
    if not texts:
        return total
    states = _BYTE_STATE[np.frombuffer("\n".join(["", *(w for words in texts for w in words), ""]).encode(), np.uint8)]
    edges = np.flatnonzero(states == 0)
    first, last = states[edges[:-1] + 1], states[edges[1:] - 1]
    ends = np.cumsum([len(words) for words in texts])
    has_next, has_before = np.ones(len(first), bool), np.ones(len(first), bool)
    has_next[ends - 1] = False
    has_before[np.r_[0, ends[:-1]]] = False

    def add(a: np.ndarray | int, b: np.ndarray | int, times: np.ndarray | int = 1) -> None:
        total[:] += np.bincount(a * _STATES + b, None if isinstance(times, int) else times, _STATES**2).astype(np.int64)

    sizes = np.diff(edges) - 1
    inner = (states[:-1] > 0) & (states[1:] > 0)
    word = np.repeat(np.arange(len(first)), sizes - 1)
    a, b = states[:-1][inner], states[1:][inner]
    add(a, b, (1 + 4 * has_next + 3 * has_before)[word])
    start = np.r_[True, word[1:] != word[:-1]][: len(word)]
    then = has_before[word]
    add(np.where(start, _UPPER[a], _LOWER[a])[then], _LOWER[b][then])
    add(0, first, 1 + 4 * has_next)
    for joint in "_-/":
        add(last[has_next], _STATE[joint])
        add(_STATE[joint] * np.ones(int(has_before.sum()), np.int64), first[has_before])
    add(last[has_next], _UPPER[first[has_before]])
    return total


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(is_random, move, n): transitions counted over all documents and seeded strings, for ``train_markov``.

    Values that the fixed patterns find are random strings; words outside them are ordinary identifiers, alone and joined in pairs.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        random_, ordinary = np.zeros(_STATES**2, np.int64), np.zeros(_STATES**2, np.int64)
        for pdf in batches:
            random_ += transitions(value for text in pdf["text"] for pattern in _FOUND for value in pattern.findall(text))
            ordinary += word_transitions(ordinary_words(text) for text in pdf["text"])
        for label, counts in ((True, random_), (False, ordinary)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"is_random": label, "move": at, "n": counts[at]})

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).dropna()
    found = texts.mapInPandas(count, "is_random boolean, move int, n long")
    seeded = [(label, int(k), int(n[k])) for label, n in ((True, transitions(seeded_strings())), (False, transitions(seeded_identifiers()))) for k in np.flatnonzero(n)]
    return found.unionByName(docs.sparkSession.createDataFrame(seeded, "is_random boolean, move int, n long"))


def with_spans(docs: DataFrame, models: MarkovPair, text_col: str = "text", name: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """Add an array of (start, end, kind) in code points, the end exclusive.

    Null and empty texts get an empty array; repeated rows get equal arrays; spans that start at one place come in the order of KINDS; long texts are scanned
    whole. A column ``name`` must not exist; other columns may have any name. An empty table gives no rows.
    """
    new_column(docs, name)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in secret_spans(t, models, threshold)] for t in texts], dtype=object)

    return docs.withColumn(name, scan(F.col(text_col).cast("string")))


def redact(docs: DataFrame, models: MarkovPair, text_col: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """Replace every found span (overlapping ones as one) in the text; nulls stay null, all rows and other columns stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, secret_spans(t, models, threshold), mark) for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def redacted(text: str | None, spans: list[tuple[int, int, str]], mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = train_markov(labelled_samples(docs))
    found = with_spans(docs, models).drop("text")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), of("random").alias("n_random"),
    )
