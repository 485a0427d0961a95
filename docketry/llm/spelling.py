"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced code point parts, by dynamic programming over sorted lists.

A task scans a sorted list of words for all words of it at once. Words with a common prefix share the rows of the edit matrix (a band of three cells) up to it, as
their longest common prefixes (LCP) with their neighbours in the list tell; a range whose shared prefix is already more than one edit away is left out whole.

The vocabulary is dealt to lists so that every pair meets once. Two words one edit apart, the shorter of s code points, share all before their LCP i and all after the
edit: so if i lies in a block [low, high) of places, they share the first ``low`` and the last s - ``high`` code points. Each word goes to the lists of two
blocks, for s its own length and one less. A list of over ``most`` words is dealt again by the halves of its block, down to blocks of one place, whose lists the
alphabet bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import stash, table

#: Code points of a word and its occurrences, at least; a form has so many times the occurrences of its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Words of a list before it is dealt again.
LIST_WORDS = 20_000
#: Words and matrix cells that a task scans together, and (word, range) pairs that a scan holds at most, about.
SCAN_WORDS, SCAN_CELLS, FRONTIER = 100_000, 8_000_000, 1_000_000
#: Records of a task, about.
TASK_ROWS = 200_000
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of Latin letters in whole texts, A-Z lower-cased, of at least that length and number.

    With ``damage``, a run loses a code point if that number divides its crc32 with the document's id, as the contract of the query has it. Null texts have no runs,
    a null id is empty, repeated rows count each.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length).select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if damage:
        code = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (code % F.length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.select(F.when(code % damage == 0, less).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _list_of(low: Column, high: Column) -> list[Column]:
    """Columns that name the list of block [low, high), from ``word`` and ``short``."""
    size = F.length("word")
    last = F.greatest(F.col("short") - high, F.lit(0))
    key = F.concat_ws("|", F.substring(F.col("word"), F.lit(1), low), F.substring(F.col("word"), size - last + 1, last))
    return [low.alias("low"), high.alias("high"), key.alias("key")]


def dealt(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = LIST_WORDS) -> DataFrame:
    """``words`` (word, n) with the lists (short, low, high, key) that each belongs to; lists of more than ``most`` words end in blocks of one place."""
    size = F.length("word")
    rows = words.withColumn("short", F.explode(F.array(size, size - 1))).filter(F.col("short") >= least_length)
    half = F.floor(F.col("short") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("short") + 1).alias("high")))
    at = rows.withColumn("b", F.explode(halves)).select("word", "n", "short", *_list_of(F.col("b.low"), F.col("b.high")))
    at, done, names = stash(at, "spelling-lists"), None, ["short", "low", "high", "key"]
    while True:
        full = stash(at.groupBy(*names).agg(F.count(F.lit(1)).alias("size")).filter((F.col("size") > most) & (F.col("high") - F.col("low") > 1)).select(*names), "spelling-full")
        if full.isEmpty():
            return at if done is None else done.unionByName(at)
        small = at.join(full, names, "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        again = at.join(full, names, "left_semi").withColumn("b", F.explode(halves))
        at = stash(again.select("word", "n", "short", *_list_of(F.col("b.low"), F.col("b.high"))), "spelling-lists")


class SortedLists:
    """Sorted lists of Latin-1 words side by side (one length ``short`` or one more in all), to be scanned together.

    ``visited`` counts the (word, range) pairs whose row of the matrix was computed, ``skipped`` those left out for more than one edit.
    """

    def __init__(self, words: list[bytes], lists: np.ndarray, low: np.ndarray, high: np.ndarray, short: int) -> None:
        self.short, self.low, self.high, self.lists = short, low, high, lists
        width = short + 2  # a zero ends each word
        self.letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        #: LCP with the word before, -1 where a list begins
        self.lcp = np.full(len(words) + 1, -1, np.int64)
        if len(words) > 1:
            same = self.letters[1:] == self.letters[:-1]
            self.lcp[1:-1] = np.where(lists[1:] == lists[:-1], np.where(same.all(1), width, same.argmin(1)), -1)
        self.visited = self.skipped = 0

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a, b) of words one edit apart, a of ``short`` code points, whose LCP lies in the block of their list; each pair once."""
        asked = np.flatnonzero(self.sizes == self.short)
        step = max(1, FRONTIER // 256)
        for at in range(0, len(asked), step):
            yield from self._scan(asked[at : at + step])

    def _scan(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        heads = np.flatnonzero(self.lcp[:-1] < 0)
        list_end = np.r_[heads[1:], len(self.sizes)]
        of = np.searchsorted(heads, a, "right") - 1
        first, end = heads[of], list_end[of]
        depth = self.low[a]  # what all words of a list share costs no row
        cells = np.stack([np.where(depth > 0, 1, 2), np.zeros_like(a), np.ones_like(a)], 1).astype(np.int8)
        for level in range(int(depth.min(initial=self.short)), self.short + 2):
            now = depth == level
            if not now.any():
                if not len(a):
                    return
                continue
            later = ~now
            keep_a, keep_first, keep_end, keep_cells, keep_depth = a[later], first[later], end[later], cells[later], depth[later]
            a1, first1, end1, old = a[now], first[now], end[now], cells[now]
            # children: the runs of each range whose words share level + 1 code points
            starts = np.flatnonzero(self.lcp[:-1] <= level)
            begin, stop = np.searchsorted(starts, first1), np.searchsorted(starts, end1)
            width = stop - begin
            who = np.repeat(np.arange(len(a1)), width)
            index = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(len(who))
            child = starts[index]
            after = np.where(index + 1 < stop[who], starts[np.minimum(index + 1, len(starts) - 1)], end1[who])
            a1, old = a1[who], old[who]
            self.visited += len(a1)
            letter, word = self.letters[child, level], self.letters[a1]
            rows = np.arange(len(a1))
            ended = letter == 0
            if ended.any():  # a word of exactly ``level`` code points: its distance is the cell of the whole of a
                cell = self.short - level + 1
                hit = ended & (old[:, cell] == 1) & ((child > a1) | (level > self.short)) if 0 <= cell <= 2 else np.zeros(len(a1), bool)
                if hit.any():
                    yield a1[hit], child[hit]
            new = np.full((len(a1), 3), 2, np.int8)
            if level >= 1:
                new[:, 0] = np.minimum(old[:, 0] + (word[rows, level - 1] != letter), old[:, 1] + 1)
            else:
                new[:, 0] = old[:, 1] + 1
            if level < self.short:
                new[:, 1] = np.minimum(np.minimum(old[:, 1] + (word[rows, level] != letter), old[:, 2] + 1), new[:, 0] + 1)
            if level + 1 < self.short:
                new[:, 2] = np.minimum(old[:, 2] + (word[rows, level + 1] != letter), new[:, 1] + 1)
            new = np.minimum(new, 2)
            keep = ~ended & (new.min(1) <= 1)
            self.skipped += int(np.count_nonzero(~ended & ~keep))
            keep &= ~((new[:, 1] == 0) & (level + 1 >= self.high[a1]))  # no edit within the block
            a = np.r_[keep_a, a1[keep]]
            first, end = np.r_[keep_first, child[keep]], np.r_[keep_end, after[keep]]
            cells = np.concatenate([keep_cells, new[keep]])
            depth = np.r_[keep_depth, np.full(int(np.count_nonzero(keep)), level + 1)]


def near_words(lists: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(word, n_near, best) of each word of :func:`dealt` lists that has near words in a list: their number there, and (-n, word) of the first of them by falling n."""
    names = ["short", "low", "high", "key"]
    spark = lists.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, math.ceil(lists.count() / task_rows)))

    def table_of(word, n_near, n, best) -> pd.DataFrame:
        text, number = (lambda x: pd.Series(x, dtype=object)), (lambda x: pd.Series(x, dtype="int64"))
        return pd.DataFrame({"word": text(word), "n_near": number(n_near), "n": number(n), "best": text(best)})

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        word = part["word"].to_numpy(object)
        words = [w.encode("latin-1") for w in word]
        new = np.r_[False, (part[names].to_numpy()[1:] != part[names].to_numpy()[:-1]).any(1)] if len(part) > 1 else np.zeros(len(part), bool)
        found = SortedLists(words, np.cumsum(new), part["low"].to_numpy(np.int64), part["high"].to_numpy(np.int64), int(part["short"].iloc[0]))
        pairs = list(found.pairs())
        if not pairs:
            return table_of([], [], [], [])
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        a, b = np.r_[a, b], np.r_[b, a]
        counts = part["n"].to_numpy(np.int64)
        # Latin-1 order is code-point order; lists stand side by side, so places compare within one list only, as needed
        order = np.lexsort((b, -counts[b], a))
        a, b = a[order], b[order]
        firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        sizes = np.diff(np.r_[firsts, len(a)])
        return table_of(word[a[firsts]], sizes, counts[b[firsts]], word[b[firsts]])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Scans whole lists as they come in order; what is held is SCAN_WORDS words and one list more."""
        held = None
        for batch in batches:
            held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            while len(held):
                short = int(held["short"].iloc[0])
                most = max(2, min(SCAN_WORDS, SCAN_CELLS // (short + 2)))
                same = int(np.argmax(held["short"].to_numpy() != short)) if held["short"].iloc[-1] != short else len(held)
                whole = same < len(held)
                if not whole and same < most:
                    break
                if not whole:  # the last list may go on in the next batch
                    tail = (held[names].iloc[:-1].to_numpy() != held[names].iloc[-1].to_numpy()).any(1)
                    same = int(np.flatnonzero(tail)[-1]) + 1 if tail.any() else 0
                    if not same:
                        break
                yield scan(held.iloc[:same].reset_index(drop=True))
                held = held.iloc[same:].reset_index(drop=True)
                if not whole:
                    break
        while held is not None and len(held):
            short = int(held["short"].iloc[0])
            same = held["short"].to_numpy() == short
            yield scan(held[same].reset_index(drop=True))
            held = held[~same].reset_index(drop=True)

    rows = lists.select("word", "n", *names).repartition(tasks, *names).sortWithinPartitions(*names, "word")
    found = rows.mapInPandas(search, "word string, n_near long, n long, best string")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, by doubling. A form is ``TIMES`` as frequent as its word, so a chain has at most 19 steps and five rounds end it."""
    at = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("upper"))
        further = at.join(up, "root", "left").select("word", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved"))
        further = stash(further, "spelling-roots")
        at = further.drop("moved")
        if further.filter("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES, most: int = LIST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary of distinct (word, n) of code points up to U+00FF.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` the word's own, else null; ``root`` follows forms to
    the last and is the word itself without one. Null and shorter words, and words beyond U+00FF, are left out; no words, no rows. Very long words (whole texts of
    letters) are words like others: lists hold one length, so they fill no matrix but their own.
    """
    words = words.select("word", "n").filter(F.col("word").rlike(r"^[\u0001-ÿ]+$") & (F.length("word") >= least_length))
    words = stash(words, "spelling-words")
    near = stash(near_words(dealt(words, least_length, most)), "spelling-near")
    form = F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n")))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f"))
    rows = stash(rows.select("word", "f.form", "n", "n_near", "f.form_n"), "spelling-forms")
    last = roots(rows.filter("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), damage=31))


# CRC-32 a byte at a time, by its table; words one edit apart agree once a code point of each is taken out, at one place if they are of one length
ORACLE = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), b AS (
  SELECT id, run, count(*) AS k, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM r WHERE len(run) >= 7 GROUP BY id, run
), c AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, crc
), w AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word FROM c) WHERE len(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), d AS (
  SELECT word, n, i, word[:i] || word[i + 2:] AS less FROM (SELECT word, n, unnest(range(len(word))) AS i FROM w)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.less = w.word UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.less = w.word
), best AS (
  SELECT word, n, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word, n
), f AS (
  SELECT w.word, CASE WHEN m >= 10 * w.n THEN other END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN m END::BIGINT AS form_n FROM w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f l ON l.word = up.root WHERE l.form IS NULL
"""
