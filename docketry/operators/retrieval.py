"""Retrieval for tables of queries: dense and lexical top-k, fusion, filters by date and metadata, re-ranking and gates.

Results are rows (query_id, doc_id, score, rank), ranks from 1, ties to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.text import INDEX_STOP_WORDS, extract_references, index_terms, keywords, lower_words, once, phrases
from docketry.operators.lexical import LexicalIndex, placed_terms
from docketry.sources.scratch import written

#: Vectors and queries that one task compares at a time; a query table of up to so many rows is one block.
SHARD_ROWS, BLOCK_ROWS = 32_768, 4_096
#: Documents and different questions that one task of a lexical search compares at a time.
SHARD_DOCS, BLOCK_QUESTIONS = 8_192, 32_768
#: Different terms whose counts a task holds before it hands them on.
COUNTED_TERMS = 500_000
BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60


def ranked(rows: DataFrame, k: int | None = None, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Ranks by descending score within ``by``; the first ``k`` only, if given (Spark cuts them before the shuffle)."""
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), tie)))
    return out if k is None else out.filter(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, skip_same_id: bool = False) -> DataFrame:
    """The ``k`` nearest by cosine, scores rounded to six places; ``queries`` (query_id, vector), ``vectors`` (doc_id, vector).

    Blocks of queries meet shards of vectors as pairs of bounded groups; a zero vector has cosine 0. Rows with a null id, a null or empty vector, or a component that is null
    or not finite take no part; a query meets the vectors of its own length.
    """
    return _nearest(queries, vectors, k, threshold, skip_same_id)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None, skip_same_id: bool, compared: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The pairs of bounded groups of R1 and R2; ``compared`` says of unit vectors (queries, vectors) which pairs are candidates, by default all."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    fit = lambda df, i: df.select(i, "vector").dropna().filter((F.size("vector") > 0) & finite)
    queries, vectors = fit(queries, "query_id"), fit(vectors, "doc_id")
    shards, blocks = max(1, math.ceil(vectors.count() / SHARD_ROWS)), max(1, math.ceil(queries.count() / BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select("doc_id", "vector", part("doc_id", shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("query_id", "vector", part("query_id", blocks).alias("block"), every(shards).alias("shard"))

    def unit(rows: pd.Series) -> np.ndarray:
        m = np.stack(rows.to_numpy()).astype(np.float64)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1)

    def nearest(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = docs["vector"].map(len)
        for n, same in asked.groupby(asked["vector"].map(len)):
            near = docs[lengths == n]
            if not len(near):
                continue
            ids = near["doc_id"].to_numpy()
            matrix = unit(near["vector"])
            for at in range(0, len(same), 256):
                some = same.iloc[at : at + 256]
                units = unit(some["vector"])
                scores = np.round(units @ matrix.T, 6)
                mask = None if compared is None else compared(units, matrix)
                for at_row, (q, row) in enumerate(zip(some["query_id"], scores, strict=True)):
                    keep = np.arange(len(row)) if mask is None else np.flatnonzero(mask[at_row])
                    keep = keep if threshold is None else keep[row[keep] >= threshold]
                    keep = keep[ids[keep] != q] if skip_same_id else keep
                    if len(keep) > k:
                        kth = np.partition(row[keep], -k)[-k]
                        keep = keep[row[keep] >= kth]
                    best = keep[np.lexsort((ids[keep], -row[keep]))[:k]]
                    out.append(pd.DataFrame({"query_id": q, "doc_id": ids[best], "score": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(nearest, types)
    return ranked(found, k)


def dense_topk_lsh(queries: DataFrame, vectors: DataFrame, k: int, bucket: float = 1.0, tables: int = 16, radius: float = 1.4, seed: int = 3) -> DataFrame:
    """R2: approximate nearest by random projections of unit vectors: candidates share a bucket of width ``bucket`` in one of ``tables`` projections and are within Euclidean ``radius``; exact cosines of those.

    Every row is hashed. Candidates are formed within the bounded groups of R1 and never leave them as pairs; a join on (table, bucket) would write a pair for each table that it shares.
    """

    def hashes(units: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(seed).normal(size=(units.shape[1], tables))
        return np.floor(units @ (planes / np.linalg.norm(planes, axis=0)) / bucket).astype(np.int64).T

    def compared(asked: np.ndarray, docs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(asked), len(docs)), dtype=bool)
        for a, d in zip(hashes(asked), hashes(docs), strict=True):
            out |= a[:, None] == d
        return out

    return _nearest(queries, vectors, k, 1 - radius**2 / 2, False, compared)


def metadata_filter(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values, before any join, so that the scan can use it."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def bm25_terms(docs: DataFrame, stop_words: Sequence[str] = INDEX_STOP_WORDS) -> DataFrame:
    """(doc_id, terms, length) of ``docs`` (doc_id, text); the length counts all terms of a document."""
    return docs.select("doc_id", index_terms(F.col("text"), stop_words).alias("terms")).withColumn("length", F.size("terms"))


def bm25_postings(docs: DataFrame, stop_words: Sequence[str] = INDEX_STOP_WORDS) -> DataFrame:
    """(term, doc_id, tf, length). Texts without terms have no rows."""
    return _postings(bm25_terms(docs, stop_words))


def _postings(terms: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    rows = terms.select("doc_id", "length", F.explode("terms").alias("term"))
    rows = rows if asked is None else rows.join(asked, "term", "left_semi")
    return rows.groupBy("term", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25_term_counts(docs: DataFrame, stop_words: Sequence[str] = INDEX_STOP_WORDS) -> DataFrame:
    """(term, df, total) of :func:`bm25_postings` without its rows: texts are dealt and sorted by document, and a task adds up the terms of its documents, ``COUNTED_TERMS`` at a time."""
    rows = docs.select("doc_id", F.array_join(lower_words(F.col("text")), " ").alias("words")).repartition("doc_id").sortWithinPartitions("doc_id")
    stops = frozenset(stop_words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, total, same, last = Counter(), Counter(), {}, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"term": list(total), "df": [df[t] for t in total], "total": list(total.values())})

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["words"], strict=True):
                doc = None if pd.isna(doc) else doc
                if doc != last:  # rows of one id and length are one document
                    for seen in same.values():
                        df.update(seen)
                    same, last = {}, doc
                    if len(total) > COUNTED_TERMS:
                        yield out()
                        df, total = Counter(), Counter()
                ws = text.split()
                if stops.isdisjoint(ws):
                    terms = [w for w in ws if len(w) >= 2] + list(map("_".join, zip(ws, ws[1:], strict=False)))
                else:
                    terms = [w for w in ws if len(w) >= 2 and w not in stops] + [f"{a}_{b}" for a, b in zip(ws, ws[1:], strict=False) if a not in stops or b not in stops]
                total.update(terms)
                same.setdefault(len(terms), set()).update(terms)
        for seen in same.values():
            df.update(seen)
        yield out()

    return rows.mapInPandas(count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def bm25_scores(queries: DataFrame, docs: DataFrame | LexicalIndex, stop_words: Sequence[str] = INDEX_STOP_WORDS, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, doc_id, raw): sums over the query's terms, each as often as the query has it; idf ln((N - n + 0.5) / (n + 0.5) + 1).

    ``docs`` is a stored index, of which the buckets of the query's terms are read, or a table (doc_id, text), whose texts are cut into terms once, and written. Only the postings
    of query terms are kept before anything is joined by document; the length of a document travels with its postings.
    """
    asked = queries.select("query_id", F.explode(index_terms(F.col("text"), stop_words)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = written(asked, "bm25-asked")
    wanted = asked.select("term").distinct()
    if isinstance(docs, LexicalIndex):
        lengths, postings = docs.lengths(), docs.postings(wanted).drop("places")
    else:
        lengths = written(bm25_terms(docs, stop_words), "bm25-terms")
        postings = _postings(lengths, wanted)
    counts = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    postings = written(postings, "bm25-postings")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = asked.join(df, "term").join(postings, "term").join(F.broadcast(counts), F.lit(True))  # counts is one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part * F.col("times")).alias("raw"))


def bm25_topk(queries: DataFrame, docs: DataFrame | LexicalIndex, k: int, stop_words: Sequence[str] = INDEX_STOP_WORDS, keep: Column | None = None, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Raw scores over the query's best, rounded to six places. ``keep`` filters after the best is known, as metadata filters of this index do.

    Without ``keep`` no (query, document) pair leaves a task but those that may be among the ``k`` first: shards of documents meet blocks of questions, and questions with the same terms are
    looked for once. Rows with a null id take no part; repeated rows of one id are one document.
    """
    if keep is not None:
        raw = written(bm25_scores(queries, docs, stop_words, k1, b), "bm25-raw")
        return ranked(_over_top(raw).filter(keep), k)
    asked = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(index_terms(F.col("text"), stop_words)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = written(asked, "bm25-asked")
    wanted = written(asked.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "bm25-wanted")
    held = written(_wanted_terms(docs, wanted, stop_words), "bm25-held")
    counts = held.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length")).first()
    if not counts["n_docs"]:
        return ranked(queries.select("query_id").crossJoin(held.select("doc_id")).withColumn("score", F.lit(0.0)).limit(0), k)
    n_docs, average = counts["n_docs"], float(counts["avg_length"]) or 1.0
    df = held.select(F.explode("terms").alias("t")).groupBy(F.col("t.term_id").alias("term_id")).agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weighed = asked.join(wanted, "term").join(df, "term_id").select("query_id", F.struct("term_id", (idf * (k1 + 1)).alias("most"), "times").alias("t"))
    bags = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("bag"))
    bags = written(bags.withColumn("asker", F.min("query_id").over(W.partitionBy("bag"))), "bm25-bags")
    different = bags.filter("query_id = asker").select("query_id", "bag")
    shards, blocks = max(1, math.ceil(n_docs / SHARD_DOCS)), max(1, math.ceil(different.count() / BLOCK_QUESTIONS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    column = lambda of, c, t: F.transform(of, lambda x: x[c].cast(t)).alias(c)
    left = held.filter(F.size("terms") > 0).select("doc_id", "length", column("terms", "term_id", "bigint"), column("terms", "tf", "double"), part("doc_id", shards).alias("shard"), every(blocks).alias("block"))
    right = different.select("query_id", column("bag", "term_id", "bigint"), column("bag", "most", "double"), column("bag", "times", "double"), part("query_id", blocks).alias("block"), every(shards).alias("shard"))

    def best(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _best_of_shard(docs, asked, k, k1 * (1 - b), k1 * b / average, k1)

    types = f"query_id {bags.schema['query_id'].dataType.simpleString()}, doc_id {held.schema['doc_id'].dataType.simpleString()}, raw double"
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(best, types)
    first = ranked(_over_top(written(found, "bm25-found")), k).withColumnRenamed("query_id", "asker")
    return first.join(bags.select("query_id", "asker"), "asker").select("query_id", "doc_id", "score", "rank")


def _over_top(raw: DataFrame) -> DataFrame:
    best = raw.groupBy("query_id").agg(F.max("raw").alias("top"))
    return raw.join(best, "query_id").select("query_id", "doc_id", F.round(F.col("raw") / F.col("top"), 6).alias("score"))


def _wanted_terms(docs: DataFrame | LexicalIndex, wanted: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """(doc_id, length, terms): of every document the wanted terms (term, term_id) with their counts; the length counts all its terms."""
    listed = F.array_compact(F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("term_id", "tf")))).alias("terms")
    if isinstance(docs, LexicalIndex):
        hits = docs.postings(wanted.select("term")).join(wanted, "term").groupBy("doc_id").agg(listed)
        return docs.lengths().join(hits, "doc_id", "left").select("doc_id", "length", F.coalesce("terms", F.array().cast(hits.schema["terms"].dataType)).alias("terms"))
    rows = placed_terms(docs.select("doc_id", "text").filter("doc_id IS NOT NULL").repartition("doc_id"), stop_words)
    counted = rows.join(wanted, "term", "left").groupBy("doc_id", "term_id").agg(F.count("term").alias("tf"))
    return counted.groupBy("doc_id").agg(F.sum("tf").alias("length"), listed)


def _best_of_shard(docs: pd.DataFrame, asked: pd.DataFrame, k: int, base: float, slope: float, k1: float) -> pd.DataFrame:
    """Of each question the documents of a shard that can be among its ``k`` first by rounded score and id, with raw scores; frequent terms are multiplied as a matrix."""
    none = pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "doc_id": docs["doc_id"].iloc[:0], "raw": np.zeros(0)})
    if not len(docs) or not len(asked):
        return none
    docs = docs.sort_values("doc_id", ignore_index=True)
    ids, n = docs["doc_id"].to_numpy(), len(docs)
    row = np.repeat(np.arange(n), docs["term_id"].map(len))
    terms, place = np.unique(np.concatenate(docs["term_id"].to_list()), return_inverse=True)
    tf = np.concatenate(docs["tf"].to_list())
    weight = tf / (tf + base + slope * docs["length"].to_numpy(dtype=float)[row])
    order = np.argsort(place, kind="stable")
    row, weight, starts = row[order], weight[order], np.searchsorted(place[order], np.arange(len(terms) + 1))
    common = np.flatnonzero(np.diff(starts) * 8 >= n)
    slot = np.full(len(terms), -1)
    slot[common] = np.arange(len(common))
    sizes, queries = asked["term_id"].map(len).to_numpy(), asked["query_id"].to_numpy()
    owner, term = np.repeat(np.arange(len(asked)), sizes), np.concatenate(asked["term_id"].to_list())
    value = np.concatenate(asked["most"].to_list()) * np.concatenate(asked["times"].to_list())
    bound = np.bincount(owner, value, len(asked))
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    there = terms[at] == term
    owner, at, value = owner[there], at[there], value[there]
    out = []
    for low in range(0, len(asked), 256):
        few = min(256, len(asked) - low)
        some = slice(*np.searchsorted(owner, [low, low + few]))
        scores = np.zeros((few, n))
        who, what, much = owner[some] - low, at[some], value[some]
        dense = slot[what]
        for c in range(0, len(common), 512):
            of = common[c : c + 512]
            here = (dense >= c) & (dense < c + 512)
            if here.any():
                a, m = np.zeros((few, len(of))), np.zeros((len(of), n))
                a[who[here], dense[here] - c] = much[here]
                for i, t in enumerate(of):
                    m[i, row[starts[t] : starts[t + 1]]] = weight[starts[t] : starts[t + 1]]
                scores += a @ m
        for w, t, v in zip(who[dense < 0], what[dense < 0], much[dense < 0], strict=True):
            scores[w, row[starts[t] : starts[t + 1]]] += v * weight[starts[t] : starts[t + 1]]
        for w in range(few):
            got = np.flatnonzero(scores[w])
            if len(got) > k:  # nothing that is two roundings below the kth here can come before it, whatever the best of all shards
                raw = scores[w, got]
                got = got[raw >= np.partition(raw, -k)[-k] - 2e-6 * bound[low + w]]
            raw = scores[w, got]
            if len(got) > k:  # of equal scores the first ids
                same = np.round(raw / bound[low + w], 12)
                by = np.lexsort((got, -same))
                new = np.r_[True, np.diff(same[by]) != 0]
                turn = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
                pick = by[turn < k]
                got, raw = got[pick], raw[pick]
            out.append((np.full(len(got), low + w), got, raw))
    who, got, raw = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"query_id": queries[who], "doc_id": ids[got], "raw": raw})


def rrf_fuse(lists: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None, constant: int = RRF_K, by: str = "query_id") -> DataFrame:
    """Sum of weight / (constant + rank) over a few lists, each with a document once a query; over the best, rounded to six places.

    The lists are joined on (query, document) rather than united: Spark 4.1 cannot place the partitions of a union of co-grouped lists.
    """
    weights = weights or [1.0] * len(lists)
    fused = None
    for n, (df, w) in enumerate(zip(lists, weights, strict=True)):
        part = df.select(by, "doc_id", (F.lit(float(w)) / (F.lit(constant) + F.col("rank"))).alias(f"part_{n}"))
        fused = part if fused is None else fused.join(part, [by, "doc_id"], "full")
    total = sum((F.coalesce(f"part_{n}", F.lit(0.0)) for n in range(1, len(lists))), F.coalesce("part_0", F.lit(0.0)))
    return _over_best(fused.select(by, "doc_id", total.alias("fused")), k, by)


def rrf_fuse_many(rows: DataFrame, k: int, constant: int = RRF_K, by: str = "query_id") -> DataFrame:
    """As R8 with weight 1 over any number of lists held in one table: rows (query, document, rank), one for each list a document is in."""
    fused = rows.groupBy(by, "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("fused"))
    return _over_best(fused, k, by)


def _over_best(fused: DataFrame, k: int, by: str) -> DataFrame:
    best = fused.groupBy(by).agg(F.max("fused").alias("top"))
    return ranked(fused.join(best, by).select(by, "doc_id", F.round(F.col("fused") / F.col("top"), 6).alias("score")), k, by)


def pool_size(k: int) -> int:
    """Candidates that each list gives to a fusion of ``k``."""
    return max(3 * k, 20)


def retrieve(mode: str, queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``dense``, ``bm25`` or ``hybrid`` search; ``queries`` has query_id, text and vector."""
    if mode == "dense":
        return dense_topk(queries, vectors, k)
    if mode == "bm25":
        return bm25_topk(queries, docs, k)
    if mode == "hybrid":
        return rrf_fuse([dense_topk(queries, vectors, pool_size(k)), bm25_topk(queries, docs, pool_size(k))], k)
    raise ValueError(f"mode {mode!r} is none of dense, bm25, hybrid")


def as_of_filter(rows: DataFrame, validity: DataFrame, strict: bool = False, repealed: Sequence[str] = ("REPEALED", "EXPIRED"), ahead: str = "FUTURE_ACTIVE") -> DataFrame:
    """Rows (query_id, doc_id, rank, as_of) whose document is in force on the row's date; ends included, a null bound or date is open.

    ``validity``: (doc_id, effective_from, effective_to, legal_status). ``strict`` also drops repealed documents. One that is not in force yet and has
    no known start is dropped. Ranks are given anew.
    """
    held = rows.join(validity.select("doc_id", "effective_from", "effective_to", "legal_status"), "doc_id", "left")
    day, start, end, status = (F.col(c) for c in ("as_of", "effective_from", "effective_to", "legal_status"))
    fine = F.coalesce(~((day < start) | (day > end)), day.isNull() | ((start.isNull() | (day >= start)) & (end.isNull() | (day <= end))))
    unknown = (status == ahead) & start.isNull() & day.isNotNull()
    keep = fine & ~F.coalesce(unknown, F.lit(False))
    if strict:
        keep = keep & ~F.coalesce(status.isin(*repealed), F.lit(False))
    turn = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "doc_id"))
    return held.filter(keep).withColumn("rank", turn).select(*rows.columns)


def rerank(candidates: DataFrame, k: int, drift: Sequence[tuple[Sequence[str], Sequence[str], float]] = (), weights: Sequence[float] = (0.35, 0.45, 0.20)) -> DataFrame:
    """Rows (query_id, doc_id, score, query, title, article, content), scored anew and cut to ``k``.

    0.35 title (0.4 for each phrase of the query in it, 1 at most, 0.95 at least if the query names the article) + 0.45 content (0.25 a phrase, 1 at
    most) + 0.20 score, less the largest penalty of a ``drift`` rule (words of the query, words of the text, penalty), within 0 and 1.
    """
    q, title, content = F.lower("query"), F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    runs = phrases(F.col("query"))
    hits = lambda text, weight: F.least(F.lit(1.0), once(text, lambda t: F.size(F.filter(runs, lambda p: t.contains(p)))) * F.lit(weight))
    named = F.array_contains(extract_references(F.col("query")), F.lower(F.coalesce("article", F.lit(""))))
    title_score = F.greatest(hits(title, 0.4), F.when(named, 0.95).otherwise(0.0))
    any_in = lambda text, words_: F.greatest(F.lit(False), *[text.contains(w) for w in words_])
    penalties = [F.when(any_in(q, a) & (any_in(content, b) | any_in(title, b)), p).otherwise(0.0) for a, b, p in drift]
    penalty = F.greatest(F.lit(0.0), *penalties) if penalties else F.lit(0.0)
    total = weights[0] * title_score + weights[1] * hits(content, 0.25) + weights[2] * F.col("score") - penalty
    scored = candidates.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))
    return ranked(scored, k).select("query_id", "doc_id", "score", "rank")


def relevance_gate(queries: DataFrame, candidates: DataFrame, least: float = 0.25, matched: int = 1, stop_words: Sequence[str] = INDEX_STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """(kept candidates, verdict of each query).

    A candidate (query_id, doc_id, score, query, title, article, content) stays if the query names its article, or they share ``matched`` keywords and either a
    pair of neighbouring keywords occurs in it or its score is ``least`` or more. Pairs follow the order of the query's words.
    """
    text = F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit(""))))
    asked = F.array_distinct(keywords(F.col("query"), stop_words))
    common = F.size(F.array_intersect(asked, keywords(text, stop_words)))
    pairs = F.zip_with(asked, F.slice(asked, F.lit(2), F.greatest(F.size(asked) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    pair = once(text, lambda t: F.exists(F.filter(pairs, lambda p: p.isNotNull()), lambda p: t.contains(p)))
    named = F.array_contains(extract_references(F.col("query")), F.lower(F.coalesce("article", F.lit(""))))
    kept = candidates.filter(named | ((common >= matched) & (pair | (F.col("score") >= least))))
    best = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.max("score"), 4).alias("confidence"))
    rows = queries.select("query_id").distinct().join(best, "query_id", "left")
    verdict = F.when(F.col("n_kept").isNull(), "INSUFFICIENT").when(F.col("confidence") >= 0.5, "RELEVANT").otherwise("AMBIGUOUS")
    return kept, rows.select("query_id", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), verdict.alias("verdict"))


def dedup_keep_best(rows: DataFrame, by: Sequence[str], score: str = "score", tie: str = "rank") -> DataFrame:
    """One row per key, that with the highest score."""
    return rows.withColumn("_turn", F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), tie))).filter("_turn = 1").drop("_turn")


def dedup_keep_first(rows: DataFrame, by: Sequence[str], rank: str = "rank") -> DataFrame:
    """One row per key, the first by rank."""
    return rows.withColumn("_turn", F.row_number().over(W.partitionBy(*by).orderBy(rank))).filter("_turn = 1").drop("_turn")


def retrieve_decomposed(sub_results: DataFrame, parents: DataFrame, per_part: int = 3) -> DataFrame:
    """The first ``per_part`` of every sub-query (sub_id, doc_id, score, rank), one row per document of the parent query, by score."""
    rows = sub_results.filter(F.col("rank") <= per_part).join(parents.select("sub_id", "query_id"), "sub_id")
    return ranked(dedup_keep_best(rows.select("query_id", "doc_id", "score", "rank"), ["query_id", "doc_id"]).drop("rank"))


def corrective_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of two graded passes (query_id, doc_id, score, status, relevant), the relevant rows of the second where its status is SUFFICIENT; both passes' relevant rows
    where it is PARTIAL; else those of the first where that is PARTIAL or better; else none.
    """
    status = second.groupBy("query_id").agg(F.max("status").alias("second"))
    a = first.join(status, "query_id", "left")
    from_second = second.filter("relevant AND status IN ('SUFFICIENT', 'PARTIAL')").select("query_id", "doc_id", "score")
    open_ = F.col("second").isNull() | (F.col("second") != "SUFFICIENT")
    from_first = a.filter(F.col("relevant") & open_ & (F.col("status") != "INSUFFICIENT")).select("query_id", "doc_id", "score")
    return ranked(from_second.unionByName(from_first).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")))


def improved_retrieval(version: str, queries: DataFrame, docs: DataFrame, k: int, expand=None, vectors: DataFrame | None = None, drift: Sequence[tuple[Sequence[str], Sequence[str], float]] = ()) -> DataFrame:
    """Versions of one pipeline. V0 dense (of ``vectors`` and a ``vector`` of the queries), V1 lexical, V2 lexical with expanded questions, V3 that re-ranked, V4 that behind the relevance gate.

    ``queries``: query_id, text; ``docs``: doc_id, text, and title and article if there are. Hybrid candidates are used from V2 on if vectors are given.
    """
    if version == "V0":
        return dense_topk(queries, vectors, k)
    asked = queries if version == "V1" or expand is None else queries.withColumn("text", expand(F.col("text")))
    pool = k if version in ("V1", "V2") else pool_size(k)
    found = bm25_topk(asked, docs, pool) if vectors is None or version == "V1" else retrieve("hybrid", asked, docs, vectors, pool)
    if version in ("V1", "V2"):
        return found
    extra = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("title", "article")]
    rows = found.join(docs.select("doc_id", F.col("text").alias("content"), *extra), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    best = rerank(rows, k, drift)
    if version == "V3":
        return best
    kept, _ = relevance_gate(queries, rows.drop("score", "rank").join(best, ["query_id", "doc_id"]))
    return ranked(kept.select("query_id", "doc_id", "score"), k)
