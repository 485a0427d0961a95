"""Exact top-k search by inner product with MaxScore.

A vector is a bag of terms (dimension, sign). The postings of a term are cut into segments of its shard's rows; within a segment they are sorted by
impact (the size of the component), so a segment's first posting bounds the rest. For a query, the term of a dimension with the query's sign can only
raise a score; the term with the other sign can only lower it, so its bound is zero and it is never essential. For each segment the
dimensions are split at the threshold (the k-th best score so far): the longest tail of them whose bounds sum to less cannot lift a row to the
threshold alone and is non-essential. Rows in the essential postings are the candidates, and of a posting list only the part down to the
impact that could still matter is read; a candidate's other components are probed dimension by dimension, while its score so far plus the bounds still to come is
competitive. The threshold rises after every segment, and the split follows it. Shards are searched apart and their k best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.shared import stash, table

#: Vectors of a shard; queries that a shard meets in one task.
SHARD_ROWS, BLOCK_ROWS = 16_384, 65_536
#: Rows of the first and of the largest segment of the postings (each has twice the rows of the one before), and dimensions that are probed at a time.
FIRST_ROWS, SEGMENT_ROWS, STEP = 64, 4096, 8
#: Sums of floats are those of integers below this.
EXACT = 2**53


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector is null or has a null, NaN or infinite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Shard:
    """Postings of one shard: in each segment of rows, for each (dimension, sign) the rows by falling impact.

    ``read`` counts the postings that searches traversed and ``probed`` the components that they looked up besides.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segment_rows: int = SEGMENT_ROWS) -> None:
        # rows with large components first: the threshold is high early, and later segments have low bounds
        order = np.lexsort((ids, -np.abs(vectors).max(1, initial=0)))
        self.ids, vectors = ids[order], vectors[order]
        self.segments = []
        at = 0
        while at < len(ids):
            part = vectors[at : at + min(segment_rows, max(at, FIRST_ROWS))]
            postings = {}
            for d in range(part.shape[1]):
                by_impact = np.argsort(-part[:, d], kind="stable")
                up, down = int(np.count_nonzero(part[:, d] > 0)), int(np.count_nonzero(part[:, d] < 0))
                for sign, rows in ((1, by_impact[:up]), (-1, by_impact[len(part) - down :][::-1])):
                    postings[d, sign] = rows, np.abs(part[rows, d])
            self.segments.append((at, np.ascontiguousarray(part.T), postings, np.maximum(part.max(0), 0), np.minimum(part.min(0), 0)))
            at += len(part)
        self.read = self.probed = 0

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, without those whose id is ``own``; ties go to the smaller id."""
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        for at, columns, postings, largest, least in self.segments:
            threshold = best[-1] if len(best) == k else -math.inf  # equal scores stay in, for ties
            bounds = np.where(query > 0, query * largest, query * least)
            terms = np.argsort(-bounds, kind="stable")
            if (np.abs(query) * np.maximum(largest, -least)).sum() >= EXACT:
                raise OverflowError("components are too large for exact scores")
            left = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0.0)
            if left[0] < threshold:
                continue
            ids = self.ids[at : at + columns.shape[1]]
            # with no positive threshold every row is a candidate, for it may be in no posting of the query's sign
            essential = int(np.count_nonzero(left[:-1] >= threshold)) if threshold > 0 else 0
            if essential:
                there = np.zeros(len(ids), bool)
                for t in terms[:essential]:
                    rows, impact = postings[int(t), 1 if query[t] > 0 else -1]
                    # a row below this impact in every essential list stays under the threshold
                    enough = self.least_impact(query, t, bounds, left, essential, threshold)
                    some = rows[: np.searchsorted(-impact, -enough, "right")]
                    self.read += len(some)
                    there[some] = True
                rows = np.flatnonzero(there & (ids != own))
            else:
                rows = np.flatnonzero(ids != own)
            score, done = np.zeros(len(rows)), 0
            while done < len(terms) and len(rows):
                block = terms[done : done + STEP]
                if 4 * len(rows) > len(ids):  # most rows are left: whole columns are read faster than chosen components
                    score = score + (query[block] @ columns[block])[rows]
                    self.probed += len(ids) * len(block)
                else:
                    score = score + query[block] @ columns[block[:, None], rows]
                    self.probed += len(rows) * len(block)
                done += len(block)
                keep = score + left[done] >= threshold
                if not keep.all():
                    rows, score = rows[keep], score[keep]
            if len(rows):
                best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, score])
                if len(best) > 8 * k:  # the k-th best and all that equal it or are better
                    few = best >= np.partition(best, -k)[-k]
                    best_ids, best = best_ids[few], best[few]
                first = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[first], best[first]
        return best_ids, best

    @staticmethod
    def least_impact(query: np.ndarray, term: int, bounds: np.ndarray, left: np.ndarray, essential: int, threshold: float) -> float:
        """Impact from which on a posting of ``term`` makes a row a candidate.

        The slack between the threshold and the bounds of the non-essential terms is dealt to the essential ones by their bounds: a row whose impact is below its part
        in all of them scores less than the threshold.
        """
        slack = threshold - left[essential]
        total = left[0] - left[essential]
        return slack * bounds[term] / total / abs(query[term]) if total > 0 and query[term] else 0.0


def search_shards(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, vec_id, score) of the k best of every shard, for tables of (id, vector of long) without nulls.

    A task holds the vectors of one shard, about ``shard_rows``, and its queries stream past it in batches. Vectors are copied once
    for every ``block_rows`` queries, so that a shard's queries may be dealt to several tasks.
    """
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    part = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("id", "vector", part(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"))
    right = queries.select("id", "vector", every(shards).alias("shard"), part(blocks).alias("block"), F.lit(True).alias("asks"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = shard = None
        for pdf in batches:
            cuts = np.flatnonzero(np.r_[True, (pdf["shard"].to_numpy()[1:] != pdf["shard"].to_numpy()[:-1]) | (pdf["block"].to_numpy()[1:] != pdf["block"].to_numpy()[:-1])][: len(pdf)])
            out: list[tuple[int, int, int]] = []
            for at, to in zip(cuts, np.r_[cuts[1:], len(pdf)], strict=True):
                some = pdf.iloc[at:to]
                if (now := (some["shard"].iloc[0], some["block"].iloc[0])) != key:
                    key, held, shard = now, [], None
                own, asked = some[~some["asks"]], some[some["asks"]]
                if len(own):
                    held.append(own)
                if len(asked) and held:
                    if shard is None:
                        own = pd.concat(held)
                        shard, held = Shard(own["id"].to_numpy(), np.stack(own["vector"].to_numpy()).astype(np.float64)), held[:1]
                    for query_id, query in zip(asked["id"], asked["vector"], strict=True):
                        ids, scores = shard.search(np.asarray(query, dtype=np.float64), query_id, k)
                        out.extend((query_id, i, int(s)) for i, s in zip(ids, scores, strict=True))
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, shards * blocks))
    dealt = left.unionByName(right).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", "asks")
    return dealt.mapInPandas(search, "query_id long, vec_id long, score long")


def maxscore_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with the rows of other ids.

    Components are integers; where sums of their products could reach 2**53 and lose digits, a search raises OverflowError. Rows with a null id or vector take no part, nor do vectors of another length than most rows of ``vectors``
    have (of equally frequent lengths the greatest counts); repeated rows with one id
    count once each, with their rank by score and then id; a table of fewer than k others gives them all, empty
    tables give no rows. Other columns are not read, whatever their names.
    """
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).dropna()
    own = rows(vectors)
    usual = own.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    fits = F.size("vector") == (usual["length"] if usual else 0)
    found = search_shards(own.filter(fits), rows(queries).filter(fits), k, **options)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("vector"))
    vectors = stash(vectors, "maxscore-vectors")
    return maxscore_topk(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5
"""
