"""R6 as a stored index: positional postings in Parquet, by segments and buckets of terms.

Layout under one folder: ``postings/segment=k/bucket=b`` (doc_id, term, tf, length, places; sorted by term), ``lengths/segment=k`` (doc_id, length), ``removed`` (doc_id, before). Documents are cut
into terms once, when a segment is written; a search reads the buckets of its terms and no text. A document that is removed or written again stays in the files
of earlier segments and is left out by its row in ``removed``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import INDEX_STOP_WORDS, lower_words
from docketry.sources.scratch import new_folder, written

BUCKETS = 64


def placed_terms(docs: DataFrame, stop_words: Sequence[str] = INDEX_STOP_WORDS) -> DataFrame:
    """R5 as rows: (doc_id, place, term) of the words and the pairs of neighbours that are indexed; a document without any has one row of nulls.

    A row of words is exploded first and looked at one word and its neighbour at a time, so that the rules are compiled code. Partitioning by doc_id is kept.
    """
    words = docs.select("doc_id", lower_words(F.col("text")).alias("ws"))
    both = F.arrays_zip(F.col("ws").alias("w"), F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 1, F.lit(0))).alias("n"))
    rows = words.select("doc_id", F.posexplode_outer(both).alias("place", "x")).select("doc_id", "place", "x.w", "x.n")
    stopped = lambda c: F.col(c).isin(*stop_words)
    single = F.when((F.length("w") >= 2) & ~stopped("w"), F.col("w"))
    pair = F.when(F.col("n").isNotNull() & ~(stopped("w") & stopped("n")), F.concat("w", F.lit("_"), "n"))
    return rows.select("doc_id", "place", F.explode(F.array(single, pair)).alias("term")).filter("term IS NOT NULL OR place IS NULL OR place = 0")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    """A stored index; ``add`` and ``remove`` change what later reads see. One writer at a time."""

    spark: SparkSession
    path: str
    id_type: T.DataType
    buckets: int = BUCKETS
    stop_words: Sequence[str] = tuple(INDEX_STOP_WORDS)
    positional: bool = True

    @classmethod
    def create(cls, docs: DataFrame, path: str | None = None, buckets: int = BUCKETS, stop_words: Sequence[str] = INDEX_STOP_WORDS, positional: bool = True) -> LexicalIndex:
        """An index of ``docs`` (doc_id, text) in a new folder, by default under ``spark.checkpoint.dir``. Without ``positional`` places are null, which is enough for BM25."""
        index = cls(docs.sparkSession, path or new_folder(docs.sparkSession, "lexical-index"), docs.schema["doc_id"].dataType, buckets, tuple(stop_words), positional)
        index._write(docs, 0)
        return index

    def _write(self, docs: DataFrame, segment: int) -> None:
        docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").repartition("doc_id")
        rows = placed_terms(docs, self.stop_words)
        places = F.array_sort(F.collect_list("place")) if self.positional else F.lit(None).cast("array<int>")
        rows = rows.groupBy("doc_id", "term").agg(F.count("term").alias("tf"), places.alias("places"))
        size = F.sum("tf").over(_by_document())
        rows = rows.withColumns({"length": size, "bucket": F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"), self.buckets))})
        out = rows.filter("term IS NOT NULL OR length = 0").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id")
        out.write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        written = self.spark.read.schema(self._schema).parquet(f"{self.path}/postings/segment={segment}")
        written.groupBy("doc_id").agg(F.first("length").alias("length")).write.parquet(f"{self.path}/lengths/segment={segment}")

    @property
    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField("doc_id", self.id_type), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType())),
                             T.StructField("length", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("segment", T.IntegerType())])

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._removed()
        return rows if gone is None else rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["segment"] < gone["before"]), "left_anti")

    def _removed(self) -> DataFrame | None:
        if not self.exists("removed"):
            return None
        rows = self.spark.read.schema(T.StructType([T.StructField("doc_id", self.id_type), T.StructField("before", T.IntegerType())])).parquet(f"{self.path}/removed")
        return rows.groupBy("doc_id").agg(F.max("before").alias("before"))

    def exists(self, part: str = "lengths") -> bool:
        """Whether a part of the index is there; the folder may have been cleared."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def _next_segment(self) -> int:
        return self._all_lengths().agg(F.max("segment")).first()[0] + 1 if not self._all_lengths().isEmpty() else 1

    def _all_lengths(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([f for f in self._schema if f.name in ("doc_id", "length", "segment")])).parquet(f"{self.path}/lengths")

    def add(self, docs: DataFrame) -> None:
        """Index more ``docs`` (doc_id, text) as a new segment; those that are there already are replaced. Repeated rows of one id are one document."""
        segment = self._next_segment()
        self._drop(docs.select("doc_id"), segment)
        self._write(docs, segment)

    def remove(self, ids: DataFrame) -> None:
        """Leave out the documents of ``ids`` (doc_id)."""
        self._drop(ids.select("doc_id"), self._next_segment())

    def _drop(self, ids: DataFrame, before: int) -> None:
        ids.filter("doc_id IS NOT NULL").distinct().withColumn("before", F.lit(before)).write.mode("append").parquet(f"{self.path}/removed")

    def lengths(self) -> DataFrame:
        """(doc_id, length) of all documents, those without terms too."""
        return self._live(self._all_lengths()).select("doc_id", "length")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, tf, length, places); of distinct ``terms`` (term) only, if given: of those the buckets, at most ``buckets`` numbers, are collected to prune the scan."""
        rows = self.spark.read.schema(self._schema).parquet(f"{self.path}/postings").filter("bucket >= 0")
        if terms is not None:
            wanted = [r["b"] for r in terms.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(wanted)).join(terms.select("term"), "term", "left_semi")
        return self._live(rows).select("term", "doc_id", "tf", "length", "places")


def _by_document():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def phrase_hits(phrases: DataFrame, docs: DataFrame | LexicalIndex) -> DataFrame:
    """(query_id, phrase, doc_id, n): how often the words of each phrase stand one after the other in a document, by joins of neighbours in the positional postings.

    ``phrases``: (query_id, phrase), two words or more; ``docs``: a positional index, or a table (doc_id, text), of which only the places of the phrases' pairs are kept. Phrases of the same words are looked for once.
    A pair of two stop words is not indexed, so it is not looked for: a phrase of none but such pairs has no rows.
    """
    indexed = isinstance(docs, LexicalIndex)
    if indexed and not docs.positional:
        raise ValueError("the index holds no places")
    stop_words = docs.stop_words if indexed else INDEX_STOP_WORDS
    asked = written(phrases.select("query_id", "phrase", F.array_join(lower_words(F.col("phrase")), " ").alias("words")).distinct(), "phrases-asked")
    ws = F.split("words", " ")
    words = asked.select("words").distinct().filter(F.size(ws) >= 2)
    pairs = words.select("words", F.posexplode(F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("ahead", "p"))
    pairs = pairs.filter(~(F.col("p.a").isin(*stop_words) & F.col("p.b").isin(*stop_words))).select("words", "ahead", F.concat("p.a", F.lit("_"), "p.b").alias("term"))
    pairs = written(pairs, "phrases-pairs")
    needed = pairs.groupBy("words").agg(F.count(F.lit(1)).alias("needed"))
    wanted = pairs.select("term").distinct()
    if indexed:
        at = docs.postings(wanted).select("term", "doc_id", F.explode("places").alias("place"))
    else:
        rows = placed_terms(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), stop_words)
        at = written(rows.join(wanted, "term", "left_semi").select("term", "doc_id", "place"), "phrases-places")
    starts = pairs.join(at, "term").groupBy("words", "doc_id", (F.col("place") - F.col("ahead")).alias("start")).agg(F.count(F.lit(1)).alias("found"))
    whole = starts.join(needed, "words").filter("found = needed").groupBy("words", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(whole, "words").select("query_id", "phrase", "doc_id", "n")
