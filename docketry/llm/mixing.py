"""Mixing sources to target weights.

Tokens are summed per source, a repetition rate is derived for each source, and every document is
emitted floor(rate) times plus one more copy with probability equal to the fraction, drawn from a
hash of the seed and the document's id, so that reruns agree. Of a fixed number of seeds each source takes the one whose draws
bring its words nearest to its target (ties: the smallest seed); the words are summed per source and seed from sizes and ids alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.shared import stash, table, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: A table of per-source rates of up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Seeds that a source chooses from.
SEEDS = 64


def word_count(text: str | Column) -> Column:
    """Words separated by ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Target size of each source.

    ``sizes`` has ``source`` and ``size``. Sources in code-point order, null last, take the weights in turn and
    share the total of all sizes. A target stops at ``max_repeat`` times its source's size; the excess goes to
    the others by weight until none is above (water filling: with the sources in order of cap/weight, the capped
    ones are a prefix). An empty table gives no rows; a source of size 0 gets target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_repeat)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()),
        "before": F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"),
        "rest": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    per = per.withColumn("capped", F.col("cap").cast("double") <= F.col("weight") * ((F.col("total") - F.col("before")) / F.col("rest")))
    left = F.max("total").over(W.partitionBy()) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(W.partitionBy()), F.lit(0))
    weight_left = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(W.partitionBy())
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (left / weight_left))
    return per.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    seeds: int = SEEDS,
    broadcast_sources: int = BROADCAST_SOURCES,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, and the columns named in ``keep``.

    Null texts have size 0; a null source is a source of its own; rows with a null id share one draw, as do
    repeated rows. Other columns of ``docs`` are not read, whatever their names. An empty table gives no rows.
    """
    size = word_count(text_col) if size is None else size
    rows = docs.select(F.struct(F.col(id_col), *[F.col(c) for c in keep]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    light = stash(rows.select("id", "source", "size"), "mix-sizes")  # a few bytes a row
    if not keep:
        rows = light.withColumn("row", F.struct(F.col("id").alias(id_col)))
    targets = stash(source_targets(light, weights, max_repeat), "mix-targets").withColumnRenamed("source", "of")
    small = targets.count() <= broadcast_sources
    of_source = lambda df, per: df.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    copies = F.floor(rate) + F.when(uniform(F.col("seed"), F.col("id")) < rate - F.floor(rate), 1).otherwise(0)
    tried = of_source(light, targets).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    sums = tried.groupBy("of", "seed", "target").agg(F.sum(F.col("size") * copies).alias("taken"))
    best = sums.groupBy("of").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("target")).alias("off"), "seed")).getField("seed").alias("seed"))
    targets = targets.join(best.withColumnRenamed("of", "with"), F.col("of").eqNullSafe(F.col("with"))).drop("with")
    joined = of_source(rows, stash(targets, "mix-seeds"))
    return joined.select("row.*", "size", "source_size", "target", copies.cast("int").alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` with all its columns, as often as its copies say."""
    columns = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(options.get("id_col", "doc_id")), F.col(options.get("source_col", "source")), F.col(options.get("text_col", "text")))
    mixed = mix(own, keep=["_doc"], **options)
    mixed = mixed.filter("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select("_doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), c AS (
  SELECT *, source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS total,
         (sum(source_size * 3) OVER o)::BIGINT - source_size * 3 AS before,
         sum(weight) OVER (ORDER BY source_size * 3 / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS rest
  FROM per WINDOW o AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), d AS (
  SELECT *, cap::DOUBLE <= weight * ((total - before) / rest) AS capped FROM c
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (
      (total - coalesce((sum(cap) FILTER (capped) OVER ())::BIGINT, 0)) / sum(weight) FILTER (NOT capped) OVER ()) END AS target
  FROM d
), rated AS (
  SELECT doc_id, sized.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), drawn AS (
  SELECT *, (('0x' || substr(md5(seed::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM rated, (SELECT unnest(range(64)) AS seed)
), copied AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies FROM drawn),
best AS (
  SELECT source, arg_min(seed, (off, seed)) AS seed FROM (
    SELECT source, seed, abs(sum(size * copies)::BIGINT - any_value(target)) AS off FROM copied GROUP BY source, seed)
  GROUP BY source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied JOIN best ON copied.seed = best.seed AND copied.source IS NOT DISTINCT FROM best.source
"""
