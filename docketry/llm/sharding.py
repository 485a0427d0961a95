"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair draws a number from a hash; the shard with the least -ln(u)/weight wins. A new shard
takes rows only into itself and no row moves between the old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.shared import stash, table, text_bytes, uniform


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that holds ``key``; ties go to the smaller number, null is a key like any other."""
    draws = [F.struct((-F.log(uniform(key, F.lit(i))) / float(w)).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws)).getField("shard")


def assign_shards(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1). ``slot`` numbers the rows of a shard from 0 without
    gaps: rows are counted in ``buckets`` hash buckets of each shard, buckets get their offsets from the (at most
    shards x buckets) counts, and only a bucket's rows are sorted together. ``grown_shard`` is the shard with one
    more shard of weight ``added``. Repeated rows share a shard and get slots of their own; an empty table gives no rows.
    """
    key = F.col(id_col)
    payload = text_bytes(text_col)
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(payload) + 1).cast("long").alias("size"), F.crc32(payload).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, added]).alias("grown_shard"),
    )
    rows = stash(rows.withColumn("bucket", F.floor(uniform(F.col("doc_id"), F.col("size"), F.col("text_crc32")) * buckets).cast("int")), "shard-rows")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")) - 1
    numbered = rows.withColumn("within", within).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(({p})::VARCHAR, 'null')" for p in parts)
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


def _shard_sql(shards: int) -> str:
    costs = ", ".join(f"{{'cost': -ln({_draw_sql('doc_id', str(k))}), 'shard': {k}}}" for k in range(shards))
    return f"list_min([{costs}]).shard::INT"


# CRC-32 by its table: entry i is i divided by the polynomial, eight times; a byte at a time
ORACLE = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), b AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents
), c AS (
  SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, crc
), s AS (
  SELECT *, {_shard_sql(8)} AS shard, {_shard_sql(9)} AS grown_shard, floor({_draw_sql("doc_id", "size", "text_crc32")} * 1024)::INT AS bucket FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""
