"""Note Q: exact order statistics by ranges, so that no task sorts a whole group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.sources.scratch import written


def counted_ranges(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(*by, v, c, part): how often each value occurs in its group, dealt by ranges of (group, value) and written; ``part`` numbers the ranges in order. Null values are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return written(counts.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()), "quantile-ranges")


def values_at(ranges: DataFrame, by: Sequence[str], places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(*by, n, and a column for each of ``places``): the value at a place, from 0, of the group's sorted values; a place is a function of their number n.

    Ranges are summed first, a row for each group and range; a running sum over those few rows tells which range holds a place, and only the values of such ranges are added up, each range on its own.
    """
    parts = ranges.groupBy(*by, "part").agg(F.sum("c").alias("s"))
    group = W.partitionBy(*by)
    parts = parts.withColumns({"ahead": F.sum("s").over(group.orderBy("part")) - F.col("s"), "n": F.sum("s").over(group)})
    wanted = parts.select(*by, "part", "ahead", "s", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p(F.col("n")).cast("long").alias("place")) for k, p in places.items()])).alias("w"))
    wanted = written(wanted.select(*by, "part", "ahead", "s", "n", "w.*").filter("place >= ahead AND place < ahead + s"), "quantile-places")
    there = wanted.select(*[F.col(c).alias(f"_{c}") for c in (*by, "part", "ahead", "name", "place", "n")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("part") == F.col("_part"))
    held = ranges.join(there.select(*[f"_{c}" for c in (*by, "part")]).distinct(), same, "left_semi")
    upto = F.sum("c").over(W.partitionBy(*by, "part").orderBy("v"))
    found = held.withColumn("upto", upto).join(there, same).filter("_ahead + upto > _place AND _ahead + upto - c <= _place")
    return found.groupBy(*by).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_name") == k, F.col("v"))).alias(k) for k in places])


def index_quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Note Q: values at place min(floor(share x n), n - 1) of each group's sorted values, exact."""
    at = {name: (lambda n, q=q: F.least(F.floor(F.lit(q) * n), n - 1)) for name, q in shares.items()}
    return values_at(counted_ranges(rows, by, value), by, at).drop("n")


def profile(rows: DataFrame, by: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """(*by, n, mean, median, p95, least, most, share) of each group; the median is the mean of the two middle values, P95 the element at min(floor(0.95 n), n - 1)."""
    ranges = counted_ranges(rows, by, value)
    at = values_at(ranges, by, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2), "p95": lambda n: F.least(F.floor(F.lit(share) * n), n - 1)})
    sums = ranges.groupBy(*by).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], "mean", "least", "most")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    total = ranges.agg(F.sum("c").alias("_total"))
    out = at.join(sums, same).join(F.broadcast(total), F.lit(True))  # total is one row
    return out.select(*by, "n", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95", "least", "most", (F.col("n") / F.col("_total")).alias("share"))
