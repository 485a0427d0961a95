"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which every executor can reach, with its file system's scheme.

    Where the setting is absent and the master is this machine alone (tests) it is set to a new temporary folder; on a cluster that is an error.
    Files stay for as long as results may be read; whoever ends the application clears the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that Spark hands to Python at a time; documents are long, so its default of 10,000 rows holds too much.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Python workers get small batches of texts, unless the session asks for smaller ones still."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        size = int(re.sub(r"[^0-9-]", "", now)) if now else -1
        if size <= 0 or size > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only (52 bits of an MD5)."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def hash_sample(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``.

    Rows are counted first and only those below a threshold that leaves a fifth more than ``most`` are sorted, so what meets in one task does not grow
    with the table.
    """
    total = rows.count()
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
    few = rows if total <= most else rows.filter(place < min(1.0, 1.2 * most / total))
    return few.orderBy(F.xxhash64(*key), *key).limit(most)


def new_column(docs: DataFrame, name: str) -> str:
    """``name``, if ``docs`` has no such column (in any case of letters); else an error, so that nothing is overwritten."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {name} already; give another name")
    return name


def held_out(id_col: Column) -> Column:
    """True for rows that no label may be learned from: crc32 of the id as text is a multiple of five."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
