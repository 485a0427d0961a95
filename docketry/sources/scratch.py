"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which every executor can reach, with its file system's scheme.

    Where the setting is absent and the master is this machine alone (tests) it is set to a new temporary folder; on a cluster that is an error.
    Files stay for as long as results may be read; :func:`clear` removes them all.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/docketry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder and read back: it is computed once, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has written by :func:`new_folder`; tables and indexes read from there are gone with it."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/docketry-{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
