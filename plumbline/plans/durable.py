"""Results that later jobs read again, kept where every executor can reach them.

Cached blocks vanish with their executor and are then recomputed, possibly
with other range boundaries.  Multi-pass operators therefore write their
intermediate table to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder that everything this application writes sits below.

    ``spark.checkpoint.dir`` names it.  Only a session that runs in one process
    may leave that unset: a folder of one machine would lose rows on a cluster.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share (master is {master})")
        root = f"file:{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/plumbline/{spark.conf.get('spark.app.id', 'application')}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and return a DataFrame that reads it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Drop all that this application has written; DataFrames that read it end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
