"""Where intermediate tables go, and what may be broadcast."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most 16 bytes that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        try:
            spark.conf.set("spark.checkpoint.dir", named)
        except Exception:  # static in some versions: remember it on the session instead
            named = spark.__dict__.setdefault("_quillgrid_scratch", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/quillgrid-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillgrid_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_quillgrid_path", None):
            delete(df.sparkSession, path)


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows (counted; df should be settled), else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner, which works beside the queries, drop the shuffle files of plans that nothing refers to any more; called between phases."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
