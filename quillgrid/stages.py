"""Intermediate tables of iterative operators: written to the shared folder, so that lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dictionary (a few short attributes each) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one, on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quillgrid_shared", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        spark._quillgrid_shared = named
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back."""
    path = f"{shared_folder(df.sparkSession)}/quillgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillgrid_written = path
    return out


def deleted(*frames: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_quillgrid_written", None):
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most ``rows`` rows (counted up to there; df should be written or cheap)."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else df as it is."""
    return F.broadcast(df) if few(df, rows) else df
