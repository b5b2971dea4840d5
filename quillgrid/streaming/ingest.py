"""Resumable ingest: arrivals against what is already known, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def digest(df: DataFrame, content: str = "text") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(content).cast("string"), 256))


def new_items(arrivals: DataFrame, manifest: DataFrame, id_column: str) -> DataFrame:
    """Arrivals whose id and content the manifest lacks; of equal contents that arrive together the least id."""
    fresh = digest(arrivals).join(manifest.select(id_column), id_column, "left_anti").join(manifest.select("sha256").distinct(), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min(id_column).alias(id_column))
    return fresh.join(first, ["sha256", id_column], "left_semi")


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A stream of arrivals, deduplicated by content over its whole life, appended to ``out``; restarts go on where it stopped."""
    kept = digest(stream).dropDuplicates(["sha256"])
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
