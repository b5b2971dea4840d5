"""Changes saved once things are quiet: the last state of each burst, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_states(changes: DataFrame, keys: Sequence[str], at: str, state: str, pause: str, late: str | None = None) -> DataFrame:
    """(keys, since, at, state, n): of each key's changes that follow each other within ``pause``, when they began, the last one and how many.

    ``at`` is a timestamp, ``pause`` and ``late`` are durations ("500 milliseconds"). As a stream a burst is told once
    the watermark, the latest change seen less ``late``, has passed it by ``pause``; a change older than the
    watermark that joins no burst still open is dropped, and state is held for open bursts only. Of changes at the
    same time the greatest state is the last; rows without a time are passed over; null keys are a key.
    """
    timed = changes.where(F.col(at).isNotNull())
    if late is not None:
        timed = timed.withWatermark(at, late)
    last = F.max(F.struct(F.col(at).alias("at"), F.col(state).alias("state")))
    told = timed.groupBy(*keys, F.session_window(at, pause).alias("_burst")).agg(last.alias("_last"), F.count(F.lit(1)).alias("n"))
    return told.select(*keys, F.col("_burst.start").alias("since"), F.col("_last.at").alias("at"), F.col("_last.state").alias("state"), "n")


def start(changes: DataFrame, keys: Sequence[str], at: str, state: str, pause: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """The stream of ``session_states``, appended to Parquet files in ``out``; a restart goes on where it stopped."""
    told = session_states(changes, keys, at, state, pause, late)
    return told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
