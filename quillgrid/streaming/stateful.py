"""State by key: how many of a key were taken, and logs of edits that places are carried through; each as a stream and in batch."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


class _Cap(StatefulProcessor):
    """Takes the first rows of a key until ``cap`` were taken, over all batches."""

    def __init__(self, columns: list[str], order: list[str], cap: int, forget_after: int | None):
        self.columns, self.order, self.cap, self.forget_after = columns, order, cap, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long", self.forget_after)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        # At most ``cap`` rows are held, whatever a batch brings of a key.
        place = lambda r: tuple((r[c] is not None, r[c]) for c in self.order)
        first = heapq.nsmallest(max(0, self.cap - taken), rows, key=place)
        if first:
            self.taken.update((taken + len(first),))
        for r in first:
            yield Row(**{c: r[c] for c in self.columns})

    def close(self) -> None:
        pass


def capped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """In batch: the first ``cap`` rows of each key by ``order`` (nulls first, which should tell rows apart)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def capped_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int, forget_after: int | None = None) -> DataFrame:
    """As a stream: rows of each key as they arrive, within a batch by ``order``, until ``cap`` of the key were taken in all.

    State is one number for each key seen; ``forget_after`` (milliseconds since the last one taken) lets it go, and
    the key starts anew. Needs RocksDB as state store (see ``start``).
    """
    processor = _Cap(stream.columns, list(order), cap, forget_after)
    mode = "ProcessingTime" if forget_after else "None"
    return stream.groupBy(*keys).transformWithState(processor, StructType(stream.schema.fields), "Append", mode)


class _Places(StatefulProcessor):
    """Keeps a key's edits in order; places are carried through those made so far."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edits = handle.getListState("edits", "start long, stop long, length long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        log = [tuple(e) for e in self.edits.get()] if self.edits.exists() else []
        known = len(log)
        for r in sorted(rows, key=lambda r: (r["at"], r["place"] is not None)):
            if r["place"] is None:
                if r["start"] is not None and r["stop"] is not None:
                    log.append((r["start"], r["stop"], r["length"] or 0))
                continue
            moved = r["place"]
            for start, stop, length in log:
                if moved >= stop:
                    moved += length - (stop - start)
                elif moved > start:
                    moved = None
                    break
            yield Row(**dict(zip(self.keys, key)), at=r["at"], place=r["place"], moved=moved)
        if log[known:]:
            self.edits.appendList(log[known:])

    def close(self) -> None:
        pass


def places_stream(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., at, place, moved) of a stream of edits and places (keys..., at, start, stop, length, place).

    A row without a place is an edit: [start, stop) was replaced by ``length`` characters. One with a place asks where
    it is after the edits of its key so far, of earlier batches and, by ``at``, of this one; null where an edit
    took it away. State is the log of each key, which grows with its edits; edits without bounds are passed over.
    """
    kept = [f for f in stream.schema.fields if f.name in keys]
    out = StructType(kept).add("at", stream.schema["at"].dataType).add("place", "long").add("moved", "long")
    return stream.groupBy(*keys).transformWithState(_Places(list(keys)), out, "Append", "None")


def start(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A stream with state of its own, appended to Parquet files in ``out``; a restart goes on with the state it had."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
