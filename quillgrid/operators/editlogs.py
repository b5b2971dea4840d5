"""Logs of edits composed into maps of places.

A log's edits replace [start, end) by ``length`` characters, each in the text as the edits before it left it. Together they move the
places of the first text by a step function: a place at or past an edit's end moves by what it adds, one strictly
inside is lost, the others stay. Many places are then
looked up in it at once by an as-of join, where a fold would walk the log for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.operators.nesting import sorted_pass
from quillgrid.operators.sequences import asof

#: Before every place.
FIRST = -(1 << 62)


class Steps:
    """The step function of a log so far: from place ``at[i]`` on, places move by ``by[i]`` or, where ``lost[i]``, are gone."""

    def __init__(self) -> None:
        self.at, self.by, self.lost = np.array([FIRST]), np.zeros(1, np.int64), np.zeros(1, bool)

    def _cut(self, place: int) -> None:
        """A step wherever places come to be ``place``; after a deletion that may be in two."""
        stop = np.append(self.at[1:], -FIRST)
        k = np.flatnonzero(~self.lost & (self.at + self.by < place) & (stop + self.by > place))
        self.at, self.by, self.lost = np.insert(self.at, k + 1, place - self.by[k]), np.insert(self.by, k + 1, self.by[k]), np.insert(self.lost, k + 1, False)

    def edit(self, start: int, end: int, length: int) -> None:
        if end > start:
            self._cut(start + 1)
        self._cut(end)
        now = self.at + self.by
        live = ~self.lost
        self.lost |= live & (now > start) & (now < end)
        self.by[live & (now >= end)] += length - (end - start)

    def rows(self) -> list[tuple]:
        return [(a, None if x else b) for a, b, x in zip(self.at.tolist(), self.by.tolist(), self.lost.tolist())]


def composed(log: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start", end: str = "end", length: str = "length") -> DataFrame:
    """(keys, at, by): the step function of each key's log, ``by`` null where places are lost; one sorted pass.

    Edits with a null or with an end before their start are passed over. What a task holds is one key's steps.
    """

    def begin() -> tuple[Callable, Callable]:
        steps = Steps()

        def step(s: int | None, e: int | None, n: int | None) -> tuple:
            if None not in (s, e, n) and s <= e:
                steps.edit(s, e, n)
            return ()

        return step, steps.rows

    schema = T.StructType([*(T.StructField(k, log.schema[k].dataType) for k in keys), T.StructField("at", T.LongType()), T.StructField("by", T.LongType())])
    long = log.withColumns({c: F.col(c).cast("bigint") for c in (start, end, length)})
    return sorted_pass(long, keys, order, [start, end, length], begin, schema)


def mapped(places: DataFrame, steps: DataFrame, keys: Sequence[str], place: str, name: str = "moved") -> DataFrame:
    """``places`` with where each ``place`` has come to: null if it is lost; where it was, for keys without a log."""
    far = F.struct(F.lit(True).alias("known"), F.col("by"))
    found = asof(places, steps.select(*keys, F.col("at").alias(place), far.alias("_by"), F.lit(0).alias("_t")), keys, place, "_by", "_t")
    return found.withColumn(name, F.when(F.col("_by").isNull(), F.col(place)).otherwise(F.col(place) + F.col("_by.by"))).select(*places.columns, name)
