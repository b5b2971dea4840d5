"""Ordered-row operators: runs, islands, as-of and interval joins. Every window is partitioned by the caller's keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.stages import deleted, written


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], new: Column, name: str = "island") -> DataFrame:
    """``df`` numbered from 1 by runs; ``new`` tells where a run begins and may look back with lag over (keys, order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum(F.coalesce("_new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_islands(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap: float) -> DataFrame:
    """Runs whose neighbours along ``at`` are at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return islands(df, keys, (at, tie), F.col(at) - F.lag(at).over(w) > gap)


def value_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(df, keys, order, F.lag(value).over(w) != F.col(value), "run")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, reset: Column, name: str) -> DataFrame:
    """``df`` with the last ``value`` so far that is not null, forgotten at rows that ``reset``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.withColumns({"_part": F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w), "_own": value})
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn(name, F.last("_own", ignorenulls=True).over(own)).drop("_part", "_own")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row at or before ``at`` (ties: greatest ``tie``): one union and one window, no range join."""
    cols = [*keys, at]
    r = right.select(*cols, F.col(value).alias("_v"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"))
    rest = [c for c in left.columns if c not in cols]
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1), "_tie": F.lit(None).cast("bigint")}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_got", F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w)).where("_side = 1").select(*cols, *rest, F.col("_got").alias(value))


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of ``a`` (keys, start, end, ...) and ``b`` (keys, lo, hi, ...) that overlap, by an equi join on buckets of ``width``.

    ``how`` is inner, left_semi or left_anti. An interval is posted in each bucket it touches; a pair is
    taken where the later of the two starts lies, so that it is met once.
    """
    bucket = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / width)))
    if how == "inner":
        x, y = a.withColumn("_b", bucket("start", "end")), b.withColumn("_b", bucket("lo", "hi"))
        got = x.join(y, [*keys, "_b"]).where((F.col("start") < F.col("hi")) & (F.col("lo") < F.col("end")))
        return got.where(F.floor(F.greatest("start", "lo") / width) == F.col("_b")).drop("_b")
    a = a.withColumn("_row", F.struct(*a.columns))
    met = overlaps(a, b, keys, width).select("_row").distinct()
    return a.join(met, "_row", how).drop("_row")


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Touching or overlapping intervals united."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(df, keys, (start, end), F.col(start) > top).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def repeat_islands(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "island") -> DataFrame:
    """``df`` numbered from 1 by runs that end before a value that the run already has; ``order`` values are whole numbers, one for each row of a key.

    No lag sees it, as a run's start decides. From each row the next run would start at the least place from here on
    that has the value of an earlier place from here on (a window from the end); the starts of runs are what the
    first row reaches by these jumps, found by doubling them: rounds grow with the logarithm of a key's runs.
    A null value is one like any other; rows with a null key are left in the first run.
    """
    keys = list(keys)
    again = F.lead(order).over(Window.partitionBy(*keys, value).orderBy(order))
    onward = Window.partitionBy(*keys).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    jumps = df.select(*keys, F.col(order).alias("_at"), again.alias("_again")).withColumn("_to", F.min("_again").over(onward)).drop("_again")
    jumps = written(jumps, "jumps")
    starts = written(jumps.groupBy(*keys).agg(F.min("_at").alias("_at")), "starts")
    jumps_now = jumps
    while True:
        new = starts.join(jumps_now.where("_to is not null"), [*keys, "_at"]).select(*keys, F.col("_to").alias("_at"))
        if new.isEmpty():
            break
        more = written(starts.unionByName(new).distinct(), "starts")
        ahead = jumps_now.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_then"))
        further = written(jumps_now.where("_to is not null").join(ahead, [*keys, "_to"]).select(*keys, "_at", F.col("_then").alias("_to")), "jumps")
        deleted(starts, jumps_now)
        starts, jumps_now = more, further
    marked = starts.select(*keys, F.col("_at").alias(order), F.lit(1).alias("_start"))
    sofar = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(marked, [*keys, order], "left").withColumn(name, F.sum(F.coalesce("_start", F.lit(0))).over(sofar)).drop("_start")
