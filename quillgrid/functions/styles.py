"""Style runs of a paragraph as columns: array<struct<pos, id>>, each run holding up to the next one's place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.text import moved


def style_at(runs: Column, pos: Column) -> Column:
    """The id in force at a place; before the first run, the first run's."""
    before = F.filter(runs, lambda r: r["pos"] <= pos)
    return F.coalesce(F.get(before, F.size(before) - 1)["id"], F.get(runs, 0)["id"])


def styles_in(runs: Column, start: Column, end: Column) -> Column:
    """The distinct ids that [start, end) meets, in order."""
    inner = F.transform(F.filter(runs, lambda r: (r["pos"] > start) & (r["pos"] < end)), lambda r: r["id"])
    return F.when(start < end, F.array_distinct(F.concat(F.array(style_at(runs, start)), inner))).otherwise(F.array().cast("array<int>"))


def without_repeats(runs: Column) -> Column:
    """Runs without those that repeat the one before."""
    return F.filter(runs, lambda r, i: (i == 0) | (F.get(runs, i - 1)["id"] != r["id"]))


def restyled(runs: Column, start: Column, end: Column, new_id) -> Column:
    """Runs with ids of [start, end) replaced by ``new_id(id)``; the text after keeps its style."""
    run = lambda pos, id_: F.struct(pos.cast("int").alias("pos"), id_.cast("int").alias("id"))
    outside = F.filter(runs, lambda r: (r["pos"] < start) | (r["pos"] > end))
    inside = F.transform(F.filter(runs, lambda r: (r["pos"] > start) & (r["pos"] < end)), lambda r: run(r["pos"], new_id(r["id"])))
    edges = F.array(run(start, new_id(style_at(runs, start))), run(end, style_at(runs, end)))
    return F.when(start < end, without_repeats(F.array_sort(F.concat(F.transform(outside, lambda r: run(r["pos"], r["id"])), inside, edges)))).otherwise(runs)


def after_edit(runs: Column, start: Column, end: Column, length: Column) -> Column:
    """Runs after [start, end) was replaced by ``length`` characters; of runs that fall on one place the last stays."""
    shifted = F.transform(runs, lambda r: F.struct(F.when((r["pos"] > start) & (r["pos"] < end), start + length).otherwise(moved(r["pos"], start, end, length)).cast("int").alias("pos"), r["id"].alias("id")))
    return F.filter(shifted, lambda r, i: (i == F.size(shifted) - 1) | (F.get(shifted, i + 1)["pos"] != r["pos"]))
