"""Checks as one relation of problems (form_id, p, problem), and the gate that only lets old ones pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def increasing(places: Column, limit: Column) -> Column:
    """Whether an array starts at 0 or more, grows strictly and ends before ``limit``."""
    return F.forall(F.transform(places, lambda x, i: (x < limit) & F.when(i > 0, F.get(places, i - 1) < x).otherwise(x >= 0)), lambda ok: ok)


def non_decreasing(places: Column, limit: Column) -> Column:
    return F.forall(F.transform(places, lambda x, i: (x <= limit) & F.when(i > 0, F.get(places, i - 1) <= x).otherwise(x >= 0)), lambda ok: ok)


def paragraph_problems(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Problems of paragraphs (form_id, p, n_units, text_units, runs array<struct<pos, id>>, segments array<int>) with styles (form_id, id)."""
    place = F.transform("runs", lambda r: r["pos"])
    checks = {"length differs": F.col("n_units") != F.col("text_units"), "no style at the start": F.coalesce(F.get(place, 0) != 0, F.lit(True)), "style places": ~increasing(place, F.col("n_units")), "line places": ~non_decreasing(F.col("segments"), F.col("n_units"))}
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))
    own = paragraphs.select("form_id", "p", F.explode(found).alias("problem"))
    used = paragraphs.select("form_id", "p", F.explode("runs").alias("r")).select("form_id", "p", F.col("r.id").alias("id"))
    unknown = used.join(styles.select("form_id", "id"), ["form_id", "id"], "left_anti").select("form_id", "p", F.concat(F.lit("unknown style "), F.col("id").cast("string")).alias("problem"))
    return own.unionByName(unknown.distinct())


def new_problems(before: DataFrame, after: DataFrame) -> DataFrame:
    """Problems that were not there before, copies counted."""
    return after.exceptAll(before)


def tiling_problems(cells: DataFrame) -> DataFrame:
    """(form_id, t, problem) of tables whose cells overlap or leave their grid (form_id, t, row, col, row_span, col_span, rows, cols)."""
    out = cells.where((F.col("row") + F.col("row_span") > F.col("rows")) | (F.col("col") + F.col("col_span") > F.col("cols"))).select("form_id", "t", F.lit("a cell leaves the table").alias("problem")).distinct()
    place = cells.withColumn("r", F.explode(F.expr("sequence(row, row + row_span - 1)"))).withColumn("c", F.explode(F.expr("sequence(col, col + col_span - 1)")))
    twice = place.groupBy("form_id", "t", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form_id", "t", F.lit("cells overlap").alias("problem")).distinct()
    return out.unionByName(twice)
