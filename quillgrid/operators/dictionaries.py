"""Dictionaries that grow: dense numbers without one task for a key, entries found or added, runs given a variant of their style."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.stages import few, written


def _alike(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """``a`` joined with ``b`` on equal ``columns``, nulls alike; of ``columns`` only a's stay."""
    named = b.withColumnsRenamed({c: f"_b_{c}" for c in columns})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in columns))
    return a.join(named, same, how).drop(*(f"_b_{c}" for c in columns))


def dense_numbers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """``rows`` numbered from 0 within each key by ``order``, gapless, however many rows a key has.

    Rows are dealt by ranges of (keys, order) and written once, so that a range keeps its rows when a task is
    run again; a number is the place within the range plus the rows of the key in earlier ranges. Only counts,
    one for each key and range, are brought together. Null keys are a key; rows alike in keys and order are
    numbered in any order.
    """
    keys, order = list(keys), list(order)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    numbered = _alike(placed.withColumn("_here", here), before, [*keys, "_range"], "inner")
    return numbered.withColumn(name, (F.col("_before") + F.col("_here")).cast("bigint")).drop("_before", "_here", "_range")


def upserted(entries: DataFrame, wanted: DataFrame, keys: Sequence[str], attributes: Sequence[str], order: Sequence[str], number: str = "id") -> tuple[DataFrame, DataFrame]:
    """The dictionary with what is ``wanted`` and was missing, and the number of each wanted entry.

    ``entries`` has (keys, number, attributes), ``wanted`` (keys, order, attributes). The first result has the rows of
    ``entries`` and one more for each missing entry, numbered on from the key's greatest number in the order they
    are first wanted; numbers in use stay. The second has (keys, attributes, number, fresh) for each distinct
    wanted entry; of equal entries that exist the least number is taken. Nulls are values like others; a key
    without entries starts at 0.
    """
    keys, attributes, order = list(keys), list(attributes), list(order)
    what = [*keys, *attributes]
    asked = wanted.groupBy(*what).agg(F.min(F.struct(*order)).alias("_first"))
    known = entries.groupBy(*what).agg(F.min(number).alias(number))
    met = written(_alike(asked, known, what, "left"), "upsert")
    firsts = met.where(F.col(number).isNull()).drop(number).select(*what, "_first")
    top = entries.groupBy(*keys).agg(F.max(number).alias("_top"))
    numbered = _alike(dense_numbers(firsts, keys, ["_first"], "_more"), top, keys, "left")
    fresh = numbered.select(*what, (F.coalesce(F.col("_top") + 1, F.lit(0)) + F.col("_more")).cast(entries.schema[number].dataType).alias(number))
    fresh = written(fresh, "fresh")
    columns = [*keys, number, *attributes]
    answers = met.where(F.col(number).isNotNull()).select(*what, number, F.lit(False).alias("fresh")).unionByName(fresh.withColumn("fresh", F.lit(True)))
    return entries.select(*columns).unionByName(fresh.select(*columns)), answers


def marked_out(colour: Column) -> Column:
    """Whether a colour (#rrggbb, # optional) marks text out: neither near black nor near white; other texts and nulls do not."""
    hexed = F.lower(F.regexp_extract(colour, "^#?([0-9a-fA-F]{6})$", 1))
    part = lambda i: F.conv(F.substring(hexed, i, 2), 16, 10).cast("int")
    r, g, b = part(1), part(3), part(5)
    return F.coalesce((hexed != "") & (F.greatest(r, g, b) > 0x40) & (F.least(r, g, b) < 0xD0), F.lit(False))


def recoloured(runs: DataFrame, written_ranges: DataFrame, styles: DataFrame, keys: Sequence[str], attributes: Sequence[str], colour: str = "colour", black: str = "#000000") -> tuple[DataFrame, DataFrame]:
    """Text in ``written_ranges`` turned black: (styles with the black variants that were missing, runs that refer to them).

    ``runs`` has (keys, p, start, end, id), ``written_ranges`` (keys, p, start, end), ``styles`` (keys, id, attributes) with ``colour``
    among the attributes. Runs are cut at the ranges' bounds; within them a style whose colour marks text out is
    replaced by the one that differs in the colour alone, found or added in the order of place. Ranges of a
    paragraph may overlap; empty ones and ids that no style has change nothing.
    """
    keys, attributes = list(keys), list(attributes)
    place, style = ["p", *keys], ["id", *keys]  # what tells most rows apart comes first: joins and groups sort by it
    loud = styles.where(marked_out(F.col(colour))).select(*keys, "id", *attributes)
    hinted = F.broadcast if few(loud) else lambda df: df  # for what has at most a row for each loud style
    # The bounds of a paragraph's ranges cut it into stretches (a null bound is open), worked out once for all of its runs.
    bound = written_ranges.where("start < end").groupBy(*place).agg(F.collect_set(F.struct("start", "end")).alias("_ranges"))
    cuts = F.sort_array(F.array_distinct(F.flatten(F.transform("_ranges", lambda r: F.array(r["start"], r["end"])))))
    within = lambda a, b: F.coalesce(F.exists("_ranges", lambda r: (r["start"] <= a) & (r["end"] >= b)), F.lit(False))
    open_ = F.array(F.lit(None).cast(written_ranges.schema["start"].dataType))
    stretches = F.zip_with(F.concat(open_, "_cuts"), F.concat("_cuts", open_), lambda a, b: F.struct(a.alias("_from"), b.alias("_to"), within(a, b).alias("over")))
    bound = bound.withColumn("_cuts", cuts).select(*place, stretches.alias("_stretches"))
    met = _alike(runs.where("start < end"), bound, place, "left").select(*place, "start", "end", "id", F.inline_outer("_stretches"))
    pieces = met.select(*place, "id", F.greatest("start", "_from").alias("start"), F.least("end", "_to").alias("end"), F.coalesce("over", F.lit(False)).alias("over"))
    pieces = written(pieces.where("start < end"), "pieces")
    # A loud style's first place by its least paragraph (null before all) and then the least start there: plain minima, for which nothing is sorted.
    over = pieces.where("over")
    least = over.groupBy(*style).agg(F.min("p").alias("_p"), F.count("p").alias("_told"), F.count(F.lit(1)).alias("_all"))
    least = _alike(least.select(*style, F.when(F.col("_told") == F.col("_all"), F.col("_p")).alias("p")), hinted(loud), style, "left_semi")
    first = _alike(over, hinted(least), [*style, "p"], "inner").groupBy(*style, "p").agg(F.min("start").alias("start"))
    wanted = _alike(first, hinted(loud), style, "inner").withColumn(colour, F.lit(black))
    grown, answers = upserted(styles, wanted, keys, attributes, ["p", "start"])
    variants = _alike(loud.withColumn(colour, F.lit(black)), answers.withColumnRenamed("id", "_black"), [*keys, *attributes], "inner").select(*keys, "id", "_black")
    variants = hinted(variants)
    changed = _alike(over, variants, style, "left").withColumn("id", F.coalesce("_black", "id")).drop("_black")
    return grown, changed.unionByName(pieces.where("not over")).select(*keys, "p", "start", "end", "id")
