"""Outlines of paragraphs: text cut where its look changes, with the blanks that lie in it, as one ordered relation.

Starts and ends of units, styles and marks are put in one order (an event sweep); the state between two neighbouring events
(unit, style, how far marks cover) is carried by windows, and stretches that look alike and touch are merged back.
Work grows with the events of a paragraph, not with its characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgrid.functions.text import is_coloured


def segments(paragraphs: DataFrame, units: DataFrame, styles: DataFrame, looks: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ord, kind, text, bold, color, slot, option, start, end): what each paragraph shows, in order from 0.

    ``paragraphs`` (keys, last, tables, holds): where it ends, how many tables are anchored in it, whether it can hold text;
    ``units`` (keys, pos, end, text): stretches of text, and tabs (text null) of any width; what no unit covers shows nothing;
    ``styles`` (keys, pos, style): the style from a place on; ``looks`` (style, bold, color) describes them;
    ``marks`` (keys, start, end, slot, option): blanks, which hide the text that they cover and stand where they start, by end
    where starts are the same.

    Kinds are text, tab, slot, and for a paragraph with nothing in it that can hold text and has no table, one empty
    text at its end. Neighbours join where they touch, are equally bold, equally coloured (near black and near
    white count as no colour), and no mark starts between. Text before the first style has no look. Places are code points.
    Empty units show nothing; of styles given twice for a place the greatest counts; a style without a look has none.
    """
    keys = list(keys)
    none = lambda kind: F.lit(None).cast(kind)
    style_type = styles.schema["style"].dataType.simpleString()
    unit_type = "struct<pos:bigint,end:bigint,text:string,tab:boolean>"
    unit = F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("end").cast("bigint").alias("end"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("tab"))
    solid = units.where("end > pos")
    at = lambda df, pos, u=None, s=None, m=None, begins=False: df.select(*keys, F.col(pos).cast("bigint").alias("at"), (u if u is not None else none(unit_type)).alias("unit"), (s if s is not None else none(style_type)).alias("style"), (m if m is not None else none("bigint")).alias("cover"), F.lit(begins).alias("begins"))
    events = at(solid, "pos", u=unit).unionByName(at(solid, "end")).unionByName(at(styles, "pos", s=F.col("style")))
    events = events.unionByName(at(marks, "start", m=F.col("end").cast("bigint"), begins=True)).unionByName(at(marks, "end"))
    events = events.groupBy(*keys, "at").agg(F.max("unit").alias("unit"), F.max("style").alias("style"), F.max("cover").alias("cover"), F.max("begins").alias("begins"))
    run = Window.partitionBy(*keys).orderBy("at")
    sofar = run.rowsBetween(Window.unboundedPreceding, 0)
    state = events.select(*keys, "at", "begins", F.lead("at").over(run).alias("stop"), F.last("unit", ignorenulls=True).over(sofar).alias("unit"), F.last("style", ignorenulls=True).over(sofar).alias("style"), F.coalesce(F.max("cover").over(sofar), F.col("at")).alias("cover"))
    shown = state.where((F.col("unit.end") > F.col("at")) & (F.col("cover") <= F.col("at")))
    # A tab is one sign: it shows if it is not covered where it starts.
    tabs = shown.where(F.col("unit.tab") & (F.col("unit.pos") == F.col("at")))
    texts = shown.where(~F.col("unit.tab")).join(looks.select("style", F.col("bold").alias("_b"), F.col("color").alias("_c")), "style", "left")
    texts = texts.withColumns({"bold": F.coalesce("_b", F.lit(False)), "color": F.when(is_coloured(F.col("_c")), F.col("_c")), "text": F.substring("unit.text", (F.col("at") - F.col("unit.pos") + 1).cast("int"), (F.col("stop") - F.col("at")).cast("int"))})
    alike = (F.lag("stop").over(run) == F.col("at")) & (F.lag("bold").over(run) == F.col("bold")) & F.lag("color").over(run).eqNullSafe(F.col("color")) & ~F.col("begins")
    texts = texts.withColumn("_new", (~F.coalesce(alike, F.lit(False))).cast("int")).withColumn("_island", F.sum("_new").over(sofar))
    merged = texts.groupBy(*keys, "_island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("text"), F.first("bold").alias("bold"), F.first("color").alias("color"), F.min("at").alias("start"), F.max("stop").alias("end"))
    shape = lambda df, kind, rank, **c: df.select(*keys, F.lit(kind).alias("kind"), *[(c[n] if n in c else none(t)).alias(n) for n, t in (("text", "string"), ("bold", "boolean"), ("color", "string"), ("slot", marks.schema["slot"].dataType.simpleString()), ("option", "int"), ("start", "bigint"), ("end", "bigint"))], F.lit(rank).alias("_rank"))
    place = {"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")}
    parts = shape(merged, "text", 1, text=F.col("text"), bold=F.col("bold"), color=F.col("color"), **place)
    parts = parts.unionByName(shape(tabs, "tab", 1, text=F.lit("\t"), bold=F.lit(False), start=F.col("unit.pos"), end=F.col("unit.end")))
    parts = parts.unionByName(shape(marks, "slot", 0, slot=F.col("slot"), option=F.col("option").cast("int"), **place))
    empty = paragraphs.where("holds and coalesce(tables, 0) = 0").join(parts.select(*keys).distinct(), keys, "left_anti")
    parts = parts.unionByName(shape(empty, "text", 1, text=F.lit(""), bold=F.lit(False), start=F.col("last").cast("bigint"), end=F.col("last").cast("bigint")))
    order = Window.partitionBy(*keys).orderBy("start", "_rank", "end", F.asc_nulls_first("slot"), F.asc_nulls_first("option"))
    return parts.withColumn("ord", (F.row_number().over(order) - 1).cast("bigint")).select(*keys, "ord", "kind", "text", "bold", "color", "slot", "option", "start", "end")


def restyled(styles: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``styles`` (keys, pos, style) after each of ``ranges`` (keys, start, end, style): the range has its style, what follows it the one it had.

    Ranges of a key don't overlap; empty ones change nothing. Places where the style does not change are dropped.
    """
    keys = list(keys)
    kind: T.DataType = styles.schema["style"].dataType
    ranges = ranges.where("end > start")
    none = F.lit(None).cast(kind)
    events = styles.select(*keys, "pos", F.col("style").alias("own"), none.alias("given"), F.lit(0).alias("step"))
    events = events.unionByName(ranges.select(*keys, F.col("start").alias("pos"), none.alias("own"), F.col("style").cast(kind).alias("given"), F.lit(1).alias("step")))
    events = events.unionByName(ranges.select(*keys, F.col("end").alias("pos"), none.alias("own"), none.alias("given"), F.lit(-1).alias("step")))
    events = events.groupBy(*keys, "pos").agg(F.max("own").alias("own"), F.max("given").alias("given"), F.sum("step").alias("step"))
    run = Window.partitionBy(*keys).orderBy("pos")
    sofar = run.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum("step").over(sofar) > 0
    state = events.select(*keys, "pos", F.when(inside, F.last("given", ignorenulls=True).over(sofar)).otherwise(F.last("own", ignorenulls=True).over(sofar)).alias("style"))
    before = F.lag("style").over(run)
    first = F.row_number().over(run) == 1
    return state.withColumn("_same", ~first & before.eqNullSafe(F.col("style"))).where("not _same").drop("_same")
