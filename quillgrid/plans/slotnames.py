"""Names that blanks answer to, as columns: blanks found in any number of forms never pass through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.labels import OTHER_PARTY, SELF_PARTIES, normalise_label
from quillgrid.plans.fill import FULL, ID, INNER, KEY


def _of_others(label: Column) -> Column:
    return label.rlike(OTHER_PARTY)


def _own(label: Column) -> Column:
    return label.isin(*SELF_PARTIES)


def first_of_outer(slots: DataFrame) -> DataFrame:
    """``slots`` with ``first_of_outer``: whether a blank is the first with index 1 and several labels under its outer label, which then names it alone.

    The outer label is the first that does not mean whoever fills the form, else the first at all.
    """
    others = F.filter("labels", lambda x: ~_own(x))
    named = slots.withColumn("_outer", F.coalesce(F.get(others, F.lit(0)), F.get("labels", F.lit(0)), F.lit("")))
    able = (F.col("index") == 1) & (F.size("labels") > 1)
    first = F.min(F.when(able, F.col("slot_ord"))).over(Window.partitionBy("form_id", "_outer"))
    return named.withColumn("first_of_outer", F.coalesce(able & (F.col("slot_ord") == first), F.lit(False))).drop("_outer")


def _candidates(name: Column, score: int, qualifier: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(score).alias("score"), qualifier.alias("qualifier"))


def _along(route: Column, ends: Column) -> Column:
    """What the labels of a route give: all in a row, with points, the last in brackets, the outer one, the inner one; for each ending."""
    several, none = F.size(route) > 1, F.lit("")
    last, before = F.element_at(route, -1), F.slice(route, 1, F.size(route) - 1)
    other, first = F.col("_other"), F.col("first_of_outer")

    def ended(end: Column) -> Column:
        both = F.array(_candidates(F.concat(F.array_join(route, ""), end), FULL, none), _candidates(F.concat(F.array_join(route, "."), end), FULL, none))
        bracketed = F.array(_candidates(F.concat(F.array_join(before, ""), F.lit("("), last, F.lit(")"), end), FULL, none))
        outer = F.array(_candidates(F.concat(F.get(route, F.lit(0)), end), FULL, none))
        inner = F.array(_candidates(F.concat(last, end), INNER, F.array_join(before, ".")))
        nothing = F.slice(both, 1, 0)
        return F.concat(both, F.when(several, bracketed).otherwise(nothing), F.when(several & ~other & first, outer).otherwise(nothing), F.when(several & ~other, inner).otherwise(nothing))

    return F.flatten(F.transform(ends, ended))


def names_of(slots: DataFrame) -> DataFrame:
    """(form_id, slot_ord, slot_key, name, score, qualifier) of blanks (form_id, slot_ord, id, labels array, key, index, group).

    Labels are normalised ones, from outside in. A blank that stands under somebody else's label, or in such a
    section, answers to no bare inner name; the words for whoever fills the form may be left out. Of equal names of
    a blank the best score counts, then the first. Nulls among texts count as empty; a null index is 1.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    s = slots.select("form_id", "slot_ord", text("id").alias("id"), F.transform(F.coalesce("labels", F.array()), lambda x: F.coalesce(x, F.lit(""))).alias("labels"), text("key").alias("key"), F.coalesce("index", F.lit(1)).alias("index"), text("group").alias("group"))
    s = first_of_outer(s).withColumns({"_labels": F.filter("labels", lambda x: x != ""), "_group": normalise_label(F.col("group")), "_key": normalise_label(F.col("key"))})
    outside = F.when(F.size("labels") > 1, F.slice("labels", 1, F.greatest(F.size("labels") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    s = s.withColumn("_other", F.exists(outside, _of_others) | _of_others(F.col("_group")))
    shown, n = F.col("_labels"), F.size("_labels")
    inner_others = F.exists(F.slice(shown, 1, F.greatest(n - 1, F.lit(0))), _of_others)
    head = F.when(F.col("_other") & (F.col("group") != "") & ~inner_others, F.array("_group")).otherwise(F.array().cast("array<string>"))
    mine = F.filter(shown, lambda x, i: (i == n - 1) | ~_own(x))
    number = F.col("index").cast("string")
    numbered = F.array(F.concat(F.lit("#"), number), number, F.concat(F.lit("["), number, F.lit("]")), F.concat(F.lit("_"), number))
    s = s.withColumns({"_route": F.concat(head, shown), "_mine": mine, "_ends": F.when(F.col("index") <= 1, F.array(F.lit(""))).otherwise(numbered)})
    by_id = F.array(_candidates(normalise_label(F.col("id")), ID, F.lit("")))
    whole = F.array(_candidates(F.col("_key"), FULL, F.lit("")))
    part = F.array(_candidates(F.col("_key"), KEY, F.lit("")))
    none = F.slice(by_id, 1, 0)
    by_key = F.when(F.col("_other") & ~_of_others(F.col("_key")), none).when(F.col("_key") == F.array_join("_labels", "."), whole).otherwise(part)
    along = F.when(n > 0, _along(F.col("_route"), F.col("_ends"))).otherwise(none)
    without = F.when((n > 0) & ~F.col("_other") & (F.size("_mine") < n), _along(F.col("_mine"), F.col("_ends"))).otherwise(none)
    each = s.select("form_id", "slot_ord", F.col("key").alias("slot_key"), F.posexplode(F.concat(by_id, by_key, along, without)).alias("_at", "_c"))
    best = F.min(F.struct((-F.col("_c.score")).alias("less"), "_at", F.col("_c.qualifier").alias("qualifier"))).alias("_b")
    told = each.where("_c.name <> ''").groupBy("form_id", "slot_ord", "slot_key", F.col("_c.name").alias("name")).agg(best)
    return told.select("form_id", "slot_ord", "slot_key", "name", (-F.col("_b.less")).alias("score"), F.col("_b.qualifier").alias("qualifier"))
