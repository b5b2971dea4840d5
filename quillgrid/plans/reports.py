"""Around a fill: records as they are made up, which columns no form wants, who holds a blank, names of outputs, reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.values import choose_options, display_width


def _over(under: Column, over: Column) -> Column:
    """Map ``under`` with the entries of ``over``, which win."""
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)


def with_values(records: DataFrame, values: dict[str, str]) -> DataFrame:
    """``records`` (rec map<string, string>) with ``values`` set in every one, in place of its own."""
    if not values:
        return records
    return records.withColumn("rec", _over(F.col("rec"), F.create_map(*(F.lit(x) for kv in values.items() for x in kv))))


def records_on_forms(records: DataFrame, screens: DataFrame) -> DataFrame:
    """(rec_id, form_id, rec): each record on each form, by definition a product; what ``screens`` (form_id, screen map) shows is
    the default, the record's own values win. Forms are those open at once; they are counted before they are broadcast."""
    forms = F.broadcast(screens) if screens.limit(10_001).count() <= 10_000 else screens
    return records.crossJoin(forms).select("rec_id", "form_id", _over(F.coalesce("screen", F.create_map().cast("map<string,string>")), F.col("rec")).alias("rec"))


def uncovered(columns: DataFrame, matches: DataFrame) -> DataFrame:
    """(column): columns that no form has a blank for."""
    return columns.select("column").distinct().join(matches.select("column").distinct(), "column", "left_anti")


def holders(claims: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """(keys..., holder, value) of ``claims`` (keys..., holder, value): the kind of claim named first in ``priority`` holds a blank."""
    rank = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("holder"))
    best = F.min(F.struct(rank.alias("r"), "value", "holder")).alias("b")
    return claims.where(rank > 0).groupBy(*keys).agg(best).select(*keys, "b.holder", "b.value")


def addressable(options: Column) -> Column:
    """The options (array of labels) that their own label picks and nothing else; a lone one always is."""
    own = lambda o: (F.trim(o) != "") & ~o.rlike(r"[,;|]|\s/|/\s") & F.coalesce(choose_options(options, o) == F.array(o), F.lit(False))
    return F.when(F.size(options) == 1, options).otherwise(F.filter(options, own))


def edit_map(edits: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys..., text) of a log of edits (keys..., order, original, text): the last one of each stretch, gone where it is the original again."""
    last = F.max_by(F.struct("original", "text"), order).alias("e")
    return edits.groupBy(*keys).agg(last).where("not (e.text <=> e.original)").select(*keys, "e.text")


def labelled(slots: DataFrame, everything: bool = False) -> DataFrame:
    """Blanks that have a label (labels array<string>), or all."""
    return slots if everything else slots.where(F.exists("labels", lambda x: x != ""))


def output_name(template: str, form: Column, row: Column, record: Column) -> Column:
    """A file's stem: {form}, {row} and {column} of ``template`` filled in, refused characters as _; the form's where nothing is left."""
    parts = []
    for i, piece in enumerate(re.split(r"\{([^{}]+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        else:
            parts.append(form if piece == "form" else row.cast("string") if piece == "row" else F.coalesce(F.try_element_at(record, F.lit(piece)), F.lit("")))
    name = F.trim(F.regexp_replace(F.concat(*parts), r'[\\/:*?"<>|\x00-\x1f]', "_"))
    return F.when(name == "", form).otherwise(name)


def padded(text: Column, width: Column) -> Column:
    """``text`` with spaces up to a width on a terminal."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - display_width(text)).cast("int")))


def slot_list(slots: DataFrame) -> DataFrame:
    """(form_id, slot_ord, line) of ``slots`` (form_id, slot_ord, key, labels): keys in a column as wide as the widest of the form, 36 at most."""
    wide = slots.groupBy("form_id").agg(F.least(F.lit(36), F.max(display_width(F.col("key")))).alias("_w"))
    line = F.concat(padded(F.col("key"), F.col("_w")), F.lit("  "), F.array_join("labels", " / "))
    return slots.join(wide, "form_id").select("form_id", "slot_ord", F.rtrim(line).alias("line"))


def fill_report(filled: DataFrame, unmatched: DataFrame, ambiguous: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(form_id, n_filled, n_unmatched, n_ambiguous, n_conflicts, clean): one row for each form that anything is known of."""
    kinds = [(filled, "n_filled"), (unmatched, "n_unmatched"), (ambiguous, "n_ambiguous"), (conflicts, "n_conflicts")]
    each = [d.groupBy("form_id").agg(F.count(F.lit(1)).alias("n")).select("form_id", F.lit(name).alias("kind"), "n") for d, name in kinds]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    got = rows.groupBy("form_id").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).cast("bigint").alias(name) for _, name in kinds))
    return got.withColumn("clean", (F.col("n_unmatched") + F.col("n_ambiguous") + F.col("n_conflicts")) == 0)


def problem_log(problems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., log) of problems (keys..., name, problem): one text for each archive, lines in order, ended as Windows does."""
    line = F.concat_ws(": ", "name", "problem")
    return problems.groupBy(*keys).agg(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\r\n"), F.lit("\r\n")).alias("log"))


def stamp(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., version) of small text files (path, content): first 12 hex digits of the SHA-256 of path, NUL and content, by path."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda f: F.concat(f["path"], F.lit("\x00"), f["content"]))
    return files.groupBy(*keys).agg(F.substring(F.sha2(F.array_join(told, ""), 256), 1, 12).alias("version"))


def settled_states(saves: DataFrame, keys: Sequence[str], at: str, state: str, pause: float) -> DataFrame:
    """(keys..., at, state): of changes less than ``pause`` apart only the last is saved."""
    w = Window.partitionBy(*keys).orderBy(at, state)
    return saves.withColumn("_next", F.lead(at).over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col(at) >= pause)).select(*keys, at, state)
