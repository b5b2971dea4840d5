"""Fill plans: which blank of which form takes which column of each record.

Names are matched once for the distinct columns of all records (a schema-sized job);
records, the big side, only meet the small result, which is broadcast when counted small.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.labels import OTHER_PARTY, SELF_PARTIES, alias_table, nfc, normalise_label
from quillgrid.functions.writing import apply_edits, blank_edits, bound, part_values

# How specific a name of a blank is, and what an alias costs.
ID, KEY, FULL, INNER, ALIAS = 100, 90, 80, 50, 5
#: Matches that may be broadcast.
SMALL_ROWS = 200_000
#: Values of records that are dealt to a task.
VALUES = 1 << 19


@dataclass(frozen=True)
class Slot:
    """A blank of a form: normalised labels from outside in, the index among equal ones, the title of its section."""

    form_id: str
    slot_ord: int
    id: str
    labels: tuple[str, ...]
    key: str
    index: int = 1
    group: str = ""
    first_of_outer: bool = field(default=False)


def _plain(text: str) -> str:
    """normalise_label for the handful of composed labels of a form, on the driver."""
    t = re.sub(r"[\s　 ]+", "", text)
    t = re.sub(r"^[*※·•▪□■○●◦◎\-–—]+", "", t)
    t = re.sub(r"[:：.。]+$", "", t)
    return re.sub(r"^[(（[［<〈「『](.*)[)）\]］>〉」』]$", r"\1", t).lower()


def with_first_of_outer(slots: Iterable[Slot]) -> list[Slot]:
    """Marks the first index-1 blank of several labels under each outer label of a form: it alone answers to that label."""
    seen: set[tuple[str, str]] = set()
    out = []
    for s in sorted(slots, key=lambda s: (s.form_id, s.slot_ord)):
        outer = next((x for x in s.labels if x not in SELF_PARTIES), s.labels[0] if s.labels else "")
        first = s.index == 1 and len(s.labels) > 1 and (s.form_id, outer) not in seen
        if first:
            seen.add((s.form_id, outer))
        out.append(Slot(s.form_id, s.slot_ord, s.id, s.labels, s.key, s.index, s.group, first))
    return out


def slot_names(s: Slot) -> dict[str, tuple[int, str]]:
    """name -> (score, qualifier) of a blank."""
    labels = [x for x in s.labels if x]
    party = re.compile(OTHER_PARTY)
    named = any(party.search(x) for x in s.labels[:-1])
    other = named or bool(party.search(_plain(s.group)))
    candidates = [(_plain(s.id), ID, "")]
    key = _plain(s.key)
    if not other or party.search(key):
        candidates.append((key, FULL if key == ".".join(labels) else KEY, ""))
    endings = [""] if s.index <= 1 else [f"#{s.index}", f"{s.index}", f"[{s.index}]", f"_{s.index}"]
    routes = []
    if labels:
        routes.append(([_plain(s.group)] if other and s.group and not any(party.search(x) for x in labels[:-1]) else []) + labels)
        own = [x for i, x in enumerate(labels) if i == len(labels) - 1 or x not in SELF_PARTIES]
        if not other and len(own) < len(labels):
            routes.append(own)
    for route in routes:
        for end in endings:
            candidates += [("".join(route) + end, FULL, ""), (".".join(route) + end, FULL, "")]
            if len(route) > 1:
                candidates.append((f"{''.join(route[:-1])}({route[-1]}){end}", FULL, ""))
                if not other:
                    if s.first_of_outer:
                        candidates.append((route[0] + end, FULL, ""))
                    candidates.append((route[-1] + end, INNER, ".".join(route[:-1])))
    names: dict[str, tuple[int, str]] = {}
    for name, score, qualifier in candidates:
        if name and names.get(name, (-1, ""))[0] < score:
            names[name] = (score, qualifier)
    return names


def names_table(spark: SparkSession, slots: Iterable[Slot]) -> DataFrame:
    """(form_id, slot_ord, slot_key, name, score, qualifier) of forms already read; a form has a few hundred names."""
    rows = [(s.form_id, s.slot_ord, s.key, n, sc, q) for s in with_first_of_outer(slots) for n, (sc, q) in slot_names(s).items()]
    return spark.createDataFrame(rows, "form_id string, slot_ord int, slot_key string, name string, score int, qualifier string")


def match(columns: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(form_id, column, slot_ord, slot_key, score, ambiguous): the best blanks of each distinct ``column``, ties and all."""
    c = columns.select("column", normalise_label(nfc(F.col("column"))).alias("word"))  # distinct columns: a schema-sized job
    variants = c.select("column", F.col("word").alias("name"), F.lit(0).alias("cost")).unionByName(c.join(aliases, "word").where("alias <> word").select("column", F.col("alias").alias("name"), F.lit(ALIAS).alias("cost")))
    hit = variants.join(names, "name").withColumn("score", F.col("score") - F.col("cost"))
    # The first of equal names counts for the qualifier: the column's own, then by name.
    best = hit.groupBy("form_id", "column", "slot_ord", "slot_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "cost", "name", "qualifier")).alias("b"))
    best = best.select("form_id", "column", "slot_ord", "slot_key", (-F.col("b.s")).alias("score"), F.col("b.qualifier").alias("qualifier"))
    w = Window.partitionBy("form_id", "column")
    best = best.withColumn("top", F.max("score").over(w)).where("score = top")
    return best.withColumn("ambiguous", F.size(F.collect_set("qualifier").over(w)) > 1).drop("top", "qualifier")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def filled_columns(records: DataFrame) -> DataFrame:
    """Records (rec_id, col_ord, column, value) without empty values, which mean "leave as it is"."""
    return records.where("value is not null and value <> ''")


def matches_of(records: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    aliases = alias_table(records.sparkSession) if aliases is None else aliases
    return match(filled_columns(records).select("column").distinct(), names, aliases)


def fill_plan(records: DataFrame, matches: DataFrame) -> DataFrame:
    """(form_id, rec_id, slot_key, column, value, score): of the columns that want a blank, the best score, then the first.

    Records are dealt before they meet the forms, in parts that grow in number with them, not in size: a winner is a
    text, so finding it sorts what a task holds, and a file of records may be small for all that they want.
    """
    filled = filled_columns(records)
    won = filled.repartition(filled.count() // VALUES + 1, "rec_id").join(_small(matches.where("not ambiguous")), "column")
    best = F.max(F.struct("score", (-F.col("col_ord")).alias("first"), "column", "value")).alias("w")
    got = won.groupBy("form_id", "rec_id", "slot_ord", "slot_key").agg(best)
    return got.select("form_id", "rec_id", "slot_key", F.col("w.column").alias("column"), F.col("w.value").alias("value"), F.col("w.score").alias("score"))


def conflicts(wanting: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """Rows whose score equals the best so far in their group: they lose to a holder as good as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    held = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return wanting.withColumn("held", held).where(F.col(score) == F.col("held"))


def fill_conflicts(records: DataFrame, matches: DataFrame) -> DataFrame:
    won = filled_columns(records).join(_small(matches.where("not ambiguous")), "column")
    return conflicts(won, ["form_id", "rec_id", "slot_ord"], "col_ord", "score").select("form_id", "rec_id", "slot_key", "column", "score")


def unmatched(records: DataFrame, matches: DataFrame, forms: DataFrame) -> DataFrame:
    """(form_id, column): columns with a value that no blank of the form answers to."""
    asked = filled_columns(records).select("column").distinct().crossJoin(F.broadcast(forms.select("form_id").distinct()))
    return asked.join(matches.select("form_id", "column").distinct(), ["form_id", "column"], "left_anti")


def ambiguous(matches: DataFrame) -> DataFrame:
    """(form_id, column, candidates): columns whose best blanks lie under different labels."""
    return matches.where("ambiguous").groupBy("form_id", "column").agg(F.array_sort(F.collect_set("slot_key")).alias("c")).select("form_id", "column", F.array_join("c", ",").alias("candidates"))


def cross_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every record of ``left`` with every one of ``right`` (rec_id, rec map<string, string>); the right one's values win. A product by definition; an empty left side leaves the right one as it is, an empty right one leaves nothing."""
    if left.isEmpty():
        return right
    if right.isEmpty():
        return right
    both = left.select(F.col("rec_id").alias("l"), F.col("rec").alias("a")).crossJoin(right.select(F.col("rec_id").alias("r"), F.col("rec").alias("b")))
    mine = F.map_filter("a", lambda k, v: ~F.map_contains_key("b", k))
    return both.select(F.concat_ws("-", "l", "r").alias("rec_id"), F.map_concat(mine, "b").alias("rec"))


def slot_keys(slots: DataFrame, form: list[str] | None = None) -> DataFrame:
    """(form..., slot_ord, key) of ``slots`` (form..., slot_ord, label, group): labels used twice in a form get their group's name, and those still alike a number each."""
    form = form or []
    alike = lambda c: Window.partitionBy(*form, c)
    twice = F.count(F.lit(1)).over(alike("label")) > 1
    named = slots.withColumn("k", F.when(twice & (F.col("group") != ""), F.concat_ws(".", "group", "label")).otherwise(F.col("label")))
    named = named.withColumns({"n": F.row_number().over(alike("k").orderBy("slot_ord")), "all": F.count(F.lit(1)).over(alike("k"))})
    return named.select(*form, "slot_ord", F.when(F.col("all") > 1, F.concat("k", F.lit("@"), F.col("n").cast("string"))).otherwise(F.col("k")).alias("key"))


def fill_apply(plan: DataFrame, blanks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(form_id, rec_id, p, text, filled, failed): a plan written into the paragraphs of each record's form.

    ``blanks`` has (form_id, slot_key, p, kind, label, parts array<struct<role, start, end, align, prefix>>), ``paragraphs`` (form_id, p, text).
    Paragraphs that hold a planned blank come out, one row for each record, with all of it written at once: edits
    of its blanks are sorted from the last place to the first, so none moves another. ``filled`` has the keys of
    blanks written, ``failed`` those whose value does not suit their parts (a date for a blank in year, month and day
    that is none) or whose places lie outside the text; a paragraph where all fail keeps its text. Of blanks that
    overlap the later one fails. Forms are broadcast when counted small; records only meet them.
    """
    n = F.char_length("text")
    at = blanks.join(paragraphs, ["form_id", "p"]).withColumn("_in", F.forall("parts", lambda x: (x["start"] >= 0) & (x["start"] <= x["end"]) & (x["end"] <= n)))
    want = plan.join(_small(at), ["form_id", "slot_key"])
    values = part_values(F.col("kind"), F.col("parts"), F.col("value"), F.col("label"))
    edits = bound(values, lambda v: F.when(F.col("_in") & v.isNotNull(), blank_edits(F.col("text"), F.col("parts"), v)))
    first, last = F.array_min(F.transform("parts", lambda x: x["start"])), F.array_max(F.transform("parts", lambda x: x["end"]))
    each = F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"), "slot_key", edits.alias("edits"))
    each = want.select("form_id", "rec_id", "p", F.col("text").alias("_text"), each.alias("_each"))
    rows = each.groupBy("form_id", "rec_id", "p").agg(F.first("_text").alias("text"), F.array_sort(F.collect_list("_each")).alias("_w"))
    # A paragraph's blanks are few: their extents are settled inside the row.
    taken = lambda i: F.exists(F.slice("_w", 1, i), lambda b: b["edits"].isNotNull() & (b["end"] > F.get("_w", i)["start"]))
    told = F.transform("_w", lambda b, i: F.struct(b["slot_key"].alias("slot_key"), F.when(~taken(i), b["edits"]).alias("edits")))
    rows = rows.withColumn("_w", told)
    done = F.filter("_w", lambda b: b["edits"].isNotNull())
    every = F.reverse(F.array_sort(F.flatten(F.transform(done, lambda b: b["edits"]))))
    keys = lambda a: F.transform(a, lambda b: b["slot_key"])
    return rows.select("form_id", "rec_id", "p", apply_edits(F.col("text"), every).alias("text"), keys(done).alias("filled"), keys(F.filter("_w", lambda b: b["edits"].isNull())).alias("failed"))
