"""Pages as drawn: rules into tables, glyphs into cells, lines and text, tables that go on over pages.

A page is the unit: what is grouped or folded is one page's rules or glyphs, spread over tasks by its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rules this near touch; a line's height share, gaps of a space and of a column in em; columns this near are one.
TOUCH, LINE, SPACE_GAP, COLUMN_GAP, COLUMN_NEAR = 1.5, 0.45, 0.3, 1.8, 3.0


def crossings(across: DataFrame, down: DataFrame, keys: Sequence[str], touch: float = TOUCH, width: float = 64.0) -> DataFrame:
    """(keys..., h, v): horizontal rules (id, at, lo, hi) that meet vertical ones, joined on stripes of ``width`` along the page."""
    stripes = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    h = across.select(*keys, F.col("id").alias("h"), F.col("at").alias("y"), "lo", "hi").withColumn("_s", stripes(F.col("lo") - touch, F.col("hi") + touch))
    v = down.select(*keys, F.col("id").alias("v"), F.col("at").alias("x"), F.col("lo").alias("top"), F.col("hi").alias("bottom")).withColumn("_s", F.floor(F.col("x") / width))
    near = F.col("x").between(F.col("lo") - touch, F.col("hi") + touch) & F.col("y").between(F.col("top") - touch, F.col("bottom") + touch)
    return h.join(v, [*keys, "_s"]).where(near).select(*keys, "h", "v")


def extents(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n_across, left, right, top, bottom) of groups of rules (kind h or v, at, lo, hi); without two across and one down it is no table."""
    h, v = F.col("kind") == "h", F.col("kind") == "v"
    x_lo, x_hi = F.when(h, F.col("lo")).otherwise(F.col("at")), F.when(h, F.col("hi")).otherwise(F.col("at"))
    y_lo, y_hi = F.when(v, F.col("lo")).otherwise(F.col("at")), F.when(v, F.col("hi")).otherwise(F.col("at"))
    got = members.groupBy(*keys).agg(F.count_if(h).alias("n_across"), F.count_if(v).alias("_down"), F.min(x_lo).alias("left"), F.max(x_hi).alias("right"), F.min(y_lo).alias("top"), F.max(y_hi).alias("bottom"))
    return got.where("n_across >= 2 and _down >= 1").drop("_down")


def grid_place(edges: Column, at: Column) -> Column:
    """The stretch of sorted ``edges`` that holds ``at``, from 0; outside, the nearest one."""
    passed = F.size(F.filter(edges, lambda e: e <= at))
    return F.greatest(F.lit(0), F.least(passed - 1, F.size(edges) - 2))


def glyph_lines(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``glyphs`` (keys..., x, y, size, c) with line, from 0: a glyph is on the open line if it is near that line's first glyph."""
    order = F.array_sort(F.collect_list(F.struct("y", "x", "size", "c")))
    nothing = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("size"), F.array().cast("array<int>").alias("lines"))

    def step(s: Column, g: Column) -> Column:
        same = F.coalesce(F.abs(g["y"] - s["y"]) <= LINE * F.greatest(g["size"], s["size"]), F.lit(False))
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        first = lambda name: F.when(same, s[name]).otherwise(g[name].cast("double"))
        return F.struct(line.alias("line"), first("y").alias("y"), first("size").alias("size"), F.concat(s["lines"], F.array(line)).alias("lines"))

    pages = glyphs.groupBy(*keys).agg(order.alias("g")).withColumn("n", F.aggregate("g", nothing, step)["lines"])
    return pages.select(*keys, F.explode(F.arrays_zip("g", "n")).alias("_z")).select(*keys, "_z.g.x", "_z.g.y", "_z.g.size", "_z.g.c", F.col("_z.n").alias("line"))


def line_texts(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., text) of lines of glyphs (x0, x1, size, c): blanks by printed spaces and by gaps, four for the gap of a column."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1", "c")
    blank = F.col("c").rlike(r"^\s+$")
    g = glyphs.withColumn("_n", F.count_if(~blank).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_blank", blank)
    g = g.withColumn("_spaced", F.lag("_blank").over(w)).where("not _blank")
    gap, em = F.col("x0") - F.lag("x1").over(w), F.greatest("size", F.lag("size").over(w))
    before = F.when(gap > COLUMN_GAP * em, "    ").when(gap.isNotNull() & (F.coalesce("_spaced", F.lit(False)) | (gap > SPACE_GAP * em)), " ").otherwise("")
    g = g.withColumn("_t", F.concat(before, "c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "")
    return g.groupBy(*keys).agg(F.regexp_replace(text, "·{3,}", " … ").alias("text"))


def continued_tables(blocks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``blocks`` (keys..., order, type, page, cols array<double>) with ``table_id``: a table goes on where the block before it is one, on the page before, with the same columns."""
    w = Window.partitionBy(*keys).orderBy(order)
    b = blocks.withColumns({"_t": F.lag("type").over(w), "_p": F.lag("page").over(w), "_c": F.lag("cols").over(w)})
    alike = (F.size("cols") == F.size("_c")) & F.forall(F.zip_with("cols", "_c", lambda x, y: F.abs(x - y) <= COLUMN_NEAR), lambda ok: ok)
    goes_on = F.coalesce((F.col("type") == "table") & (F.col("_t") == "table") & (F.col("page") == F.col("_p") + 1) & alike, F.lit(False))
    b = b.withColumn("_new", (~goes_on).cast("int"))
    return b.withColumn("table_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t", "_p", "_c", "_new")


def captions(blocks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Tables of ``blocks`` (type, text) with the text of a caption that comes right after them."""
    w = Window.partitionBy(*keys).orderBy(order)
    follows = F.when(F.lead("type").over(w) == "caption", F.lead("text").over(w))
    return blocks.withColumn("caption", follows).where("type = 'table'")


def renumbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Column, name: str = "number") -> DataFrame:
    """Kept rows numbered from 1 in order, the others gone."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_keep", F.coalesce(keep, F.lit(False))).withColumn(name, F.sum(F.col("_keep").cast("int")).over(w)).where("_keep").drop("_keep")


def covered(met: DataFrame, keys: Sequence[str], share: float = 0.6) -> DataFrame:
    """(keys..., lo, hi, covered, enough) of overlaps (start, end with lo, hi): whether a stretch is mostly drawn."""
    got = met.groupBy(*keys, "lo", "hi").agg(F.sum(F.least("end", "hi") - F.greatest("start", "lo")).alias("covered"))
    return got.withColumn("enough", F.col("covered") >= share * (F.col("hi") - F.col("lo")))


def neighbours(places: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., r, c, side, same): each place of a grid (r, c, value) with the one to its right and the one below."""
    p = places.select(*keys, "r", "c", value)
    sides = [(F.col("r"), F.col("c") - 1, "right"), (F.col("r") - 1, F.col("c"), "below")]
    to = p.select(*keys, F.col(value).alias("_other"), F.explode(F.array(*(F.struct(r.alias("r"), c.alias("c"), F.lit(s).alias("side")) for r, c, s in sides))).alias("_n"))
    to = to.select(*keys, "_n.r", "_n.c", "_n.side", "_other")
    return p.join(to, [*keys, "r", "c"]).select(*keys, "r", "c", "side", (F.col(value) == F.col("_other")).alias("same"))


def markdown_tables(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., markdown) of tables of cells (row, col, text) without spans: a header, a rule, the rows; a lone cell is a quote."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    size = cells.groupBy(*keys).agg(F.max("col").alias("_cols"))
    by_place = F.map_from_entries(F.collect_list(F.struct("col", text.alias("t"))))
    rows = cells.groupBy(*keys, "row").agg(by_place.alias("m"), F.max("text").alias("raw")).join(size, list(keys))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_cols")), lambda c: F.coalesce(F.element_at("m", c), F.lit(""))), " | "), F.lit(" |"))
    lines = rows.select(*keys, "row", "raw", "_cols", line.alias("line")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("l"), F.max("_cols").alias("_cols"), F.max("raw").alias("raw"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("_cols") + 1))
    grid = F.array_join(F.concat(F.slice("l", 1, 1), F.array(rule), F.slice("l", F.lit(2), F.size("l"))), "\n")
    quote = F.array_join(F.transform(F.split("raw", "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")
    return lines.select(*keys, F.when((F.size("l") == 1) & (F.col("_cols") == 0), quote).otherwise(grid).alias("markdown"))
