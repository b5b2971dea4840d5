"""Grouping operators: robust medians, ranks within strata, duplicates, components, level trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.operators.nesting import level_parents  # noqa: F401  of this family, though a pass


def top_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int | Column) -> DataFrame:
    """The first k rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def robust_medians(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Median of each group, and again over the rows within ``share`` of it."""
    first = df.groupBy(*keys).agg(F.median(value).alias("first_median"))
    near = df.join(first, list(keys)).where(F.abs(F.col(value) - F.col("first_median")) <= share * F.col("first_median"))
    return near.groupBy(*keys).agg(F.first("first_median").alias("first_median"), F.median(value).alias("robust_median"), F.count(F.lit(1)).alias("n_near"))


def mode(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Most common value of each group; of equally common ones the least."""
    n = df.groupBy(*keys, value.alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("mode")).alias("neg")))
    return n.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.neg")).alias("mode"), F.col("b.n").alias("n"))


def boilerplate(df: DataFrame, page: str, line: str, least: int, share: float) -> DataFrame:
    """Lines (digits folded to #, spacing dropped) on at least ``least`` pages and ``share`` of them."""
    key = F.regexp_replace(F.regexp_replace(F.col(line), r"[0-9]+", "#"), r"\s+", "")
    keyed = df.select(page, key.alias("key")).where("key <> ''").distinct()
    pages = df.agg(F.countDistinct(page).alias("pages"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least).join(F.broadcast(pages)).where(F.col("n_pages") >= share * F.col("pages")).select("key", "n_pages")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (u, v): labels sink along edges and jump to their label's label until nothing moves."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select(F.col("u").alias("node"), "c").checkpoint()
    while True:
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("c").alias("m"))
        moved = label.join(near, label["node"] == near["u"]).select("node", F.least("c", "m").alias("n"), "c")
        jump = moved.select(F.col("node").alias("at"), F.col("n").alias("further"))
        after = moved.join(jump, moved["n"] == jump["at"], "left").select("node", F.coalesce("further", "n").alias("n"), "c").checkpoint()
        label = after.select("node", F.col("n").alias("c"))
        if after.where("n <> c").isEmpty():
            return label.withColumnRenamed("c", "component")
