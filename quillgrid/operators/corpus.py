"""Work on corpora of forms: choosing files by strata and quotas, reuse by content, tallies, page pairs, measured widths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.stages import deleted, written

from quillgrid.operators.groups import top_each


def first_strata(rows: DataFrame, strata: Sequence[tuple[str, Column, int]], key: str, order: Sequence[Column | str]) -> DataFrame:
    """(key, stratum): the first n rows of each stratum in turn, those that an earlier one took left out.

    Earlier strata hold their own n and no more, so a row's stratum is found by looking at n + (all earlier n) of each at most.
    """
    reach, ahead = [], 0
    for name, member, n in strata:
        ahead += n
        head = rows.where(member).orderBy(*order).limit(ahead)
        reach.append(head.select(key, *[F.row_number().over(Window.orderBy(*order)).alias("_r")]).withColumns({"stratum": F.lit(name), "_n": F.lit(n)}))
    taken: DataFrame | None = None
    for head in reach:
        left = head if taken is None else head.join(taken.select(key), key, "left_anti")
        mine = top_each(left, ["stratum"], ["_r"], F.col("_n")).select(key, "stratum")
        taken = mine if taken is None else taken.unionByName(mine)
    return taken


def capped(rows: DataFrame, caps: Sequence[tuple[Sequence[str], Sequence[Column | str], int]]) -> DataFrame:
    """Rows that pass each cap in turn: the first n of each group of what the cap before it left."""
    return reduce(lambda df, c: top_each(df, c[0], c[1], c[2]).drop("rank"), caps, rows)


def quota_sample(rows: DataFrame, targets: Sequence[tuple[object, int, int]], target: str, keyword: str, org: str, title: str, order: Column) -> DataFrame:
    """``rows`` drawn as one would row by row: for each of ``targets`` (value, quota, cap) in turn, keywords by turns.

    In a turn each keyword, by value, offers its next row by ``order`` (different values for the rows of a keyword). It is taken unless its title (spacing
    dropped) was taken before, for any target, or ``cap`` rows of its organisation were, for this one; a refused row takes
    nothing away from others. A target is done at ``quota`` rows. Null titles, keywords and organisations are values like others.

    Turns are ranks, cut to the first ones before they are shuffled, and offered in waves until the quota is met;
    a wave is decided as a fixed point (``_decided``). Its rows are some multiple of the quota and the number of keywords.
    """
    spark = rows.sparkSession
    bare = F.coalesce(F.regexp_replace(F.col(title).cast("string"), r"\s+", ""), F.lit("\0"))
    base = rows.withColumns({"_title": bare, "_org": F.coalesce(F.col(org).cast("string"), F.lit("\0")), "_o": order})
    taken: list[DataFrame] = []
    for value, quota, cap in targets:
        mine = base.where(F.col(target) == F.lit(value))
        keywords = mine.select(keyword).distinct().count()
        width, turn, left = 2 * -(-quota // max(keywords, 1)) + 2, 0, quota
        orgs = spark.createDataFrame([], "_org string, _had bigint")
        while left > 0 and keywords:
            rank = F.row_number().over(Window.partitionBy(keyword).orderBy("_o"))
            wave = mine.withColumn("_turn", rank).where(F.col("_turn") <= turn + width).where(F.col("_turn") > turn)
            for t in taken:
                wave = wave.join(t.select("_title"), "_title", "left_anti")
            wave = written(wave.join(orgs, "_org", "left").na.fill(0, ["_had"]).where(F.col("_had") < cap), "wave")
            if mine.groupBy(keyword).count().where(F.col("count") > turn).isEmpty():
                break
            got = written(_decided(wave, keyword, left, cap), "taken")
            taken.append(got)
            left -= got.count()
            orgs = written(orgs.unionByName(got.groupBy("_org").agg(F.count(F.lit(1)).alias("_had"))).groupBy("_org").agg(F.sum("_had").alias("_had")), "orgs")
            turn, width = turn + width, 2 * width
    out = rows.limit(0)
    for t in taken:
        out = out.unionByName(t.select(*rows.columns))
    return out


def _decided(wave: DataFrame, keyword: str, quota: int, cap: int) -> DataFrame:
    """Rows of a wave that are taken, one after the other by turn and keyword.

    In each round an open row is refused if a taken row before it has its title, or those before it fill its organisation or the
    quota; it is taken if none of these can happen even if all open rows before it are taken. The
    first open row is always decided, and most are at once.
    """
    line = ("_turn", F.asc_nulls_first(keyword))
    state = written(wave.withColumn("_is", F.lit("open")), "quota")
    while not state.where("_is = 'open'").isEmpty():
        before = lambda *keys: Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)
        n = lambda what, w: F.coalesce(F.sum(F.col("_is").isin(*what).cast("int")).over(w), F.lit(0))
        took, may = ("taken",), ("taken", "open")
        seen = state.withColumns({"_t": n(took, before("_title")), "_t2": n(may, before("_title")), "_c": n(took, before("_org")), "_c2": n(may, before("_org")), "_q": n(took, before()), "_q2": n(may, before())})
        refused = (F.col("_t") > 0) | (F.col("_had") + F.col("_c") >= cap) | (F.col("_q") >= quota)
        sure = (F.col("_t2") == 0) & (F.col("_had") + F.col("_c2") < cap) & (F.col("_q2") < quota)
        after = written(seen.withColumn("_is", F.when(F.col("_is") != "open", F.col("_is")).when(refused, "refused").when(sure, "taken").otherwise("open")).select(*state.columns), "quota")
        deleted(state)
        state = after
    return state.where("_is = 'taken'")


def seeded_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows without replacement, the same ones for a seed: least hashes of the key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def every_kth(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first of each k rows of a group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") % k == 1 % k).drop("_k")


def present(manifest: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Rows of a manifest whose file is still there."""
    return manifest.join(files.select(path), path, "left_semi")


def reuse(outputs: DataFrame, earlier: DataFrame, content: str, name: str) -> DataFrame:
    """``outputs`` with ``reused``: the least name of an earlier file with the same bytes, else null, which must be written."""
    known = earlier.select(F.sha2(F.col(content).cast("binary"), 256).alias("_sha"), F.col(name).alias("reused")).groupBy("_sha").agg(F.min("reused").alias("reused"))
    return outputs.withColumn("_sha", F.sha2(F.col(content).cast("binary"), 256)).join(known, "_sha", "left").drop("_sha")


def page_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys..., n, left, right): the nth page of one rendering with the nth of the other."""
    numbered = lambda d, as_: d.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).select(*keys, "n", F.col(value).alias(as_))
    return numbered(a, "left").join(numbered(b, "right"), [*keys, "n"])


def page_index(files: DataFrame, path: str) -> DataFrame:
    """(stem, pages map<int, string>) of page images: name_p3.jpg, name/3.jpg, or name with -3, _page3, (3) or nothing; reviews are left out."""
    p = F.col(path)
    stem = F.regexp_replace(F.regexp_replace(p, r"^.*/", ""), r"(?i)\.jpe?g$", "")
    folder = F.regexp_extract(p, r"([^/]+)/[^/]*$", 1)
    told, loose = r"^(.+)_p(\d+)$", r"(?i)^(.+?)(?:[ _-]+(?:p|page|pg)?\(?(\d+)\)?)?$"
    part = lambda pattern, i: F.regexp_extract(stem, pattern, i)
    number = lambda text: text.try_cast("int")
    found = (
        F.when(stem.rlike(told), F.struct(part(told, 1).alias("stem"), number(part(told, 2)).alias("page")))
        .when(stem.rlike(r"^\d+$") & (folder != ""), F.struct(folder.alias("stem"), number(stem).alias("page")))
        .otherwise(F.struct(part(loose, 1).alias("stem"), F.coalesce(number(part(loose, 2)), F.lit(1)).alias("page")))
    )
    image = p.rlike(r"(?i)\.jpe?g$") & ~p.rlike("(^|/)review/")
    rows = files.where(image).select(found.alias("f"), F.col(path).alias("_path")).groupBy("f.stem", "f.page").agg(F.max("_path").alias("_path"))
    return rows.groupBy("stem").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "_path")))).alias("pages"))


def tally(checks: DataFrame, keys: Sequence[str], passed: Column, example: str, most: int = 200) -> DataFrame:
    """(keys..., passed, failed, examples): counts, and the least ``most`` examples of what failed."""
    ok = F.coalesce(passed, F.lit(False))
    counts = checks.groupBy(*keys).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    some = top_each(checks.where(~ok).select(*keys, example).distinct(), keys, [example], most).groupBy(*keys).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return counts.join(some, list(keys), "left")


def slot_counts(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n, kinds): blanks of each form, and their kinds with counts."""
    each = slots.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("k"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "k"))), lambda x: F.concat_ws(":", x["kind"], x["k"])), ",")
    return each.groupBy(*keys).agg(F.sum("k").alias("n"), told.alias("kinds"))


def face_widths(samples: DataFrame, face: str, kind: str, width: str) -> DataFrame:
    """(face, kind, n, width) that differ from the kind's common width by 2 % or more.

    Three samples or more count by their median; two that differ by over 5 %, and fewer than three far off (15 %), not at all.
    """
    base = samples.groupBy(kind).agg(F.median(width).alias("_base"))
    own = samples.groupBy(face, kind).agg(F.count(F.lit(1)).alias("n"), F.median(width).alias("width"), F.min(width).alias("_lo"), F.max(width).alias("_hi"))
    off = F.abs(F.col("width") / F.col("_base") - 1)
    trusted = (F.col("n") >= 3) | ((F.col("_hi") / F.col("_lo") - 1 <= 0.05) & (off <= 0.15))
    return own.join(base, kind).where(trusted & (off >= 0.02)).select(face, kind, "n", "width")


def difference_box(values: DataFrame, keys: Sequence[str], at: str, difference: str, limit: float) -> DataFrame:
    """(keys..., n_values, mean_diff, over, left_edge, right_edge) of differences along ``at``; the edges are those over the limit."""
    over = F.col(difference) > limit
    edge = F.when(over, F.col(at).cast("bigint"))
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.avg(difference).alias("mean_diff"), F.count_if(over).alias("over"), F.min(edge).alias("left_edge"), F.max(edge).alias("right_edge"))


def sub_pixel(before: Column, best: Column, after: Column) -> Column:
    """How far the peak of a parabola through a score and its two neighbours lies from the middle one."""
    bend = before - 2 * best + after
    return F.coalesce(F.when(bend < 0, 0.5 * (before - after) / bend), F.lit(0.0))


def best_shift(pairs: DataFrame, key: str, a: str, b: str, most: int) -> DataFrame:
    """(key, shift, score, peak): the shift up to ``most`` either way where ``b`` follows ``a`` best, by normalised correlation."""
    shifts = pairs.withColumn("s", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    x = F.expr(f"slice({a}, int(greatest(1, 1 - s)), int(size({a}) - abs(s)))")
    y = F.expr(f"slice({b}, int(greatest(1, 1 + s)), int(size({b}) - abs(s)))")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v.cast("double"))
    d = shifts.select(key, "s", x.alias("x"), y.alias("y"))
    d = d.withColumns({"mx": total(F.col("x")) / F.size("x"), "my": total(F.col("y")) / F.size("y")})
    both = total(F.zip_with("x", "y", lambda p, q: (p - F.col("mx")) * (q - F.col("my"))))
    square = lambda c, m: total(F.transform(c, lambda p: (p - F.col(m)) * (p - F.col(m))))
    d = d.select(key, "s", F.round(both / F.sqrt(square("x", "mx") * square("y", "my")), 9).alias("score"))
    w = Window.partitionBy(key).orderBy("s")
    d = d.withColumns({"before": F.lag("score").over(w), "after": F.lead("score").over(w)})
    best = d.groupBy(key).agg(F.max(F.struct("score", (-F.col("s")).alias("n"), "before", "after")).alias("m"))
    return best.select(key, (-F.col("m.n")).alias("shift"), F.col("m.score").alias("score"), (-F.col("m.n") + sub_pixel(F.col("m.before"), F.col("m.score"), F.col("m.after"))).alias("peak"))
