"""Target-distribution importance resampling over hashed n-grams, by built-in functions.

1. Each text becomes the array of its features' buckets by higher-order functions: its words,
   then its pairs of neighbouring words, by crc32 modulo ``buckets``.
2. Buckets are counted over all documents and over all target texts; each task sends one
   number a bucket at most.
3. A bucket's gain is floor(1000 ln(target share / corpus share)), smoothed by one each. Gains are one
   literal array of ``buckets`` numbers; a document's weight is the floored mean of element_at
   over its buckets, without exploding them.
4. A Gumbel number drawn from sha256 of the seed and doc_id is added; the highest scores among
   long enough documents are drawn. Scores are whole numbers in a bounded range, so a count for each score tells
   the least score drawn; only documents from there on are sorted, by ranges of score and doc_id,
   and a rank is the range's first rank and the place in it.

Defined results: null and empty texts have no features and weight 0; rows that share a doc_id are each
scored, ranked one after the other; a null doc_id hashes as an empty text, its ties come last; texts of
any length are whole; extra columns are ignored; an empty table gives an empty result, an
empty target still has its smoothed shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.nativetext import words
from quillgrid.llm.scratch import discard, settle

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Rows of a range of scores that is sorted in one task.
RANGE_ROWS = 1_000_000


def bucket_array(w: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of an array of words: one for each word, then one for each pair of neighbours."""
    bucket = lambda s: (F.crc32(s.cast("binary")) % buckets).cast("int")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: bucket(F.concat_ws(" ", a, b))))
    return F.concat(F.transform(w, bucket), F.coalesce(pairs, F.array().cast("array<int>")))


def bucketed(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """texts with ``_words`` (how many) and ``_buckets``."""
    found = texts.withColumn("_w", words(F.col("text").cast("string")))
    return found.select("*", F.size("_w").alias("_words"), bucket_array(F.col("_w"), buckets).alias("_buckets")).drop("_w")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all texts."""
    # explode_outer: before explode, Spark adds a filter that finds the buckets once more.
    every = bucketed(texts.select("text"), buckets).select(F.explode_outer("_buckets").alias("bucket"))
    return every.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: a list of ``buckets`` numbers."""
    s = bucket_counts(docs, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets).withColumnRenamed("n", "t")
    spark: SparkSession = docs.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    both = both.crossJoin(F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    d = lambda c, k: (F.col(c) + k).cast("double")
    share = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return [r.gain for r in both.select("bucket", F.floor(1000 * F.log(share)).cast("bigint").alias("gain")).orderBy("bucket").collect()]


def literal_array(numbers: list[int]) -> Column:
    """An array literal: folded from one text, so the plan holds no node for each number."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the floored mean of its buckets' gains."""
    found = bucketed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), len(gain))
    total = F.aggregate("_buckets", F.lit(0).cast("bigint"), lambda t, b: t + F.element_at(literal_array(gain), b + 1))
    found = found.select("doc_id", F.col("_words").cast("bigint").alias("n_words"), F.size("_buckets").cast("bigint").alias("n_features"), total.alias("total"))
    return found.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("bigint")).alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g drawn from the Gumbel distribution by sha256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def _ranked(rows: DataFrame, draw: int, count: int) -> DataFrame:
    """rows with ``rank``, null beyond ``draw``: sorted by ranges, each range's first rank added."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    sorted_ = rows.repartitionByRange(max(1, -(-count // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    # Written, so that places in ranges and counts of ranges are of one and the same sort.
    placed = settle(sorted_.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, at = {}, 0
    for p, n in sizes:  # a number for each range of RANGE_ROWS rows
        first[p], at = at, at + n
    starts = rows.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], "_part bigint, _first bigint")
    placed = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    rank = F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*rows.columns, F.when(rank <= draw, rank).cast("bigint").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text, ...); rank is null for those not drawn."""
    if not 0 <= percent <= 100:
        raise ValueError("percent is 0 at least and 100 at most")
    scored = weights(docs, gains(docs, target, buckets))
    scored = settle(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    long_enough = F.col("n_words") >= least_words
    # Gains and Gumbel numbers are bounded, so are the different scores: some hundred thousand at the most.
    counts = sorted(((r.score, r.n) for r in scored.where(long_enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    cut, taken = None, 0
    for score, n in counts:
        if taken >= draw:
            break
        cut, taken = score, taken + n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    drawn = long_enough & (F.col("score") >= cut)
    return scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint")).unionByName(_ranked(scored.where(drawn), draw, taken))
