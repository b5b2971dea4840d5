"""Benchmark decontamination by winnowing, with built-in expressions only.

Both sides are cut into words; the hash of every run of GRAM words is taken and, of each
SPAN - GRAM + 1 neighbours, the least is a fingerprint. A span of SPAN words that two
texts share holds the same fingerprint on both sides, so none is missed. Fingerprints are
joined; a document that meets an item is extended from the shared grams to windows of
SPAN words, which are compared word by word. An item shorter than SPAN words is one window
of its own length; runs of that length are then fingerprints of documents too.

The benchmark side is broadcast only if its fingerprints are few (counted), else joined
by a shuffle. Candidates are grouped by document: a group holds no more than the
document's own words. No Python runs.

Defined results: null has no words; an item without words has no window; a null item_id
is named "null"; rows of the benchmark that share an item_id are one item; rows of
documents are judged each for itself, repeated ones alike; extra columns are ignored;
empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.nativetext import ngram_hashes, words
from quillgrid.llm.scratch import settle, small

SPAN, GRAM = 10, 5
#: Bytes of windows that are broadcast at most.
BROADCAST_BYTES = 64 << 20


def with_fingerprints(df: DataFrame, span: int, gram: int) -> DataFrame:
    """``df`` (h: array of word hashes, ...) with ``prints``: the least gram hash of each window of ``span`` words.

    Arrays that a lambda looks into are columns of their own, so that they are found once for a row.
    """
    width = span - gram + 1
    df = df.withColumn("grams", ngram_hashes(F.col("h"), gram)).withColumn("n_grams", F.size("grams"))
    least = F.transform("grams", lambda x, i: F.when(i + width <= F.col("n_grams"), F.array_min(F.slice("grams", i + 1, width))))
    return df.withColumn("prints", F.array_distinct(least)).drop("grams", "n_grams")


def _windows(keyed: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The windows of items, broadcast if their texts are at most ``most`` bytes in all (counted), else for a join by shuffle."""
    windows = keyed.select("item_row", "item", "window", "spans")
    sized = F.octet_length("item") + F.aggregate("spans", F.lit(0), lambda n, s: n + F.octet_length(s))
    return F.broadcast(windows) if (windows.agg(F.sum(sized)).first()[0] or 0) <= most else windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items array<string>, contaminated) of every row of ``docs`` (doc_id, text, ...)."""
    if not 1 <= gram <= span:
        raise ValueError("gram is from 1 to span")
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    item = item.withColumn("window", F.least(F.size("words"), F.lit(span)))
    item = item.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # Short items: a fingerprint of all their words. Their lengths are fewer than ``span``.
    lengths = sorted(r[0] for r in item.where(F.col("window") < span).select("window").distinct().collect())
    item = with_fingerprints(item, span, gram)
    prints = F.when(F.col("window") == span, F.col("prints"))
    for n in lengths:
        prints = F.when(F.col("window") == n, ngram_hashes(F.col("h"), n)).otherwise(prints)
    spans = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("window")), lambda i: F.array_join(F.slice("words", i + 1, F.col("window")), " "))
    item = item.select("item", "window", prints.alias("prints"), F.array_distinct(spans).alias("spans"))
    keyed = settle(item.select("item", "window", F.monotonically_increasing_id().alias("item_row"), "prints", "spans"), "items")
    marks = settle(keyed.select("item_row", F.explode("prints").alias("f")).where("f is not null").distinct(), "marks")

    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    h = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    own = text.select("doc_id", "text_hash", h.alias("h"))
    own = with_fingerprints(own, span, gram)
    every = [F.col("prints"), *(ngram_hashes(F.col("h"), n) for n in lengths)]
    own = own.select("doc_id", "text_hash", F.explode(F.array_distinct(F.concat(*every))).alias("f")).where("f is not null")
    met = settle(own.join(small(marks), "f").groupBy("doc_id", "text_hash", "item_row").agg(F.collect_set("f").alias("found")), "met")

    some = settle(met.select("doc_id", "text_hash").distinct(), "some")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    few = small(some)
    # Extending is heavy for its bytes, so its partitions are set rather than merged by size.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = text.join(few, same(text, few), "left_semi").repartition(parts, "doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash"])
    sought = met.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("sought"))
    part = part.join(sought, same(part, sought)).select(part["doc_id"], part["text_hash"], "sought", words(F.col("text")).alias("words"))
    part = part.withColumn("n", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # Places of shared grams, by their length, with the words around them.
    sizes = sorted({gram, *lengths})
    for n in sizes:
        part = part.withColumn(f"g{n}", ngram_hashes(F.col("h"), n))
    placed = [F.filter(F.transform(f"g{n}", lambda g, i: F.struct(F.lit(n).alias("size"), i.alias("at"), g.alias("f"))), lambda x: F.array_contains("sought", x["f"])) for n in sizes]  # noqa: B023
    reach = span - gram
    spot = part.select("doc_id", "text_hash", "words", "n", F.explode(F.concat(*placed)).alias("x"))
    low = F.greatest(F.col("x.at") - reach, F.lit(0))
    spot = spot.select("doc_id", "text_hash", "n", F.col("x.size").alias("size"), F.col("x.at").alias("at"), F.col("x.f").alias("f"), low.alias("low"), F.slice("words", low + 1, span + reach).alias("near"))
    by_item = met.select("doc_id", "text_hash", "item_row", F.explode("found").alias("f"))
    pair = spot.join(by_item, same(spot, by_item) & (spot["f"] == by_item["f"])).select(spot["doc_id"], spot["text_hash"], "n", "size", "at", "low", "near", "item_row")
    pair = pair.join(_windows(keyed), "item_row")
    pair = pair.where(F.col("size") == F.when(F.col("window") == span, gram).otherwise(F.col("window")))
    # The windows that hold the gram, compared word by word; a short item's gram is its window.
    first = F.when(F.col("window") == span, F.col("low")).otherwise(F.col("at"))
    exact = lambda s: (s + F.col("window") <= F.col("n")) & F.array_contains("spans", F.array_join(F.slice("near", s - F.col("low") + 1, F.col("window")), " "))
    pair = pair.withColumn("starts", F.filter(F.sequence(first, F.col("at")), exact)).where(F.size("starts") > 0)
    hit = pair.withColumn("places", F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("window") - 1))))
    # Places first come together by document and item, then by document; neither holds more than the document's words.
    hit = hit.groupBy("doc_id", "text_hash", "item").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    hit = hit.groupBy("doc_id", "text_hash").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))

    all_ = text.select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = all_.join(hit, same(all_, hit), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(all_["doc_id"], "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), all_["text_hash"])
