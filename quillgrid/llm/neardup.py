"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each text becomes a set of word shingles (64-bit hashes) and a signature of
   ``coordinates`` minima. Texts with the same set form a class, which has a number of its own; only a
   representative text of it goes on. Rows that share a doc_id may be in several classes, which are then linked.
2. Representatives are posted under each (coordinate, value). Postings are ordered
   by global frequency; two signatures with at least ``matches`` equal coordinates
   must meet in the first ``coordinates - matches + 1`` (prefix). Values that one
   text alone has count as taken but are never posted.
3. In each posting list the most central member (fewest values of its own) is paired
   with the others; pairs are merged with a count of collisions, those whose
   signatures agree in fewer than ``matches`` coordinates go, and the rest is
   confirmed on the full sets. A list costs its length, not its square.
4. The rest, without loss: lists that still hold more than one component. Those of at
   most SHORT members are joined with themselves across components, with the length
   filter and the collision count (on four bits a coordinate, which only ever counts
   too many) inside the join: FLOOR matches, fewer than ``matches``, are enough for the
   full sets to decide. Longer ones are skipped by that merge; their members meet
   by an exact prefix-filtered join on full sets instead (rarest shingles first, length
   and positional filters). Both only look across components.

With 64 coordinates and 34 matches, an isolated pair at exactly the threshold of 0.8 fails
to become a candidate with probability below 1e-6, and far less the more alike it is.

Defined results: null, empty or blank texts have no shingles and link with nothing;
a text of fewer words than a shingle has one shingle of all its words; rows that share
a doc_id are one document; a null doc_id has a null component and is kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import kernel as K
from quillgrid.llm.graph import components
from quillgrid.llm.scratch import discard, release, settle, small

COORDINATES, MATCHES = 64, 34
#: Lists up to this length are joined with themselves; longer ones go the other exact way.
SHORT = 64
#: Pairs of short lists go to the full sets from so many matches on: a pair at exactly 0.8 has fewer with probability below 1e-9.
FLOOR = 28


def shingle_sets(batch: pa.RecordBatch, words_each: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a batch (doc_id, text)."""
    data, off = K.buffer_of(batch.column(1))
    data = K.LOWER[data]
    starts, ends, first = K.words(data, off)
    h = K.span_hashes(data, starts, ends)
    grams = K.ngram_hashes(h, words_each) if words_each > 1 else h
    for i in range(len(batch)):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= words_each:
            yield i, np.unique(grams[lo : hi - words_each + 1])
        elif hi > lo:
            yield i, K.ngram_hashes(np.concatenate([h[lo:hi], np.full(1, hi - lo, np.uint64)]), hi - lo + 1)
        else:
            yield i, np.zeros(0, np.uint64)


class Signer:
    """Minima of ``coordinates`` random bijections of 32-bit shingle values."""

    def __init__(self, coordinates: int, seed: int = 7) -> None:
        r = K.splitmix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))
        self.times = (r >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.xor = r.astype(np.uint32)

    def __call__(self, shingles: np.ndarray, block: int = 4096) -> np.ndarray:
        v = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
        least = [((v[i : i + block] ^ self.xor) * self.times).min(axis=0) for i in range(0, len(v), block)]
        return np.min(least, axis=0)


def nibbles(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates to a 64-bit number."""
    four = (signature & np.uint32(15)).astype(np.uint64)
    four = np.concatenate([four, np.zeros(-len(four) % 16, np.uint64)]).reshape(-1, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def unlike(x: str, y: str, coordinates: int) -> Column:
    """In how many coordinates the nibbles of two signatures differ."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(-(-coordinates // 16)):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        total = total + F.bit_count(d.bitwiseAND(ones))
    return total


def sketches(docs: DataFrame, words_each: int, coordinates: int, least: int) -> DataFrame:
    """(doc_id, th, n_shingles, k1, k2, sig, nib): hash of the text, set size, 128-bit key of the set, signature and its nibbles (null for sets under ``least``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(coordinates)
        for whole in batches:
            for batch in K.batches(whole, "text"):
                n, keys, sig, nib = [], [], [], []
                for _, s in shingle_sets(batch, words_each):
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    m = sign(s) if len(s) >= least else None
                    sig.append(None if m is None else m.view(np.int32))
                    nib.append(None if m is None else nibbles(m))
                k = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sig, pa.list_(pa.int32())), pa.array(nib, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "k1", "k2", "sig", "nib"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, th bigint, n_shingles bigint, k1 bigint, k2 bigint, sig array<int>, nib array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def full_sets(docs: DataFrame, ids: DataFrame, words_each: int) -> DataFrame:
    """(id, shingles) of ``ids`` (id, doc_id, th), found again from the text that doc_id and th name; once for each row that has it.

    Ids without doc_id and th are doc_ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.batches(whole, "text"):
                sets = [s.view(np.int64) for _, s in shingle_sets(batch, words_each)]
                yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    named = _texts(docs).join(small(ids), ["doc_id", "th"]) if "th" in ids.columns else _texts(docs).withColumnRenamed("doc_id", "id").join(small(ids), "id")
    return named.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def _named(rows: DataFrame) -> DataFrame:
    """The ids of ``rows``, with the text each stands for."""
    return rows.select("id", *(c for c in ("doc_id", "th") if c in rows.columns))


def settled_sets(docs: DataFrame, ids: DataFrame, words_each: int) -> DataFrame:
    """``full_sets``, written, each id once: only where rows repeat a text under its doc_id does that take a shuffle."""
    sets = settle(full_sets(docs, ids, words_each), "sets")
    if sets.count() == ids.count():
        return sets
    once = settle(sets.groupBy("id").agg(F.min("shingles").alias("shingles")), "sets")
    discard(sets)
    return once


def rare_first(items: DataFrame, total: Column, take: Column) -> DataFrame:
    """Prefix postings (id, n, own, key, pos) of ``items`` (id, n, key): keys rarest first, those of one id alone left out.

    ``total`` is the number of keys of an id and ``take`` how many of them are its prefix;
    ``own`` is how many keys no other id has: they fill the first places.
    """
    shared = items.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = items.join(shared, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    ranked = ranked.withColumn("own", total - F.size("keys")).withColumn("left", take - F.col("own")).where("left > 0")
    return ranked.select("id", "n", "own", F.posexplode(F.slice("keys", 1, F.col("left").cast("int"))).alias("i", "k")).select("id", "n", "own", F.col("k.key").alias("key"), (F.col("own") + F.col("i")).cast("int").alias("pos"))


def confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b), a settled table, whose full sets meet the threshold. Each side's set is joined by its id; a hot id's rows can be split."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(_named(signed), "id")
    ids = settle(ids, "ids")
    sets = settled_sets(docs, ids, words_each)
    got = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    links = settle(got.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    discard(ids, sets, pairs)
    return links


def _postings(signed: DataFrame, coordinates: int, matches: int) -> DataFrame:
    items = signed.select("id", "n", F.posexplode("sig").alias("c", "v")).select("id", "n", ((F.col("v").cast("bigint") + 2**31) * coordinates + F.col("c")).alias("key"))
    posts = rare_first(items, F.lit(coordinates), F.lit(coordinates - matches + 1))
    return settle(posts.select("id", "own", "key"), "posts")


def _stars(posts: DataFrame, signed: DataFrame, matches: int) -> DataFrame:
    """(a, b): each list's most central member with the others, where signatures agree often enough."""
    lists = posts.groupBy("key").agg(F.min(F.struct("own", "id")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.col("lead.id").alias("a"))
    pairs = posts.join(lists, "key").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("collisions"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    signs = signed.select("id", "sig")
    pairs = pairs.join(signs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").join(signs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    return settle(pairs.where(agree >= matches).select("a", "b"), "pairs")


def _short_lists(placed: DataFrame, signed: DataFrame, percent: int, coordinates: int, matches: int) -> DataFrame:
    """(a, b) across components in lists of at most SHORT members, by the collision count on nibbles."""
    posts = placed.join(signed.select("id", "n", "nib"), "id")
    x, y = posts.alias("x"), posts.alias("y")
    meet = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (unlike("x.nib", "y.nib", coordinates) <= coordinates - matches))
    return meet.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _long_lists(rest: DataFrame, docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """(a, b) across components among ``rest`` (id, doc_id, th, component), by an exact prefix join on full sets."""
    sets = settled_sets(docs, _named(rest), words_each)
    shingles = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    must = F.ceil(F.lit(percent) * F.col("n") / 100)
    narrow = rare_first(shingles, F.col("n"), F.col("n") - must + 1).join(rest.select("id", "component"), "id")
    x, y = narrow.alias("x"), narrow.alias("y")
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    meet = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * room >= percent * (F.col("x.n") + F.col("y.n"))))
    return meet.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _rest(posts: DataFrame, first: DataFrame, signed: DataFrame, docs: DataFrame, words_each: int, percent: int, coordinates: int, matches: int) -> DataFrame:
    """(a, b): what the stars left, over lists that still hold more than one component."""
    placed = settle(posts.select("id", "key").join(first, posts["id"] == first["node"], "left").select("id", "key", F.coalesce("component", "id").alias("component")), "placed")
    mixed = settle(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("key", "size"), "mixed")
    short = _short_lists(placed.join(mixed.where(F.col("size") <= SHORT), "key", "left_semi"), signed, percent, coordinates, min(matches, FLOOR * coordinates // COORDINATES))
    rest = placed.join(mixed.where(F.col("size") > SHORT), "key", "left_semi").select("id", "component").distinct()
    rest = settle(rest.join(_named(signed), "id"), "rest")
    late = settle(short.unionByName(_long_lists(rest, docs, words_each, percent)).distinct(), "late")
    discard(placed, mixed, rest)
    return late


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of every row of ``docs`` (doc_id, text, ...)."""
    if not 0 < percent <= 100:
        raise ValueError("percent is over 0 and at most 100")
    spark = docs.sparkSession
    # A set so small that one more shingle breaks the threshold is like equal sets only.
    least = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
    sketch = settle(sketches(docs, words_each, coordinates, least), "sketch")
    real = sketch.where("doc_id is not null and n_shingles > 0")
    # Written, so that the numbers of classes stay what they are.
    classes = real.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    classes = settle(classes.select("k1", "k2", "first.doc_id", "first.th", F.monotonically_increasing_id().alias("id")), "classes")
    member = settle(real.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id"), "member")
    signed = sketch.where("sig is not null").join(classes, ["k1", "k2", "doc_id", "th"])
    signed = settle(signed.select("id", "doc_id", "th", F.col("n_shingles").alias("n"), "sig", "nib").dropDuplicates(["id"]), "signed")
    release(spark)

    posts = _postings(signed, coordinates, matches)
    release(spark)
    links = confirmed(_stars(posts, signed, matches), signed, docs, words_each, percent)
    release(spark)
    # Rows that share a doc_id are one document, so their classes are linked.
    same = member.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v").select("doc_id", "u")
    same = member.join(same, "doc_id").select("u", F.col("id").alias("v")).distinct()
    first = settle(components(links.unionByName(same)), "first")
    release(spark)
    late = confirmed(_rest(posts, first, signed, docs, words_each, percent, coordinates, matches), signed, docs, words_each, percent)
    release(spark)
    linked = first
    if not late.isEmpty():
        linked = settle(components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late)), "linked")
    discard(posts, signed)

    # A component's number becomes the least doc_id in it; classes without links are components of their own.
    put = settle(classes.select("id", F.col("doc_id").alias("class_id")).join(linked, classes["id"] == linked["node"], "left").select("id", "class_id", F.coalesce("component", "id").alias("component")), "put")
    put = put.join(put.groupBy("component").agg(F.min("class_id").alias("component_id")), "component").select("id", "class_id", "component_id")
    placed = member.join(put, "id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
