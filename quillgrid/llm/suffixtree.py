"""Language-model scores by a probabilistic suffix tree over the words of running text.

Symbols are the tokens of a text, its words and one end. A context is a run of up to
ORDER tokens before a symbol, from the start of the text on. The root's distribution is
P(w) = (c + 0.1) / (N + 0.1 (V + 1)) of the training tokens, all unknown words as one.
A context s is a candidate if it is seen LEAST times, a fixed count, so the tree grows
with the corpus. Its own symbols S are those seen c(s, w) >= 2 times, with a share of at
least SHARE in its t occurrences (the least probability such trees tell from none), that
diverges from what its longest retained suffix says: c ln((c - 1) / (t P(w | suffix))) of
at least OWN nats. With F = t - sum over S of (c - 1),
P(w | s) = ((c - 1 if w in S else 0) + F * P(w | suffix)) / t, which sums to one. The context
is retained if that diverges from the suffix's distribution: log likelihood of its
occurrences over the suffix's, each left out of its own estimate, of at least GAIN nats.
Every symbol is scored in the longest retained suffix of what precedes it.

The tree is grown order by order over whole training texts: counts of (context, symbol)
are combined in each slice of text, in each task and then by a shuffle on both, so a
frequent context is spread over tasks; divergence is summed by context and pruned in
Spark, and only retained contexts go on. The tree is kept as two tables: what a retained
context adds to the log probability of any symbol over its suffix's, log10(F / t), and
what it adds besides for a symbol of its own. Along the suffixes of a place these sum
to the score in the longest retained one, so places need no order.

A text adds up its tokens' scores. Nothing is gathered before it was counted. Of words,
of contexts and of pairs of a context and a symbol the most frequent ones (at most WORDS, HELD
and PAIRS, down to a count that a histogram tells) are broadcast and added in place; the rest
is asked for by key and joined. Bit maps of at most 2**BITS bits leave out most of the contexts
and pairs that are not in the tree, and, while it is grown, of the pairs that follow no candidate
where these are more than HELD. Words and contexts are told apart by 64-bit hashes.

Defined results: null and blank texts have one token, the end; the words of rows held
out are scored like any others; rows alike in doc_id and text are scored each; a null
doc_id trains; without training rows N = V = 0 and every token has the probability one;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import kernel as K
from quillgrid.llm.scratch import discard, release, settle, small

ORDER, LEAST, GAIN, OWN, SHARE = 3, 32, 8.0, 2.0, 0.001
#: Contexts (24 bytes each) that are broadcast at most; more are joined.
HELD = 1 << 20
#: Pairs that a task counts at once, and tokens for each part of the shuffle of pairs.
FLUSH = 1 << 20
#: Words, and pairs of a context and a symbol, that are broadcast at most.
WORDS, PAIRS = 1 << 19, 1 << 19
#: Bits of a map of contexts or pairs that are joined, as a power of two, at most.
BITS = 29
#: Hashes that stand for the start and the end of a text.
START_WORD, END_WORD = 0x51A27C0DE5EED001, 0x51A27C0DE5EED002
END = np.uint64(END_WORD).astype(np.int64).item()
SLICE = 1 << 20


def fold(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a context with one more word."""
    return K.splitmix(context * np.uint64(K.MULT) + word)


def folds(seq: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For d = 1, 2, ...: the key of the d words that end at each place of ``seq``; the first d - 1 places mean nothing."""
    key = K.splitmix(seq)
    yield key
    for _ in range(1, order):
        key = fold(np.concatenate([key[:1], key[:-1]]), seq)
        yield key


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts with the start and the end of each, their rows and their places."""
    data, off = K.buffer_of(column)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, off)
    size = np.diff(first) + 2
    bounds = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - bounds[row]
    inner = np.ones(len(row), dtype=bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    seq = np.full(len(row), START_WORD, np.uint64)
    seq[inner] = K.span_hashes(data, starts, ends)
    seq[bounds[1:] - 1] = END_WORD
    return seq, row, place


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from K.batches(whole, "text", SLICE)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, and how often it does."""
    order = np.argsort(key)
    ranked = key[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), ranked[1:] != ranked[:-1]]))
    return order[head], np.diff(np.append(head, len(key)))


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, c): training tokens of each word and of the end, over ``rows`` (text, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seq, _, place = sequences(batch.column(0))
            seq = seq[place > 0]
            at, c = counted(seq)
            yield pa.record_batch([pa.array(seq[at].view(np.int64)), pa.array(c)], names=["h", "c"])

    return rows.where("train").select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def gathered(rows: DataFrame) -> K.Table:
    """A table (key, value, ...) that was counted first."""
    got = rows.toArrow()
    return K.Table(*(got.column(i).to_numpy() for i in range(got.num_columns)))


def planes(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next ones, and so on: what small or sorted numbers have alike stands together, where a shuffle's compression finds it."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: pa.Scalar, n: int) -> np.ndarray:
    got = np.frombuffer(data.as_buffer(), np.uint8)
    return np.ascontiguousarray(got.reshape(-1, n).T).view(f"i{len(got) // n}").ravel().astype(np.int64)


def summed(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, and the sum of its counts."""
    order = np.argsort(key)
    ranked = key[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), ranked[1:] != ranked[:-1]]))
    return order[head], np.add.reduceat(c[order], head) if len(head) else c[:0]


def dealt(at: np.ndarray, w: np.ndarray, word: np.ndarray, c: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Counted pairs of a context and a symbol (its hash ``w``, its place ``word`` among frequent words or -1) in ``parts`` by key, a row of bytes for each part and kind."""
    part = (fold(at.view(np.uint64), w) % np.uint64(parts)).astype(np.int64)
    for often in (True, False):
        here = np.flatnonzero((word >= 0) == often)
        here = here[np.lexsort((at[here], part[here]))]
        symbols = word[here].astype(np.int32) if often else w[here].view(np.int64)
        columns = [at[here], symbols, c[here].astype(np.int32)]
        if here.size and 0 <= columns[0].min() and columns[0].max() < 1 << 31:
            columns[0] = columns[0].astype(np.int32)
        bounds = np.searchsorted(part[here], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(bounds))
        data = [pa.array([planes(x[bounds[i] : bounds[i + 1]]) for i in some], pa.binary()) for x in columns]
        yield pa.record_batch([pa.array(some), pa.array(np.full(len(some), often)), pa.array(np.diff(bounds)[some]), *data], names=["part", "often", "n", "at", "w", "c"])


def followers(rows: DataFrame, contexts: DataFrame, d: int, words: K.Table, part: float, held: int) -> DataFrame:
    """Symbols seen twice or more after each of ``contexts`` (context, t, chain, u1, ...) of d words, over whole training texts.

    (context, w, c, t, chain, root, longer, u1, ...): root is log10 of the root's P(w), null for a word that is not in ``words``,
    longer the key of context and symbol, u1, u2, ... those of its suffixes, the longest first. Symbols that can neither be the
    context's own nor end a longer context are left out. Pairs are counted for FLUSH of them at once, then shuffled
    in parts that grow in number with the corpus, not in size, and counted there.
    """
    few = contexts.limit(held + 1).count() <= held
    table = gathered(contexts) if few else None
    met = None if few else BitMap(contexts.select(F.col("context").alias("key")), contexts.count(), BITS)
    send = rows.sparkSession.sparkContext.broadcast((table, words, met))
    shorter = [f"u{k}" for k in range(1, d)]
    names = ["context", "w", "c", "t", "chain", "root", "longer", *(f"u{k}" for k in range(1, d + 1))]
    parts = int(part) // FLUSH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, met = send.value
        fewest = words.values[0].min(initial=np.iinfo(np.int64).max)  # other words are at most as frequent
        most = np.append(words.values[0], fewest)
        kept: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            told, w, word = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            first, c = counted(fold(told.view(np.uint64), w))
            yield from dealt(told[first], w[first], word[first], c, parts)

        for batch in slices(batches):
            seq, _, place = sequences(batch.column(0))
            *_, key = folds(seq, d)
            at = np.flatnonzero(place >= d)
            context, w = key[at - 1], seq[at]
            word = words.find(w)
            if table is not None:  # contexts travel as their places in the table, which pack better
                told = table.find(context)
                # A pair is seen as often as its symbol at most: too rarely to be the context's own, or to be a context?
                here = (told >= 0) & ((most[word] >= LEAST) | (most[word] >= SHARE * np.append(table.values[0], 0)[told]))
            else:
                told = context.view(np.int64)
                here = met.may(context)
            kept.append((told[here], w[here], word[here]))
            if sum(len(x[0]) for x in kept) >= FLUSH:
                yield from flush()
        if kept:
            yield from flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, _ = send.value
        got: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for often, n, *data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), *batch.columns[3:]):
                at, w, c = (from_planes(x, n) for x in data)
                got.append((at, words.keys[w].view(np.int64) if often else w, c))
        if got:
            at, w, c = (np.concatenate(x) for x in zip(*got))
            got.clear()
            first, c = summed(fold(at.view(np.uint64), w.view(np.uint64)), c)
            first, c = first[c > 1], c[c > 1]
            at, w = at[first], w[first]
            for i in range(0, len(at), 1 << 16):
                yield pa.record_batch([pa.array(x[i : i + (1 << 16)]) for x in (at, w, c)], names=["at", "w", "c"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, _ = send.value
        for batch in merged(batches) if table is not None else batches:
            at, w, c, *more = (x.to_numpy() for x in batch.columns)
            if table is not None:
                at, more = table.keys[at].view(np.int64), [x[at] for x in table.values]
            t, chain, *suffixes = more
            word = words.find(w)
            root = np.where(word >= 0, np.log10((np.append(words.values[0], 0)[word] + 0.1) / part), np.nan)
            # P(w | suffix) is no less than what the suffixes leave to any symbol; most chance pairs end here.
            likely = (c >= SHARE * t) & (c * (np.log((c - 1) / t) - np.log(10) * (root + chain)) >= OWN)
            keep = likely | (word < 0) | (c >= (LEAST if d < ORDER else np.inf))
            u = [x.view(np.uint64) for x in (at, *suffixes)]
            w64 = w.view(np.uint64)
            keys = [fold(x, w64).view(np.int64) for x in u] + [K.splitmix(w64).view(np.int64)]
            out = [pa.array(x) for x in (at, w, c, t, chain)] + [pa.array(root, from_pandas=True)] + [pa.array(x) for x in keys]
            yield pa.record_batch([x.filter(pa.array(keep)) for x in out], names=names)

    got = rows.where("train").select("text").mapInArrow(run, "part bigint, often boolean, n bigint, at binary, w binary, c binary").repartition(parts, "part")
    if not few:
        got = got.mapInArrow(merged, "at bigint, w bigint, c bigint")
        got = got.join(contexts.withColumnRenamed("context", "at"), "at").select("at", "w", "c", "t", "chain", *shorter)
    kinds = {"chain": "double", "root": "double"}
    return got.mapInArrow(keyed, ", ".join(f"{x} {kinds.get(x, 'bigint')}" for x in names))


def train(rows: DataFrame, vocabulary: DataFrame, words: K.Table, part: float, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """The tree of ``rows`` (text, train), two settled tables: (key, delta, c) of contexts and of pairs seen c times.

    ``vocabulary`` (h, c) has the training counts of words and the end, ``words`` those of frequent ones, ``part`` is N + 0.1 (V + 1).
    """
    spark = rows.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(K.splitmix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64)), batch.column(1)], names=["context", "t"])

    # Each training text has one start and one end.
    start = F.when(F.col("h") == END, np.uint64(START_WORD).astype(np.int64).item()).otherwise(F.col("h"))
    contexts = vocabulary.where(F.col("c") >= LEAST).select(start.alias("h"), "c").mapInArrow(first, "context bigint, t bigint")
    contexts = settle(contexts.withColumn("chain", F.lit(0.0)), "contexts")
    root = vocabulary.select(F.col("h").alias("w"), F.log10((F.col("c") + 0.1) / part).alias("seldom"))
    states, pairs, done = [], [], [contexts]
    for d in range(1, ORDER + 1):
        found = settle(followers(rows, contexts, d, words, part, held), "followers")
        release(spark)
        had = ["context", "c", "t", "longer", *(f"u{k}" for k in range(1, d))]
        rare = found.where("root is null").join(root, "w").withColumn("root", F.col("seldom")).select(*found.columns)
        own = found.where("root is not null").unionByName(rare).where(F.col("c") >= SHARE * F.col("t")).select(*had, (F.col("root") + F.col("chain")).alias("below"))
        for k in range(1, d):  # what shorter contexts add for the symbol
            lower = reduce(DataFrame.unionByName, pairs).select(F.col("key").alias(f"u{k}"), F.col("delta").alias("_add"))
            own = own.join(lower, f"u{k}", "left").withColumn("below", F.col("below") + F.coalesce("_add", F.lit(0.0))).drop("_add")
        b = F.pow(F.lit(10.0), "below")
        own = own.where(F.col("c") * F.log((F.col("c") - 1) / (F.col("t") * b)) >= OWN)
        own = settle(own.select("context", "c", "t", "longer", "below"), "own")
        facts = own.groupBy("context").agg((F.max("t") - F.sum(F.col("c") - 1)).alias("f"), (F.max("t") - F.sum("c")).alias("others"), F.max("t").alias("seen"))
        release(spark)
        facts = settle(facts, "facts")
        gain = own.join(small(facts), "context").groupBy("context").agg(F.sum(F.col("c") * F.log((F.col("c") - 2 + F.col("f") * b) / ((F.col("t") - 1) * b))).alias("gain"))
        others = F.when(F.col("others") > 0, F.col("others") * F.log((F.col("f") - 1) / (F.col("seen") - 1))).otherwise(0.0)
        kept = facts.join(gain, "context").where(F.col("gain") + others >= GAIN)
        kept = settle(kept.select("context", "f", "seen", F.log10(F.col("f") / F.col("seen")).alias("back")), "kept")
        p = F.log10((F.col("c") - 1 + F.col("f") * b) / F.col("t"))
        new = own.join(small(kept.drop("seen")), "context").select(F.col("longer").alias("key"), (p - F.col("below") - F.col("back")).alias("delta"), "c")
        pairs.append(settle(new, "pairs"))
        states.append(kept.select(F.col("context").alias("key"), F.col("back").alias("delta"), F.col("seen").alias("c")))
        # The next contexts, with what their suffixes add for any symbol.
        longer = found.where((F.col("w") != END) & (F.col("c") >= LEAST)).select(F.col("longer").alias("context"), F.col("c").alias("t"), *(f"u{k}" for k in range(1, d + 1)))
        chains = contexts.select(F.col("context").alias("u1"), "chain").join(kept.select(F.col("context").alias("u1"), "back"), "u1", "left").select("u1", (F.col("chain") + F.coalesce("back", F.lit(0.0))).alias("chain"))
        contexts = settle(longer.join(chains, "u1").select("context", "t", "chain", *(f"u{k}" for k in range(1, d + 1))), "contexts")
        discard(found, own, facts)
        done += [kept, contexts]
        release(spark)
        if contexts.isEmpty():
            break
    out = settle(reduce(DataFrame.unionByName, states), "states"), reduce(DataFrame.unionByName, pairs)
    discard(*done)
    release(spark)
    return out


class BitMap:
    """Which keys may be in a table: a bit for the leading bits of each."""

    def __init__(self, keys: DataFrame, count: int, most: int) -> None:
        self.bits = min(max((16 * count).bit_length(), 6), most)
        slot = F.shiftrightunsigned("key", 64 - self.bits)
        got = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("word"))
        got = got.toArrow()  # at most 2**(bits - 6) rows
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)

    def may(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.bits)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def followed(seq: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int, contexts: K.Table, pairs: K.Table, rare: BitMap, late: BitMap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What contexts add to each text's log10 probability, as far as ``contexts`` and ``pairs`` go; rows and keys of the contexts and pairs to be asked for."""
    out, asking, asked = np.zeros(rows), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for d, key in enumerate(folds(seq, ORDER), 1):
        at = np.flatnonzero(place >= d)
        before = key[at - 1]
        i = contexts.find(before)
        more = (i < 0) & rare.may(before)
        asking.append(row[at[more]])
        asked.append(before[more])
        out += np.bincount(row[at[i >= 0]], contexts.values[0][i[i >= 0]], rows)
        at = at[more | (i >= 0)]
        pair = fold(key[at - 1], seq[at])
        j = pairs.find(pair)
        out += np.bincount(row[at[j >= 0]], pairs.values[0][j[j >= 0]], rows)
        rest = np.flatnonzero(j < 0)
        rest = rest[late.may(pair[rest])]
        asking.append(row[at[rest]])
        asked.append(pair[rest])
    return out, np.concatenate(asking), np.concatenate(asked)


def divided(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` with the largest c, ``most`` at most, and the rest: divided at a count that a histogram of the counts' logarithms tells."""
    steps = 16  # to a doubling
    step = F.floor(F.log2("c") * steps)
    total, least = 0, None
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):  # at most 64 * steps rows
        total += r["rows"]
        if total > most:
            break
        least = r.step
    top = F.lit(False) if least is None else step >= least
    return table.where(top), table.where(~top)


def score(docs: DataFrame, words: int = WORDS, pairs: int = PAIRS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    out_of_fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (~out_of_fold).alias("train"))
    vocabulary = settle(word_counts(rows), "words")
    facts = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = facts[0], facts[1]
    release(spark)
    part = n + 0.1 * (v + 1)
    often, rare_words = divided(vocabulary, words)
    often = gathered(often)
    states, tree = train(rows, vocabulary, often, part, held)
    near, far = divided(states, held)
    told, seldom = divided(tree, pairs)
    rare, late = (BitMap(x, x.count(), BITS) for x in (far, seldom))
    send = spark.sparkContext.broadcast((often, gathered(near.select("key", "delta")), gathered(told.select("key", "delta")), rare, late))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts, pairs, rare, late = send.value
        base = np.append(np.log10((words.values[0] + 0.1) / part), np.log10(0.1 / part))  # the last: not met
        for batch in slices(batches):
            size = len(batch)
            seq, row, place = sequences(batch.column(1))
            token, owner = seq[place > 0], row[place > 0]
            at = words.find(token)
            more, asking, asked = followed(seq, row, place, size, contexts, pairs, rare, late)
            asking, asked = np.concatenate([owner[at < 0], asking]), np.concatenate([token[at < 0], asked])
            pick, m = counted(K.splitmix(asked ^ K.splitmix(asking.astype(np.uint64))))
            order = np.argsort(asking[pick], kind="stable")
            pick, m = pick[order], m[order]
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(asking[pick], minlength=size))]).astype(np.int32))
            open_ = pa.StructArray.from_arrays([pa.array(asked[pick].view(np.int64)), pa.array(m.astype(np.int32))], names=["key", "m"])
            tokens, known = (np.bincount(x, minlength=size) for x in (owner, owner[at >= 0]))
            sums = np.bincount(owner, base[at], size)
            yield pa.record_batch([batch.column(0), batch.column(2), *map(pa.array, (tokens, known, sums, more)), pa.ListArray.from_arrays(bounds, open_)], names=names)

    names = ["doc_id", "train", "n_tokens", "known", "base", "more", "open"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = rows.select("doc_id", "text", "train")
    parts = asked.mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens bigint, known bigint, base double, more double, open array<struct<key:bigint,m:int>>")
    parts = settle(parts.withColumn("r", F.monotonically_increasing_id()), "parts")
    release(spark)
    # Rare words, contexts and pairs, one join: what each adds, and whether it is a word.
    adds = rare_words.select(F.col("h").alias("key"), F.log10((F.col("c") + 0.1) / 0.1).alias("delta"), F.lit(1).alias("word"))
    adds = adds.unionByName(seldom.unionByName(far).select("key", "delta", F.lit(0).alias("word")))
    open_ = parts.select("r", F.explode("open").alias("x")).select("r", F.col("x.key").alias("key"), F.col("x.m").alias("m")).join(adds, "key")
    add = F.col("m") * F.col("delta")
    met = open_.groupBy("r").agg(F.sum(F.col("m") * F.col("word")).alias("met"), F.sum(add * F.col("word")).alias("word_adds"), F.sum(add * (1 - F.col("word"))).alias("pair_adds"))
    out = parts.drop("open").join(met, "r", "left")
    added = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("doc_id", "train", "n_tokens", (F.col("known") + added("met")).alias("n_known"), (F.col("base") + added("word_adds")).alias("base_score"), (F.col("more") + added("pair_adds")).alias("more"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("more")).alias("score"))
