"""Lexical retrieval packing: a sharded BM25 index gives each seed document its unused neighbours, which fill its window.

1. Texts become token ids, the end id after each; a written table holds them, two or four bytes an id.
2. Full windows of long documents are sequences of their own. What is left of each document
   (all of a shorter one) is a remainder of less than a window.
3. Document frequencies of tokens are counted over all whole documents (a number for each id of
   the vocabulary, so they may be broadcast). The weight of a token is BM25's, its idf
   log((N - df + 0.5) / (df + 0.5)), 0 for tokens that half of the documents hold.
4. Remainders are range-partitioned by their two weightiest tokens and their row number, so
   remainders on one subject stand together while a subject, source or group of copies of any
   size is split. A task cuts its range into index shards of at most ``shard_tokens`` tokens and
   ``shard_docs`` remainders.
5. In a shard: an inverted index (token, remainder, BM25 weight). The next unused remainder is
   the seed of a window; all its tokens are the query; unused remainders follow by falling
   score (ties in order), then those that share no weighty token, in order. The one that
   passes the window's end is cut there, and its rest is the next seed.
6. What is left of a shard at its end is cut into sequences whose lengths are powers of two: no sequence is padded.

Numbers of sequences: even for full windows, odd for the others; in each kind the task's number and
a count within the task. Every task reads rows in a fixed order from a written table, so a
task that is run again numbers them alike.

Defined results: null and empty texts have the end id alone; rows that share a doc_id are
packed each for itself; a null doc_id stays null; ties go by order; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import kernel as K
from quillgrid.llm.scratch import settle

#: Ids in a sequence; ids and remainders in an index shard; ids in a partition of remainders.
WINDOW, SHARD_TOKENS, SHARD_DOCS, PARTITION_TOKENS = 2048, 1 << 19, 1 << 13, 1 << 22
#: Words whose ids a worker remembers, some 20 bytes each, and parts of words, some 200 bytes each.
REMEMBERED, REMEMBERED_PARTS = 1 << 21, 3 << 17
#: BM25's saturation of counts and its share of length.
K1, B = 1.2, 0.75
#: Bits of a sequence number that count within a task.
COUNT_BITS = 36


class Encoder:
    """Token ids of texts, exactly the tokenizer's own.

    A tokenizer that drops white space gives a text the ids of its words one after the other, and
    a word that starts with letters those of the letters and of the rest. The ids of words (by
    their 64-bit hash) and of such parts are remembered; only new parts are tokenized, plain letters many at once, as each of
    them ends with the one token that bears the tokenizer's end-of-word suffix. The ids of a block of texts are
    then taken together. Other tokenizers get whole texts.
    """

    #: Letters, then nothing or a rest that starts with an ASCII sign or digit, but not with an apostrophe, which may belong to the letters after it.
    CUT = re.compile(r"([^\W\d_]+)([!-&(-@\[-`{-~].*)?", re.S)
    #: Below it, letters are composed and lower case has one letter for each.
    SIMPLE = "\u0130"

    def __init__(self, file: str, remembered: int = REMEMBERED, remembered_parts: int = REMEMBERED_PARTS) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.parts: dict[str, bytes] = {}
        self.remembered, self.remembered_parts = remembered, remembered_parts
        self._forget()
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.last = np.zeros(size, bool)
        if suffix:
            self.last[[i for token, i in self.model.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self.by_words = self._ids(" a \t\r\n\v\f5. b ") == self._ids("a") + self._ids("5") + self._ids(".") + self._ids("b")

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, word: str) -> tuple[str, ...]:
        m = self.CUT.fullmatch(word)
        if not m or not m[1].isalpha():
            return (word,)
        letters = m[1].lower() if max(m[1]) < self.SIMPLE else m[1]
        return (letters, m[2]) if m[2] else (letters,)

    def _learn_parts(self, parts: list[str], run: int = 512) -> None:
        plain = [p for p in parts if p.isalpha() and max(p) < self.SIMPLE] if self.last.any() else []
        for i in range(0, len(plain), run):
            these = plain[i : i + run]
            ids = np.array(self._ids(" ".join(these)), self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * ids.itemsize
            if len(ends) != len(these):  # letters that aren't one run of letters to the tokenizer
                self.parts.update(zip(these, self._bytes(these)))
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            self.parts.update(zip(these, (raw[s:t] for s, t in zip([0, *ends], ends))))
        odd = [p for p in parts if p not in self.parts]
        self.parts.update(zip(odd, self._bytes(odd)))

    def _forget(self) -> None:
        """No word is known: the ids of the word of ``hashes[i]``, which ascend, are ``flat[begin[i] : begin[i] + size[i]]``."""
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.dtype)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        cut = [self._cut(w.decode()) for w in words]
        new = set().union(*cut).difference(self.parts)
        if len(self.parts) + len(new) > self.remembered_parts:
            self.parts.clear()
            new = set().union(*cut)
        self._learn_parts(sorted(new))
        ids = self.parts.__getitem__
        got = [b"".join(map(ids, c)) for c in cut]
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.flat.itemsize
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.size = np.insert(self.hashes, at, hashes), np.insert(self.size, at, size)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(size) - size)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(got), self.dtype)])

    def __call__(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``; ``data`` holds the texts' UTF-8, ``off`` where they start and end."""
        raw = data.tobytes()
        if not self.by_words:
            at = off.tolist()
            return self._bytes([raw[s:t].decode() for s, t in zip(at, at[1:])])
        starts, ends, first = K.words(data, off)
        hashes, at, of = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > self.remembered:
            self._forget()
        place = np.searchsorted(self.hashes, hashes)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == hashes[known]
        if not known.all():
            new = at[~known]
            self._learn(hashes[~known], [raw[s:t] for s, t in zip(starts[new].tolist(), ends[new].tolist())])
            place = np.searchsorted(self.hashes, hashes)
        begin, n = self.begin[place][of], self.size[place][of]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(begin - done[:-1], n) + np.arange(done[-1])]
        cuts = (done[first] * ids.itemsize).tolist()
        out = ids.tobytes()
        return [out[s:t] for s, t in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def encoder(file: str) -> Encoder:
    """The file's encoder, kept with what it remembers while a worker lives."""
    return Encoder(file)


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int = 1, window: int = WINDOW, block: int = K.SLICE) -> DataFrame:
    """(doc_id, ids, n, base) of each row: its ids with the end id as bytes, how many, and how many full windows stand before it in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer_file), 0
        end, size = np.array([end_id], encode.dtype).tobytes(), np.dtype(encode.dtype).itemsize
        for whole in batches:
            for batch in K.batches(whole, "text", block):
                data, off = K.buffer_of(batch.column(1))
                ids = [x + end for x in encode(data, off)]
                n = np.array([len(x) // size for x in ids], np.int64)
                full = n // window
                before = base + np.cumsum(full) - full
                base += int(full.sum())
                yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(before)], names=["doc_id", "ids", "n", "base"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids binary, n bigint, base bigint")


def _arrays(column: pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def frequencies(tokens: DataFrame, dtype: type, vocabulary: int) -> np.ndarray:
    """How many documents hold each id; a number for each id of the vocabulary, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in _arrays(batch.column(0), dtype):
                s = np.sort(ids, kind="stable")  # a radix sort
                df[s[np.concatenate([[True], s[1:] != s[:-1]])]] += 1
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], names=["id", "df"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id bigint, df bigint").groupBy("id").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.id] = r.df
    return out


def idf_of(df: np.ndarray, documents: int) -> np.ndarray:
    return np.maximum(np.log((documents - df + 0.5) / (df + 0.5)), 0.0)


def postings(remainders: list[np.ndarray], idf: np.ndarray, average: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, remainder, BM25 weight) of every weighty id in each remainder, by id and then remainder."""
    lengths = np.array([len(x) for x in remainders], np.int64)
    at = np.repeat(np.arange(len(remainders), dtype=np.int64), lengths)
    keys = np.sort(np.concatenate(remainders).astype(np.int64) * len(remainders) + at)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    tf = np.diff(np.append(first, len(keys)))
    term, doc = np.divmod(keys[first], len(remainders))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / average))
    keep = weight > 0
    return term[keep], doc[keep], weight[keep]


def subjects(remainders: list[np.ndarray], idf: np.ndarray, average: float) -> np.ndarray:
    """The two weightiest ids of each remainder, as one number; 0 where there is none."""
    term, doc, weight = postings(remainders, idf, average)
    order = np.lexsort((term, -weight, doc))
    term, doc = term[order] + 1, doc[order]
    first = np.searchsorted(doc, np.arange(len(remainders) + 1))
    has1, has2 = first[:-1] < first[1:], first[:-1] + 1 < first[1:]
    out = np.zeros(len(remainders), np.int64)
    out[has1] = term[first[:-1][has1]] << 32
    out[has2] += term[first[:-1][has2] + 1]
    return out


def fill_windows(remainders: list[np.ndarray], idf: np.ndarray, average: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of one shard: lists of (remainder, start, length). All but the last are full; lengths at the end are powers of two."""
    m = len(remainders)
    lengths = [len(x) for x in remainders]
    term, doc, weight = postings(remainders, idf, average)
    by_doc = np.argsort(doc, kind="stable")
    own_terms, own_first = term[by_doc], np.searchsorted(doc[by_doc], np.arange(m + 1))
    ids, id_first = np.unique(term, return_index=True)
    id_end = np.append(id_first[1:], len(term))
    unused, place = np.ones(m, bool), 0
    rest: tuple[int, int] | None = None
    while True:
        while place < m and not unused[place]:
            place += 1
        if rest is None and place == m:
            return
        seed, start = rest or (place, 0)
        unused[seed] = False
        row, room = [(seed, start, lengths[seed] - start)], window - lengths[seed] + start
        rest = None
        for near in _neighbours(seed, own_terms, own_first, ids, id_first, id_end, doc, weight, unused, place) if room else ():
            unused[near] = False
            took = min(room, lengths[near])
            row.append((near, 0, took))
            room -= took
            if not room:
                rest = (near, took) if took < lengths[near] else None
                break
        if not room:
            yield row
        else:
            yield from _powers(row)
            return


def _neighbours(seed, own_terms, own_first, ids, id_first, id_end, doc, weight, unused, place) -> Iterator[int]:
    """Unused remainders by falling score against the seed, then the others in order."""
    mine = own_terms[own_first[seed] : own_first[seed + 1]]
    if len(mine):
        scores = np.zeros(len(unused))
        at = np.searchsorted(ids, mine)
        for lo, hi in zip(id_first[at].tolist(), id_end[at].tolist()):
            scores[doc[lo:hi]] += weight[lo:hi]
        found = np.flatnonzero((scores > 0) & unused)
        for i in found[np.argsort(-scores[found], kind="stable")].tolist():
            yield i
    for i in range(place, len(unused)):
        if unused[i]:
            yield i


def _powers(row: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a row cut into sequences whose lengths are powers of two, longest first."""
    left = sum(x[2] for x in row)
    row = row[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            d, start, length = row.pop()
            took = min(room, length)
            out.append((d, start, took))
            room -= took
            if took < length:
                row.append((d, start + took, length - took))
        yield out


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])


def full_windows(tokens: DataFrame, dtype: type, window: int) -> DataFrame:
    """Each full window of each document, a sequence of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, raw, n, base in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = np.frombuffer(raw, dtype)[: n - n % window].astype("<u4")
                first = ((row >> 33) << COUNT_BITS) + base
                yield _batch([(doc_id, s, window, ids[s : s + window].tobytes(), n, 2 * (first + s // window), 0, window) for s in range(0, len(ids), window)])

    return tokens.where(F.col("n") >= window).select("doc_id", "row", "ids", "n", "base").mapInArrow(run, PIECES)


def remainders_of(tokens: DataFrame, dtype: type, idf: np.ndarray, average: float, window: int) -> DataFrame:
    """(doc_id, row, n, subject, ids) of what full windows leave of each document."""
    shared = tokens.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [x[len(x) - len(x) % window :] for x in _arrays(batch.column(3), dtype)]
            if left:
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(subjects(left, shared.value, average)), pa.array([x.tobytes() for x in left], pa.binary())], names=["doc_id", "row", "n", "subject", "ids"])

    return tokens.where(F.col("n") % window > 0).select("doc_id", "row", "n", "ids").mapInArrow(run, "doc_id bigint, row bigint, n bigint, subject bigint, ids binary")


def packed(remainders: DataFrame, dtype: type, idf: np.ndarray, average: float, window: int, shard_tokens: int, shard_docs: int) -> DataFrame:
    """The sequences of each shard; ``remainders`` are partitioned and sorted."""
    shared = remainders.sparkSession.sparkContext.broadcast(idf)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, tokens = [], 0
        for batch in batches:
            for doc_id, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(raw, dtype)
                if held and (tokens + len(ids) > shard_tokens or len(held) >= shard_docs):
                    yield held
                    held, tokens = [], 0
                held.append((doc_id, n, ids))
                tokens += len(ids)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << COUNT_BITS
        for shard in shards(batches):
            out = []
            for sequence in fill_windows([x[2] for x in shard], shared.value, average, window):
                offset, total = 0, sum(x[2] for x in sequence)
                for i, start, length in sequence:
                    doc_id, n, ids = shard[i]
                    out.append((doc_id, n - len(ids) + start, length, ids[start : start + length].astype("<u4").tobytes(), n, 2 * at + 1, offset, total))
                    offset += length
                at += 1
            yield _batch(out)

    return remainders.select("doc_id", "n", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens): every id of every document (doc_id, text, ...) in one piece of one sequence.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` is how many ids of the document
    stand before the piece, ``offset`` how many of the sequence. ``tokenizer_file`` lies on every machine.
    """
    if window < 1 or shard_tokens < window:
        raise ValueError("a window has an id at least, and a shard a window")
    known = encoder(tokenizer_file)
    dtype, vocabulary = known.dtype, max(known.model.get_vocab_size(with_added_tokens=True), end_id + 1)
    tokens = settle(tokenized(docs, tokenizer_file, end_id, window).withColumn("row", F.monotonically_increasing_id()), "tokens")
    documents, total, left = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") % window), F.lit(0))).first()
    idf = idf_of(frequencies(tokens, dtype, vocabulary), documents)
    average = left / documents if documents else 1.0
    spread = remainders_of(tokens, dtype, idf, max(average, 1.0), window).repartitionByRange(max(1, -(-left // partition_tokens)), "subject", "row").sortWithinPartitions("subject", "row")
    return full_windows(tokens, dtype, window).unionByName(packed(spread, dtype, idf, max(average, 1.0), window, shard_tokens, shard_docs))
