"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Statistics are found for whole Arrow batches in numpy; the model is fitted on the
driver from at most ``fit_rows`` labelled rows (a documented bound), is of fixed size,
and scores every whole text by flat-array traversal in the same pass that measures it.

Defined results: a null text counts as empty and is scored like one; without usable
labels every score is 0.5; several labels of one doc_id count as their majority (ties: 1);
null labels are ignored; a null doc_id is scored and never held out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm import kernel as K
from quillgrid.llm.boosting import Forest, fit
from quillgrid.llm.repetition import measure

FIT_ROWS = 20_000


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


CLASSES = {
    "lower": _class(bytes(range(0x61, 0x7B))),
    "upper": _class(bytes(range(0x41, 0x5B))),
    "digit": _class(bytes(range(0x30, 0x3A))),
    "point": _class(b".,;:!?'\"()-"),
    "symbol": _class(b"#*$%&|<>{}[]\\/=+_@~^"),
    "beyond": np.arange(256) >= 0x80,
    "break": _class(b"\n"),
}
MEASURED = ["dup_line_chars", "n_dup_lines", "n_repeat_words", "dup_chars_10"]
FEATURES = ["n_words", "n_bytes", "mean_word", "sd_word", "long_word", *CLASSES, "distinct_words", "top_word", "one_char_words", "plain_words", "capital_words", "stop_words", "entropy", *MEASURED]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x FEATURES of a text buffer."""
    rows = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    starts, ends, first = K.words(data, off)
    n = np.diff(first)
    words = np.maximum(n, 1).astype(float)
    row_of = np.repeat(np.arange(rows), n)
    length = (ends - starts).astype(float)
    per_row = lambda w, mask=None: np.bincount(row_of if mask is None else row_of[mask], weights=w if mask is None else w[mask], minlength=rows)
    mean = per_row(length) / words
    out = {"n_words": np.log1p(n), "n_bytes": np.log1p(np.diff(off)), "mean_word": mean, "sd_word": np.sqrt(np.maximum(per_row(length**2) / words - mean**2, 0))}
    out["long_word"] = np.zeros(rows)
    np.maximum.at(out["long_word"], row_of, length)
    for name, table in CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(table[data])])
        out[name] = (sums[off[1:]] - sums[off[:-1]]) / size
    h = K.span_hashes(K.LOWER[data], starts, ends)
    key = h ^ K.splitmix(row_of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(key)))
    owner = row_of[order[heads]] if len(key) else np.zeros(0, np.int64)
    out["distinct_words"] = np.bincount(owner, minlength=rows) / words
    top = np.zeros(rows)
    np.maximum.at(top, owner, count / words[owner])
    out["top_word"] = top
    p = count / words[owner]
    out["entropy"] = np.bincount(owner, weights=-p * np.log2(p), minlength=rows)
    one = np.ones(len(length))
    out["one_char_words"] = per_row(one, length == 1) / words
    odd = np.concatenate([[0], np.cumsum(~(CLASSES["lower"] | CLASSES["upper"] | CLASSES["beyond"])[data])])
    out["plain_words"] = per_row(one, odd[ends] == odd[starts]) / words
    out["capital_words"] = per_row(one, CLASSES["upper"][data[starts]]) / words if len(starts) else np.zeros(rows)
    out["stop_words"] = per_row(one, length <= 3) / words
    got = measure(data, off)
    chars = np.maximum(got["word_chars"], 1)
    for name in MEASURED:
        out[name] = got[name] / (words if name in ("n_dup_lines", "n_repeat_words") else chars)
    return np.stack([out[f] for f in FEATURES], axis=1) if rows else np.zeros((0, len(FEATURES)))


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """The model of ``labels`` (doc_id, quality), learnt from at most ``fit_rows`` rows that are not held out, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # fit_rows bounds this side, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.batches(whole, "text"):
                x = features(*K.buffer_of(batch.column(0)))
                yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").orderBy(F.xxhash64("x"), "y").limit(fit_rows).toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Forest, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability that the text is of quality 1. A column of that name is replaced."""
    docs = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.batches(whole, "text"):
                s = model.scores(features(*K.buffer_of(batch.column(place))))
                yield pa.record_batch([*batch.columns, pa.array(s)], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
