"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy over whole Arrow batches.

For each text: characters (code points in words) inside n-grams that occur at least
twice, for every length in LENGTHS, and inside lines equal to another line. A text
fails a length if the share of its word characters so covered exceeds that length's limit.

Defined results: a null text counts as empty; texts without words have zero counts,
fail the base rule for want of words and are not kept; repeated rows are judged each for itself;
extra columns are ignored; an empty table gives an empty result. Hashes are of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import kernel as K

#: Largest share, in hundredths, of word characters inside duplicated n-grams of each length.
LENGTHS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
#: The same for characters in duplicated lines.
LINES = 30
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE_GRAM = 5

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LENGTHS)]


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The COLUMNS of every row of a text buffer."""
    rows = len(off) - 1
    starts, ends, first = K.words(data, off)
    n_words = np.diff(first)
    row_of = np.repeat(np.arange(rows), n_words)
    points = _sums((data & 0xC0) != 0x80)
    chars = points[ends] - points[starts]
    char_sums = _sums(chars)
    out = {"n_words": n_words, "word_chars": char_sums[first[1:]] - char_sums[first[:-1]]}
    symbols = _sums(SYMBOLS[data])
    out["n_symbols"] = symbols[off[1:]] - symbols[off[:-1]]

    # Lines: cut at \n and at row ends; those with a word count.
    cut = np.flatnonzero(data == 0x0A)
    line_start = np.union1d(off[:-1][np.diff(off) > 0], cut + 1)
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    stop = np.append(line_start[1:], len(data))
    ends_nl = np.zeros(len(line_start), dtype=bool)
    if len(line_start):
        ends_nl = (stop > line_start) & (data[stop - 1] == 0x0A)
    line_end = stop - ends_nl
    word_lo, word_hi = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    has = word_hi > word_lo
    line_start, line_end, word_lo, word_hi = line_start[has], line_end[has], word_lo[has], word_hi[has]
    line_row = np.searchsorted(off, line_start, side="right") - 1
    key = K.span_hashes(data, line_start, line_end) ^ K.splitmix(line_row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    line_chars = char_sums[word_hi] - char_sums[word_lo]
    again = repeated(key)
    out["dup_line_chars"] = np.bincount(line_row[again], weights=line_chars[again], minlength=rows).astype(np.int64)

    # n-grams: one hash grows from length to length.
    h = K.span_hashes(data, starts, ends)
    salt = K.splitmix(row_of.astype(np.uint64) + np.uint64(1))
    left = first[1:][row_of] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
    roll = h.copy()
    for n in range(2, max(LENGTHS) + 1):
        m = max(len(h) - n + 1, 0)
        roll = roll[:m] * np.uint64(K.MULT) + h[n - 1 : n - 1 + m]
        if n not in LENGTHS:
            continue
        at = np.flatnonzero(left[:m] >= n)
        hits = at[repeated(roll[at] ^ salt[at])]
        step = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(step, hits, 1)
        np.add.at(step, hits + n, -1)
        covered = np.cumsum(step[:-1]) > 0
        out[f"dup_chars_{n}"] = np.bincount(row_of[covered], weights=chars[covered], minlength=rows).astype(np.int64)
        if n == BASE_GRAM:
            out["n_repeat_words"] = np.bincount(row_of[covered], minlength=rows)
    return out


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the COLUMNS, base_failed, repetitive (the method's verdict) and kept, for each row of ``docs`` (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.batches(whole, "text"):
                got = measure(*K.buffer_of(batch.column(1)))
                yield pa.record_batch([batch.column(0), *(pa.array(got[c].astype(np.int64)) for c in COLUMNS)], names=["doc_id", *COLUMNS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COLUMNS))
    over = [100 * F.col(f"dup_chars_{n}") > limit * F.col("word_chars") for n, limit in LENGTHS.items()]
    over.append(100 * F.col("dup_line_chars") > LINES * F.col("word_chars"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("repetitive", F.array_max(F.array(*over)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("repetitive"))
