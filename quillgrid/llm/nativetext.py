"""Words of texts by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is neither a digit nor a letter ends a word; everything beyond ASCII is in one.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else; pure ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def ngram_hashes(hashes: Column, n: int) -> Column:
    """The hash of each run of n elements of an array of hashes."""
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(n))))).otherwise(F.array().cast("array<bigint>"))
