"""Cleaning of texts and names, colours, and positions of edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """CR LF and CR as LF, tabs as spaces, other control characters dropped."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.translate(t, "\t", " "), r"[\x00-\x09\x0b-\x1f]", "")


def safe_name(text: Column, most: int = 60) -> Column:
    """A file name: characters that systems refuse become _, at most ``most`` characters, never empty."""
    t = F.substring(F.trim(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]', "_")), 1, most)
    return F.when(t == "", "_").otherwise(t)


def is_coloured(hex_: Column) -> Column:
    """Whether #rrggbb is neither near black nor near white."""
    part = lambda i: F.conv(F.substring(F.regexp_replace(hex_, "^#", ""), i, 2), 16, 10).cast("int")
    ok = hex_.rlike("(?i)^#?[0-9a-f]{6}$")
    return F.coalesce(ok & (F.greatest(part(1), part(3), part(5)) > 64) & (F.least(part(1), part(3), part(5)) < 208), F.lit(False))


def replace_range(text: Column, start: Column, end: Column, insert: Column) -> Column:
    """Text with [start, end) replaced; null where the range is no range of the text."""
    n = F.char_length(text)
    ok = (start >= 0) & (start <= end) & (end <= n)
    return F.when(ok, F.concat(F.substring(text, F.lit(1), start), insert, F.substring(text, end + 1, n)))


def moved(position: Column, start: Column, end: Column, length: Column) -> Column:
    """Where a position is after [start, end) was replaced by ``length`` characters; inside it, as far from the start."""
    return F.when(position <= start, position).when(position >= end, position + length - (end - start)).otherwise(F.least(position, start + length))


def replayed(position: Column, log: Column) -> Column:
    """A position after a log (array<struct<start, end, length>>) of edits in order; null where an edit holds it inside."""
    step = lambda p, e: F.when(p.isNull() | ((p > e["start"]) & (p < e["end"])), F.lit(None).cast("bigint")).when(p >= e["end"], p + e["length"] - (e["end"] - e["start"])).otherwise(p)
    return F.aggregate(log, position.cast("bigint"), step)
