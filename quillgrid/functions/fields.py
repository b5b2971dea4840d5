"""Facts of forms that stand in one value: names of form files, guide texts of fields, control characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in names of files that are notices and no forms, and words that outweigh them.
NO_FORM = "(?i)공고|직무기술서|안내|요강|Q&A|FAQ|모집"
STRONG = "서식|양식|별지|지원서|원서"
# Control characters with a record of their own, and those that hold eight units in place.
EXTENDED = (1, 2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23)
INLINE = (4, 5, 6, 7, 8, 9, 19, 20)
PARAGRAPH_END = 13


def is_form(slot: Column, name: Column, form: str, extensions: tuple[str, ...] = ("hwp", "hwpx")) -> Column:
    """Whether a file is a form: by its extension, the slot it was offered in, and the words of its name (``form``: a pattern)."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    kind = F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))
    notice = stem.rlike(NO_FORM) & ~stem.rlike(STRONG)
    return F.coalesce(kind.isin(*extensions) & ~stem.contains("공고문") & (F.coalesce(slot == "입사지원서", F.lit(False)) | (~notice & stem.rlike(form))), F.lit(False))


def guide_text(command: Column) -> Column:
    """The text that asks for a click: told with its length, or the first of parts apart by semicolons (escaped by a backslash)."""
    counted, parts = r"(?s)^.*?Direction:wstring:(\d+):(.*)$", r"(?s)^((?:[^;\\]|\\.)*);.*$"
    told = F.substr(F.regexp_extract(command, counted, 2), F.lit(1), F.regexp_extract(command, counted, 1).try_cast("int"))
    first = F.regexp_replace(F.regexp_extract(command, parts, 1), r"\\(.)", "$1")
    return F.when(command.rlike(counted), told).when(command.rlike(parts), first)


def control_kind(code: Column) -> Column:
    """extended, inline or char for the control characters 0 to 31, else null."""
    return F.when(code.isin(*EXTENDED), "extended").when(code.isin(*INLINE), "inline").when(code.between(0, 31), "char")


def control_mask(codes: Column) -> Column:
    """bigint with the bit of each control among ``codes`` (array<int>, one for each unit that is read), the paragraph's end aside."""
    own = F.filter(codes, lambda c: c.between(0, 31) & (c != PARAGRAPH_END))
    return F.aggregate(F.array_distinct(own), F.lit(0).cast("bigint"), lambda m, c: m + F.pow(F.lit(2.0), c).cast("bigint"))


def splits_pair(units: Column, at: Column) -> Column:
    """Whether place ``at`` of UTF-16 ``units`` (array<int>) lies inside a surrogate pair."""
    high, low = F.get(units, (at - 1).cast("int")), F.get(units, at.cast("int"))
    return F.coalesce(high.between(0xD800, 0xDBFF) & low.between(0xDC00, 0xDFFF), F.lit(False))
