"""Values as they are written into blanks: dates, numbers in parts, chosen options, printed widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.labels import trimmed

# Answers that tick or leave a single box.
YES = "(?i)^(y|yes|true|1|o|v|✓|✔|예|네|해당|있음|체크|선택|동의|동의함)$"
NO = "(?i)^(n|no|false|0|x|아니오|아니요|없음|해당없음|미동의|-)?$"
# Glyph widths in em by character class; measured ones first.
GLYPHS = {"space": 0.5, "wideSpace": 1.0, "hangul": 0.971, "digit": 0.55, "upper": 0.65, "lower": 0.602, "punct": 0.55, "hanja": 1.0, "wide": 1.0}
CLASSES = {"space": "[ \\u00a0]", "wideSpace": "\\u3000", "hangul": "[가-힣ᄀ-ᇿ㄰-㆏]", "digit": "[0-9]", "upper": "[A-Z]", "lower": "[a-z]", "hanja": "[一-鿿豈-﫿]", "punct": "[!-/:-@\\[-`{-~]"}
WIDE = "[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]"


def parse_date(value: Column, today: Column | None = None) -> Column:
    """struct<year, month, day> of strings, null if it is no date. The day may be missing; ranges are not checked; "today" needs ``today``."""
    v = trimmed(value)
    apart, close = r"^(\d{4})\D+(\d{1,2})(?:\D+(\d{1,2}))?\D*$", r"^(\d{4})(\d{2})(\d{2})$"
    part = lambda p, i: F.regexp_extract(v, p, i)
    plain = lambda c: F.when(c != "", c.cast("int").cast("string"))
    made = lambda p: F.struct(part(p, 1).alias("year"), plain(part(p, 2)).alias("month"), plain(part(p, 3)).alias("day"))
    out = F.when(v.rlike(apart), made(apart)).when(v.rlike(close), made(close))
    if today is not None:
        now = F.struct(F.year(today).cast("string").alias("year"), F.month(today).cast("string").alias("month"), F.dayofmonth(today).cast("string").alias("day"))
        out = F.when(v.rlike("(?i)^(today|오늘)$"), now).otherwise(out)
    return out


def split_number(value: Column, parts: int, label: Column | None = None) -> Column:
    """A number in ``parts`` pieces: at its hyphens (surplus ones stay in the last), or at places known by its length."""
    v = trimmed(value)
    label = F.lit("") if label is None else label
    pieces = F.split(v, "-")
    by_hyphen = [F.get(pieces, i) for i in range(parts - 1)] + [F.when(F.size(pieces) >= parts, F.array_join(F.slice(pieces, F.lit(parts), F.size(pieces)), "-"))]
    d = F.regexp_replace(v, r"\s", "")
    n = F.length(d)
    cut = lambda *at: F.array(*(F.substring(d, F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b) for a, b in at))
    whole = F.array(v, *(F.lit(None).cast("string") for _ in range(parts - 1)))
    out = F.when(v.contains("-"), F.array(*by_hyphen))
    if parts == 2:
        out = out.when(n == 13, cut((1, 6), (7, 7)))
    if parts == 3:
        area = F.when(d.startswith("02"), 2).otherwise(3)
        out = out.when(label.contains("사업자") & (n == 10), cut((1, 3), (4, 2), (6, 5)))
        out = out.when(n.between(9, 11), cut((1, area), (area + 1, n - 4 - area), (n - 3, 4)))
    return out.otherwise(whole)


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s()（）]+", ""))


def choose_options(options: Column, value: Column) -> Column:
    """The options (array of labels) a value picks, in the value's order; null where it picks none or several for one word."""
    v = trimmed(value)
    same = F.filter(options, lambda o: _bare(o) == _bare(v))
    words = F.filter(F.split(v, r"\s*[,;|]\s*|\s+/\s*|\s*/\s+"), lambda w: w != "")
    exact = lambda w: F.filter(options, lambda o: _bare(o) == _bare(w))
    near = lambda w: F.filter(options, lambda o: F.startswith(_bare(o), _bare(w)) | F.startswith(_bare(w), _bare(o)))
    hits = F.transform(words, lambda w: F.when(F.size(exact(w)) > 0, exact(w)).otherwise(near(w)))
    many = F.when(F.forall(hits, lambda h: F.size(h) == 1), F.flatten(hits))
    one = F.when(v.rlike(YES), options).when(v.rlike(NO), F.array().cast("array<string>"))
    return F.when(F.size(same) == 1, same).when(F.size(options) == 1, one).otherwise(many)


def text_width(text: Column) -> Column:
    """Printed width in em with the standard glyph widths: counts of each class, weighed."""
    total, seen = F.lit(0.0), F.lit(0)
    for name, pattern in CLASSES.items():
        n = F.regexp_count(text, F.lit(pattern))
        total, seen = total + n * GLYPHS[name], seen + n
    return total + (F.char_length(text) - seen) * GLYPHS["wide"]


def display_width(text: Column) -> Column:
    """Columns on a terminal: wide characters count two."""
    return F.char_length(text) + F.regexp_count(text, F.lit(WIDE))
