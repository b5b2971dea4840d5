"""Label text as Spark columns: normalisation, the label predicate, aliases and parties."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which characters count as spacing, bullets, end marks and brackets.
SPACING = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\x0b"
BULLETS = "*※·•▪□■○●◦◎\\-–—"
END_MARKS = ":：.。"
OPEN, CLOSE = "(（\\[［<〈「『", ")）\\]］>〉」』"
# Words for the person who fills the form, and for anybody else.
SELF_PARTIES = ["신청인", "신청자", "신고인", "청구인", "지원자", "응시자", "본인", "작성자", "민원인", "제출자"]
OTHER_PARTY = "대리인|배우자|보호자|위임|수임|피신청인|상대방|피고|채무자|보증인|추천인|부모|가족|동거인|세대원|증인|자녀|법정대리|담당자|확인자|대표자"
# Groups of column names that mean the same.
ALIAS_GROUPS = [
    ["성명", "이름", "성함", "이름(한글)", "성명(한글)"],
    ["영문성명", "성명(영문)", "영문이름", "이름(영문)"],
    ["생년월일", "출생일", "생일"],
    ["주민등록번호", "주민번호"],
    ["주소", "주소지", "거주지", "현주소"],
    ["전화번호", "전화", "연락처"],
    ["휴대전화", "휴대폰", "휴대전화번호", "핸드폰", "휴대폰번호", "이동전화"],
    ["전자우편", "이메일", "e-mail", "email", "전자우편주소", "전자우편(이메일)"],
    ["소속", "소속기관", "근무처", "직장"],
    ["직위", "직급", "직책", "직급(직위)"],
    ["날짜", "작성일", "작성일자", "신청일", "신청일자", "제출일", "제출일자", "일자", "연월일", "년월일"],
]


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition, the one step of normalisation that Spark has no function for. Apply it where texts may be decomposed."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalise_label(text: Column) -> Column:
    """A label for comparison, from composed text. The order of the steps matters: the end marks go before brackets are opened."""
    t = F.regexp_replace(text, f"[{SPACING}]+", "")
    t = F.regexp_replace(t, f"^[{BULLETS}]+", "")
    t = F.regexp_replace(t, f"[{END_MARKS}]+$", "")
    t = F.regexp_replace(t, f"^[{OPEN}](.*)[{CLOSE}]$", "$1")
    return F.lower(t)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACING}]+|[{SPACING}]+$", "")


def looks_like_label(text: Column) -> Column:
    """Whether a text can name the blank next to it: no note, at most 24 units, no long sentence, no mere number."""
    t, n = trimmed(text), normalise_label(text)
    size = F.octet_length(F.encode(n, "UTF-16LE")) / 2
    sentence = t.rlike(r"[.?!。]$") & (size > 12)
    return F.coalesce((t != "") & ~t.rlike("^[*※]") & (n != "") & (size <= 24) & ~sentence & ~t.rlike(f"^[\\d{SPACING}.,~\\-:/()]+$"), F.lit(False))


_AROUND = re.compile(f"^[{SPACING}]+|[{SPACING}]+$")
_STEPS = ((f"[{SPACING}]+", ""), (f"^[{BULLETS}]+", ""), (f"[{END_MARKS}]+$", ""), (f"^[{OPEN}](.*)[{CLOSE}]$", r"\1"))
_NO_LABEL = re.compile(f"[*※]|[\\d{SPACING}.,~\\-:/()]+$")


def is_label(text: str) -> bool:
    """looks_like_label of one text, for the readers of forms that work in Python; texts may be decomposed."""
    name = unicodedata.normalize("NFC", text)
    shown = _AROUND.sub("", name)
    for pattern, by in _STEPS:
        name = re.sub(pattern, by, name)
    size = len(name.encode("utf-16-le", "surrogatepass")) // 2
    return 0 < size <= 24 and bool(shown) and not _NO_LABEL.match(shown) and not (size > 12 and shown[-1] in ".?!。")


def alias_table(spark: SparkSession, groups: list[list[str]] | None = None) -> DataFrame:
    """(word, alias, group): every pair of words of a group, normalised; a word of several groups has the aliases of all."""
    rows = [(g, w) for g, words in enumerate(ALIAS_GROUPS if groups is None else groups) for w in words]
    words = spark.createDataFrame(rows, "g int, w string").select("g", normalise_label(F.col("w")).alias("w"))
    return words.alias("a").join(words.alias("b"), "g").select(F.col("a.w").alias("word"), F.col("b.w").alias("alias")).distinct()
