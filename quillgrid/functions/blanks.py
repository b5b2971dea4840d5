"""Blanks in running text: the spacing left for a value, with the words that name it.

A line becomes words and gaps. Dates and numbers in parts claim their places first, by
expressions over the whole line; each gap that is left is put to an ordered list of
namers, the first of which that recognises the words around it decides: a name, or that
the gap is layout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from quillgrid.functions.labels import is_label

# Units, marks and words that forms use.
DATE_UNITS = set("년월일시분")
UNITS = set("원 명 세 부 통 건 매 회 개 장 층 번지 호 호실 동 리 시간 개월 일간 주간 년간 은행 지점 % ㎡ ㎞ 평 살 권 쪽".split())
ORDINALS = set("호조항회차기절권")
PLACES = set("계인 직인 간인 인감 사진 반명함판 명함판 도장 서명 날인 인 앞쪽 뒤쪽 앞면 뒷면 뒷쪽 쪽 별지 붙임 첨부".split())
SIGNATURE = re.compile(r"[(（]\s*(?:서명|인|날인|印|인감|서명\s*(?:또는|및|혹은)\s*(?:날인|인|도장)|인감\s*날인|서명\s*날인|자필\s*서명)\s*[)）]")
NUMBER_LABEL = re.compile(r"(주민등록번호|외국인등록번호|법인등록번호|사업자등록번호|여권번호|전화번호|휴대전화번호|휴대전화|휴대폰|팩스번호|우편번호|계좌번호)\s*[:：]?\s*$")
BULLET = "□■○●◦※*-·•▪"
NUMBERED = re.compile(r"(?:\d+|[가-하])[.)](?:\s|$)|[(（]\d+[)）]")
GAP = re.compile(r"[ 　 ]+|_{3,}")
SYLLABLES = re.compile(r"(?<![^ 　 ])[가-힣](?:[ 　 ]+[가-힣](?![^ 　 :：]))+[:：]?(?![^ 　 ])")
DATE = re.compile(r"(?P<y>\d{0,4})(?P<ys>[ 　]*)년(?P<ma>[ 　]*)(?P<m>\d{0,2})(?P<mb>[ 　]*)월(?P<da>[ 　]*)(?P<d>\d{0,2})(?P<db>[ 　]*)일")
DOTTED = re.compile(r"(?<![\d.])(?P<y>(?:19|20)?)(?P<ys>[ 　]+)\.(?P<m>[ 　]+)\.(?P<d>[ 　]+)\.?")
_TAIL = r"[ 　]{2,}|[ 　]*(?=[)）]|$)"
PARTED = re.compile(rf"([ 　]{{2,}})-({_TAIL})(?:-({_TAIL}))?")


@dataclass(frozen=True)
class Part:
    role: str
    start: int
    end: int
    align: str = "left"
    prefix: str | None = None


@dataclass(frozen=True)
class Blank:
    kind: str
    display: tuple[str, ...]
    parts: tuple[Part, ...]
    lead: str | None = None


@dataclass
class Token:
    text: str
    start: int
    end: int
    gap: bool
    weight: int = field(init=False)

    def __post_init__(self) -> None:
        self.weight = len(self.text) + self.text.count("　")

    @property
    def wide(self) -> bool:
        return self.gap and (self.weight > 1 or self.text[0] == "_")


def spaced_words(line: str) -> list[tuple[int, int]]:
    """Extents of words whose syllables are set apart evenly; dates and ordinals are no such words."""
    found, at = [], 0
    while m := SYLLABLES.search(line, at):
        letters = re.findall("[가-힣]", m[0])
        widths = [len(g) + g.count("　") for g in re.findall("[ 　 ]+", m[0])]
        date = sum(s in DATE_UNITS for s in letters) > 1
        ordinal = len(letters) == 2 and letters[0] == "제" and letters[1] in ORDINALS
        if not date and not ordinal and max(widths) - min(widths) < 2:
            found.append(m.span())
            at = m.end()
        else:
            at = m.start() + 1
    return found


def tokens(line: str) -> list[Token]:
    """Words and gaps in turn. A word of syllables set apart is one word, its spaces taken out."""
    out: list[Token] = []
    whole = spaced_words(line)
    at = 0
    gaps = [m.span() for m in GAP.finditer(line) if not any(a <= m.start() < b for a, b in whole)]
    for a, b in [*gaps, (len(line), len(line))]:
        if at < a:
            word = line[at:a]
            out.append(Token(re.sub("[ 　 ]", "", word) if (at, a) in whole else word, at, a, False))
        if a < b:
            out.append(Token(line[a:b], a, b, True))
        at = b
    return out


def names(text: str) -> bool:
    """Whether words can name a blank: no mark, number, bullet, amount or row of placeholders."""
    solid = re.sub(r"\s", "", text)
    if not re.search("[가-힣A-WYZa-wyz]", re.sub("[○●◯]", "", text)) or re.search(r"(.)\1\1", solid):
        return False
    odd = text[0].isdigit() or text[0] in BULLET or text in PLACES or NUMBERED.match(text) or SIGNATURE.fullmatch(f"({text})")
    return not odd and is_label(text)


def phrase_before(toks: list[Token], k: int) -> str | None:
    """The words that end at token k, back to a wide gap or an opening bracket, as a name."""
    words: list[str] = []
    for t in reversed(toks[: k + 1]):
        if t.wide or (words and words[-1][0] in "(（"):
            break
        if not t.gap:
            words.append(t.text)
    p = re.sub("[:：]$", "", " ".join(reversed(words))).strip()
    inside = re.fullmatch(r"[(（]([^()（）]+)[)）]", p)
    p = inside[1] if inside else re.sub(r"^[(（]|[(（][^()（）]*[)）]$", "", p)
    if not inside:
        p = re.sub(r"[(（][^()（）]*[)）]$", "", p)
    p = re.sub(r"^[,，.·\s]+", "", re.sub(r"^위\s+", "", p)).strip()
    return p if p and names(p) else None


def bracket_after(toks: list[Token], k: int) -> str:
    """The words from token k up to a closing bracket or a wide gap."""
    out = ""
    for t in toks[k:]:
        if t.wide:
            break
        out += " " if t.gap else t.text
        if not t.gap and re.search("[)）]", t.text):
            break
    return out


LAYOUT: tuple[str, ...] = ()
#: A namer gives names, LAYOUT, or None where it has nothing to say.
Namer = Callable[[list[Token], int, str | None, str | None], tuple[str, ...] | None]


def _or_layout(name: str | None) -> tuple[str, ...]:
    return (name,) if name else LAYOUT


def _unit(right: str | None) -> str | None:
    unit = re.sub("[,.]$", "", right) if right else None
    return unit if unit in UNITS else None


def opens_line(toks, k, left, right):
    if left is not None:
        return None
    unit = _unit(right)
    return (unit,) if unit and (len(unit) > 1 or k + 2 >= len(toks)) else LAYOUT


def ordinal(toks, k, left, right):
    return (f"제{right[0]}",) if left == "제" and right and right[0] in ORDINALS else None


def in_bracket(toks, k, left, right):
    if not right or right[0] not in ")）":
        return None
    opened = re.search(r"[(（]([^()（）]*?)\s*[:：]?$", left)
    if not opened:
        return _or_layout(phrase_before(toks, k - 1))
    if opened[1] and is_label(opened[1]):
        return (opened[1],)
    outside = left[: opened.start()].lstrip("□■○●◦※*-·•▪")
    return _or_layout(outside if outside and is_label(outside) else None)


def before_signature(toks, k, left, right):
    return _or_layout(phrase_before(toks, k - 1)) if right and SIGNATURE.fullmatch(bracket_after(toks, k + 1)) else None


def after_colon(toks, k, left, right):
    return _or_layout(phrase_before(toks, k - 1)) if left[-1] in ":：" else None


def after_bracketed(toks, k, left, right):
    m = re.fullmatch(r"[(（]([^()（）]+)[)）]", left)
    alone = k + 1 >= len(toks) or (right or " ")[0] in "(（"
    return (m[1],) if m and alone and not SIGNATURE.fullmatch(left) and is_label(m[1]) else None


def before_unit(toks, k, left, right):
    unit = _unit(right)
    if not unit or re.fullmatch("[가-힣]", left):
        return None
    context = phrase_before(toks, k - 1) if len(unit) == 1 and left not in UNITS else None
    return (context, unit) if context else (unit,)


def ends_line(toks, k, left, right):
    return _or_layout(phrase_before(toks, k - 1)) if k + 1 >= len(toks) and left[-1] not in ".。!?)）" else None


NAMERS: tuple[Namer, ...] = (opens_line, ordinal, in_bracket, before_signature, after_colon, after_bracketed, before_unit, ends_line)
#: Values stand against what follows here.
RIGHT = (opens_line, before_unit)


def before_date(text: str) -> tuple[str, ...]:
    """A name printed just before a date."""
    head = re.sub("[ 　:：]+$", "", text).strip()
    if re.search(r"(?:^|[\s\d])일$|부터$|까지$|[,，~∼]$", head):
        return ()
    last = re.sub("^[(（]|[)）]$", "", re.split("[ 　]{2,}", head)[-1])
    return (last,) if last and names(last) else ()


def dates(line: str) -> Iterator[tuple[tuple[int, int], Blank]]:
    for m in DATE.finditer(line):
        parts = []
        year, spaces = m["y"], len(m["ys"])
        if len(year) < 4 and spaces >= (1 if year else 2):
            parts.append(Part("year", *m.span("ys"), "left" if year else "right", year or None))
        for role, own, a, b in (("month", "m", "ma", "mb"), ("day", "d", "da", "db")):
            if not m[own] and len(m[a]) + len(m[b]) > 1:
                parts.append(Part(role, m.start(a), m.end(b), "right"))
        if parts:
            rest = line[m.end() :]
            period = re.match(r"\s*(부터|까지)", rest)
            born = re.match(r"\s*생(?!산)", rest)
            yield m.span(), Blank("date", ("생년월일",) if born else before_date(line[: m.start()]) + ((period[1],) if period else ()), tuple(parts))


def dotted_dates(line: str) -> Iterator[tuple[tuple[int, int], Blank]]:
    for m in DOTTED.finditer(line):
        if m["y"] or len(m["ys"]) > 1:
            born = re.match(r"\s*생", line[m.end() :])
            year = Part("year", *m.span("ys"), "left" if m["y"] else "right", m["y"] or None)
            yield m.span(), Blank("date", ("생년월일",) if born else before_date(line[: m.start()]), (year, Part("month", *m.span("m"), "right"), Part("day", *m.span("d"), "right")))


def parted_numbers(line: str) -> Iterator[tuple[tuple[int, int], Blank]]:
    for m in PARTED.finditer(line):
        label = NUMBER_LABEL.search(re.sub(r"[(（]\s*$", "", line[: m.start()]))
        if label:
            spans = [m.span(i) for i in (1, 2, 3) if m.start(i) >= 0]
            yield m.span(), Blank("split", (label[1],), tuple(Part("part", a, b, "left" if i == len(spans) - 1 else "right") for i, (a, b) in enumerate(spans)))


def blanks_of_line(line: str, closes: bool) -> list[Blank]:
    """Blanks of a line; ``closes`` if the paragraph ends with it."""
    taken: set[int] = set()
    out: list[Blank] = []
    for reader in (dates, dotted_dates, parted_numbers):
        for (a, b), blank in reader(line):
            if reader is dates or not taken.intersection(range(a, b)):
                taken.update(range(a, b))
                out.append(blank)
    toks = tokens(line)
    for k, t in enumerate(toks):
        if not t.gap or t.weight < 2 or taken.intersection(range(t.start, t.end)):
            continue
        left = toks[k - 1].text if k else None
        right = toks[k + 1].text if k + 1 < len(toks) and not toks[k + 1].gap else None
        for namer in NAMERS:
            got = namer(toks, k, left, right)
            if got is not None:
                if got:
                    out.append(Blank("text", got, (Part("value", t.start, t.end, "right" if namer in RIGHT else "left"),)))
                break
    written = [t for t in toks if not t.gap]
    if closes and len(written) == 1 and toks[-1] is written[0] and not SIGNATURE.fullmatch(written[0].text):
        m = re.fullmatch(r"[(（](.+)[)）]|(.+)[:：]", written[0].text)
        name = (m[1] or m[2]) if m else None
        if name and names(name):
            out.append(Blank("append", (name,), (Part("value", len(line), len(line)),)))
    return out


def lead_of(line: str) -> tuple[str, Token] | None:
    """The label that opens a paragraph before a wide gap, and that gap."""
    toks = tokens(line)
    if len(toks) < 2 or toks[0].gap or not toks[1].gap or toks[1].weight < 2 or toks[0].text[-1] in ":：":
        return None
    text = re.sub(r"[(（][^()（）]*[)）]$", "", toks[0].text)
    if not text or text[0] in "(（" + BULLET or text[0].isdigit() or len(text) == 1 and "가" <= text <= "힣":
        return None
    return (text, toks[1]) if text not in UNITS and is_label(text) else None


def blanks_of(text: str, tab: int = 8) -> list[Blank]:
    """Blanks of a paragraph. Positions count characters; a tab counts ``tab`` of them and, like a line break, ends a line."""
    lines, at = [], 0
    for piece in re.split("(\t|\n|￼)", text):
        if piece in ("\t", "\n", "￼") and piece:
            at += tab if piece == "\t" else 1
        else:
            lines.append((at, piece))
            at += len(piece)
    found = [(n, b) for n, (_, line) in enumerate(lines) if line for b in blanks_of_line(line, n == len(lines) - 1)]
    lead = lead_of(lines[0][1])
    if lead and any(n == 0 and p.start <= lead[1].start and lead[1].end <= p.end for n, b in found for p in b.parts):
        lead = None
    shift = lambda p, o: Part(p.role, p.start + o, p.end + o, p.align, p.prefix)
    return [Blank(b.kind, b.display, tuple(shift(p, lines[n][0]) for p in b.parts), lead[0] if lead else None) for n, b in found]


def find_blanks(df: DataFrame, text: str) -> DataFrame:
    """One row for each blank of each row of ``df``: its columns, then n, kind, display, lead, parts."""
    keep = [c for c in df.columns if c != text]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *own, t in frame[[*keep, text]].itertuples(index=False):
                for n, b in enumerate(blanks_of(t or "")):
                    rows.append((*own, n, b.kind, list(b.display), b.lead, [{"role": p.role, "start": p.start, "end": p.end, "align": p.align, "prefix": p.prefix} for p in b.parts]))
            yield pd.DataFrame(rows, columns=[*keep, "n", "kind", "display", "lead", "parts"])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInPandas(run, f"{own}, n int, kind string, display array<string>, lead string, parts array<struct<role: string, start: int, `end`: int, align: string, prefix: string>>")
