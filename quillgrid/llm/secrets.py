"""Secret scans through a trigram inverted index.

Each rule is a regular expression. Its parse tree gives a Boolean trigram query: the
trigrams any match must hold. A block of texts is indexed by the trigrams that some
query asks for (postings: rows of the block), each query is answered by intersecting
and uniting postings, and only rows that remain are verified with the expression.
A rule without mandatory trigrams scans every row. Blocks are independent, so the
index needs no shuffle and its memory is that of one block.

Defined results: null counts as empty and has no spans; overlapping spans of several
rules are all returned; offsets are code points, ends exclusive; repeated rows are
scanned each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C  # the parse tree of the standard library's own expressions
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import kernel as K


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Rules the method adds; each is a public, documented token format.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@"),
)

#: A query is True (any row), or ("and" | "or", parts) over trigrams and queries.
Query = object
MOST = 64


def _join(op: str, parts: list) -> Query:
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text must hold if it holds one of ``strings``."""
    each = []
    for s in sorted(strings):
        b = s.lower().encode()
        each.append(_join("and", [b[i : i + 3] for i in range(len(b) - 2)]))
    return _join("or", each)


def _charset(items: list) -> set[str] | None:
    got: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            got.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            got |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return got if len(got) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(the strings it can match, if few; what a match must hold besides)."""
    now, must, exact = {""}, [], True
    for op, arg in tree:
        strings, query = None, True
        if op is C.LITERAL:
            strings = {chr(arg)}
        elif op is C.IN:
            strings = _charset(arg)
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                query = _join("or", [q if s is None else _of_strings(s) for s, q in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, inner_query = _walk(body)
            if inner is not None and high == 1:
                strings = inner | ({""} if low == 0 else set())
            elif low >= 1:
                query = inner_query if inner is None else _of_strings(inner)
        elif op is C.AT:
            strings = {""}
        if strings is not None and len(now) * len(strings) <= MOST:
            now = {a + b for a in now for b in strings}
            continue
        must += [_of_strings(now), query if strings is None else _of_strings(strings)]
        now, exact = {""}, False
    return (now, True) if exact else (None, _join("and", [*must, _of_strings(now)]))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, over texts with A-Z in lower case; True if it has none."""
    strings, query = _walk(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _leaves(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_leaves, query[1]))


class Scanner:
    """Rules with their queries, compiled once in each task."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        grams = sorted(set().union(*(_leaves(q) for _, _, q in self.rules)))
        self.number = {g: i + 1 for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for g, i in self.number.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i

    def postings(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """rows x (trigrams + 1): whether the row holds the trigram."""
        held = np.zeros((len(off) - 1, len(self.number) + 1), dtype=bool)
        low = K.LOWER[data].astype(np.uint32)
        if len(low) >= 3:
            code = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(code)
            row = np.searchsorted(off, at, side="right") - 1
            whole = at + 3 <= off[row + 1]
            held[row[whole], code[at[whole]]] = True
        return held

    def answer(self, query: Query, held: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(len(held), dtype=bool)
        if isinstance(query, bytes):
            return held[:, self.number[query]]
        parts = [self.answer(q, held) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each row (start, place of the rule, end), sorted."""
        data, off = K.buffer_of(column)
        held = self.postings(data, off)
        texts = column.to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.answer(query, held)).tolist():
                if texts[i]:
                    found[i] += [(m.start(), k, m.end()) for m in expression.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for f in found:
            f.sort()
        return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row of ``docs``; spans by start, then as rules are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in K.batches(whole, "text"):
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in f] for f in scanner.spans(batch.column(1))]
                yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by [KIND]; overlapping spans are replaced as one, named by the first. n_chars follows."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for whole in batches:
            for batch in K.batches(whole, "text"):
                texts = batch.column(place).to_pylist()
                for i, found in enumerate(scanner.spans(batch.column(place))):
                    out, done = [], 0
                    merged: list[list] = []
                    for s, k, e in found:
                        if merged and s < merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e, k])
                    for s, e, k in merged:
                        out += [texts[i][done:s], f"[{rules[k].kind.upper()}]"]
                        done = e
                    if merged:
                        texts[i] = "".join(out) + texts[i][done:]
                yield pa.record_batch([pa.array(texts, pa.string()) if j == place else batch.column(j) for j in range(len(names))], names=names)

    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(run, out.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
