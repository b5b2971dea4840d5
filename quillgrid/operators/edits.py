"""Text edits: each compares what it replaces, changes only what differs, and never stops the others.

Edits of a paragraph are applied in order, so a group (form_id, p) is one paragraph's own
few edits. Places are those of the text as it was; earlier edits move later ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from quillgrid.functions.diff import text_diff

SCHEMA = "form_id string, p int, text string, applied int, failed array<struct<edit_ord: int, error: string>>"


class Refused(ValueError):
    """An edit that can't be made; the others still can."""


def clean(text: str) -> str:
    """As functions.text.clean_text."""
    flat = text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    return "".join(c for c in flat if c == "\n" or c >= " ")


def place(pos: int, log: list[tuple[int, int, int]], opens: bool) -> int:
    """A stretch's end point after earlier edits: its start moves past what was inserted at it, its end does not."""
    for start, end, length in log:
        if start < pos < end:
            raise Refused("an earlier edit changed the text")
        if pos >= end and (opens or pos > start):
            pos += length - (end - start)
    return pos


def apply_edits(text: str, edits: list[tuple[int, int, int, str, str]]) -> tuple[str, list[tuple[int, str]]]:
    """The text after (edit_ord, start, end, from, to), and the edits that were refused. Offsets are UTF-16 units."""
    units = text.encode("utf-16-le")
    log: list[tuple[int, int, int]] = []
    failed = []
    for ord_, start, end, was, becomes in edits:
        try:
            a, b = place(start, log, True), place(end, log, False)
            if not 0 <= a <= b <= len(units) // 2 or units[2 * a : 2 * b] != was.encode("utf-16-le", "surrogatepass"):
                raise Refused("the text is not what the edit expects")
            for s, e, new in reversed(text_diff(was, clean(becomes))):
                raw = new.encode("utf-16-le")
                units = units[: 2 * (a + s)] + raw + units[2 * (a + e) :]
                log.append((a + s, a + e, len(raw) // 2))
        except Refused as error:
            failed.append((ord_, str(error)))
    return units.decode("utf-16-le"), failed


def apply_text_edits(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """(form_id, p, text, applied, failed) of the paragraphs (form_id, p, text) that ``edits`` (form_id, p, edit_ord, start, end, from, to) touch."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        todo = [tuple(r) for r in right.sort_values("edit_ord")[["edit_ord", "start", "end", "from", "to"]].itertuples(index=False)]
        if left.empty:
            failed = [{"edit_ord": int(e[0]), "error": "no such paragraph"} for e in todo]
            return pd.DataFrame([(*key, None, 0, failed)], columns=["form_id", "p", "text", "applied", "failed"])
        text, refused = apply_edits(left["text"].iloc[0], [(int(o), int(s), int(e), f, t) for o, s, e, f, t in todo])
        return pd.DataFrame([(*key, text, len(todo) - len(refused), [{"edit_ord": o, "error": m} for o, m in refused])], columns=["form_id", "p", "text", "applied", "failed"])

    touched = paragraphs.join(edits.select("form_id", "p").distinct(), ["form_id", "p"], "left_semi")
    return touched.groupBy("form_id", "p").cogroup(edits.groupBy("form_id", "p")).applyInPandas(run, SCHEMA)
