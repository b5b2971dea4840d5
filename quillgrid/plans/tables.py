"""Blanks in tables of forms: empty cells, those drawn as not for writing, and the labels around them.

A form's table is a group of rows (form_id, t): it is as large as a page, so a group is
worked on whole. Neighbours are read as strings of classes (L label, B blank, . other), in
which an expression finds the labels to the left of a cell.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.labels import is_label
from quillgrid.plans.fill import _plain

#: Rows lower than this (7200 to the inch) hold no line of writing.
GAP_HEIGHT = 850
SCHEMA = "form_id string, t int, row int, col int, id string, labels array<string>, display array<string>, index int, group string"


@dataclass(frozen=True)
class Cell:
    """A cell of a table; ``fields`` counts fields to fill in it, ``controls`` other objects, borders are a line's type and width or None."""

    row: int
    col: int
    row_span: int = 1
    col_span: int = 1
    text: str = ""
    height: int = 1000
    fields: int = 0
    controls: int = 0
    outside: str = ""
    left: str | None = "solid"
    right: str | None = "solid"
    top: str | None = "solid"
    bottom: str | None = "solid"
    crossed: bool = False


def first_line(text: str) -> str:
    return next((" ".join(x.split()) for x in text.split("\n") if x.strip()), "")


def shorten(text: str, most: int = 40) -> str:
    line = first_line(text)
    return line if len(line) <= most else line[:most] + "…"


def heading_of(text: str) -> str | None:
    """The short heading a title line opens with; notes are none."""
    line = first_line(text)
    head = re.split(r"\s*[:：(（]", re.sub(r"^[□■○●◦▪•·\-–—\s]+", "", line))[0].strip()
    return head if head and line[0] not in "*※" and is_label(head) else None


class Table:
    def __init__(self, cells: list[Cell]) -> None:
        self.cells = cells
        self.grid = {(r, c): x for x in cells for r in range(x.row, x.row + x.row_span) for c in range(x.col, x.col + x.col_span)}
        self.rows = max((r for r, _ in self.grid), default=-1) + 1
        self.cols = max((c for _, c in self.grid), default=-1) + 1

    def empty(self, x: Cell) -> bool:
        return not x.controls and not x.fields and not x.text.strip()

    def blank(self, x: Cell) -> bool:
        return self.empty(x) or (x.fields > 0 and not x.controls and not x.outside.strip())

    def title(self, x: Cell) -> bool:
        return self.cols > 1 and x.col_span == self.cols

    def label(self, x: Cell | None) -> bool:
        return x is not None and not x.fields and not x.controls and not self.title(x) and is_label(x.text) and not re.search("[□☐▢◻]", x.text)

    def across(self, r: int) -> list[Cell]:
        """The cells of a grid row, each once, from the left."""
        return list(dict.fromkeys(self.grid[r, c] for c in range(self.cols) if (r, c) in self.grid))

    def upwards(self, r: int, c: int) -> list[Cell]:
        """The cells above (r, c), nearest first, up to a hole."""
        out = []
        while (x := self.grid.get((r - 1, c))) is not None:
            out.append(x)
            r = x.row
        return out

    def open_row(self, r: int) -> list[Cell]:
        """The cells of a row that is empty and has no lines at any side, else none."""
        row = self.across(r) if 0 <= r < self.rows else []
        ok = all(x.row == r and x.row_span == 1 and self.empty(x) and not x.left and not x.right for x in row)
        return row if ok else []

    @cached_property
    def not_for_writing(self) -> set[Cell]:
        out = {x for x in self.cells if x.crossed and self.empty(x)}
        sided = any(x.left or x.right for x in self.cells)
        tall = lambda row: max(x.height for x in row)
        rules = lambda row: [(x.top or "", x.bottom or "") for x in row]
        for r in range(self.rows):
            row = self.open_row(r)
            if not row:
                continue
            beside = [o for o in (self.open_row(r - 1), self.open_row(r + 1)) if o]
            alike = any(abs(tall(row) - tall(o)) <= 0.1 * tall(row) and rules(row) == rules(o)[: len(row)] for o in beside)
            above = self.across(r - 1) if r else []
            headed = len(above) == 1 and above[0].col_span == self.cols and above[0].text.strip() != ""
            if tall(row) < GAP_HEIGHT or not (headed or not sided or alike):
                out.update(row)
        return out

    def group(self, x: Cell) -> str | None:
        """The heading of the nearest title row above that reads as one."""
        r = x.row - 1
        while r >= 0:
            y = self.grid.get((r, x.col))
            if y is not None and self.title(y) and not self.empty(y):
                if head := heading_of(y.text):
                    return head
                r = y.row
            r -= 1
        return None

    def named(self, x: Cell) -> tuple[list[Cell], int, bool]:
        """The cells that name a cell, its index among blanks of that name, and whether they are a question."""
        beside = [y for y in self.across(x.row) if y.col < x.col][::-1]
        classes = "".join("L" if self.label(y) else "B" if self.blank(y) else "." for y in beside)
        m = re.match("(B*)(L+)", classes)
        above = self.upwards(x.row, x.col)
        rows_of_same = 0
        for y in above:
            if self.title(y) or self.label(y) or not (self.blank(y) and (y.col, y.col_span) == (x.col, x.col_span)):
                break
            rows_of_same += 1
        header = next((y for y in above[rows_of_same : rows_of_same + 1] if self.label(y)), None)
        if header:
            row = [y for y in self.cells if y.row == header.row]
            opener = self.grid.get((x.row, 0))
            if sum(map(self.label, row)) > 1 and not any(map(self.blank, row)) and self.label(opener) and opener.row > header.row:
                return [opener, header], 1, False
        if m:
            return beside[m.start(2) : m.end(2)][::-1], len(m[1]) + 1, False
        if header:
            return [header], rows_of_same + 1, False
        up = above[0] if above else None
        if up and not self.empty(up) and not self.title(up) and (up.col, up.col_span) == (x.col, x.col_span):
            return [up], 1, True
        return [], 1, False

    def slots(self, t: int) -> list[tuple]:
        """(row, col, id, labels, display, index, group) of the cells to write in."""
        out = []
        for x in self.cells:
            if self.empty(x) and x not in self.not_for_writing:
                cells, index, question = self.named(x)
                display = [shorten(y.text) if question else " ".join(y.text.split()) for y in cells]
                out.append((x.row, x.col, f"t{t}.r{x.row}c{x.col}", [_plain(d) for d in display], display, index, self.group(x)))
        return out


def table_slots(cells: DataFrame) -> DataFrame:
    """The blanks of all tables in ``cells`` (form_id, t and the fields of Cell; those that are missing take their defaults)."""
    have = [f for f in Cell.__dataclass_fields__ if f in cells.columns]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
        rows = [{f: plain(v) for f, v in zip(have, r, strict=True)} for r in frame.sort_values(["row", "col"])[have].itertuples(index=False)]
        table = Table([Cell(**{f: v for f, v in r.items() if v is not None or f in ("left", "right", "top", "bottom")}) for r in rows])
        form, t = frame["form_id"].iloc[0], int(frame["t"].iloc[0])
        return pd.DataFrame([(form, t, *s) for s in table.slots(t)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return cells.groupBy("form_id", "t").applyInPandas(run, SCHEMA)


def with_keys(slots: DataFrame) -> DataFrame:
    """``slots`` with keys that differ within a form."""
    from quillgrid.plans.fill import slot_keys

    base = F.array_join(F.filter("labels", lambda x: x != ""), ".")
    base = F.when(base == "", F.col("id")).otherwise(base)
    label = F.when(F.col("index") > 1, F.concat(base, F.lit("#"), F.col("index").cast("string"))).otherwise(base)
    from quillgrid.functions.labels import normalise_label

    keyed = slots.withColumns({"label": label, "group_name": F.coalesce(normalise_label(F.col("group")), F.lit(""))})
    keys = slot_keys(keyed.select("form_id", F.struct("t", "row", "col").alias("slot_ord"), "label", F.col("group_name").alias("group")), ["form_id"])
    joined = slots.withColumn("slot_ord", F.struct("t", "row", "col")).join(keys, ["form_id", "slot_ord"])
    return joined.drop("slot_ord")


def cells_by_text(rows: list[list[str]]) -> list[Cell]:
    """Cells of a plain table, for tests and notebooks: ">" joins a cell to its left neighbour."""
    spans: dict[tuple[int, int], int] = defaultdict(lambda: 1)
    for r, row in enumerate(rows):
        for c in range(len(row) - 1, 0, -1):
            if row[c] == ">":
                spans[r, c - 1] += spans[r, c]
    return [Cell(r, c, 1, spans[r, c], text) for r, row in enumerate(rows) for c, text in enumerate(row) if text != ">"]
