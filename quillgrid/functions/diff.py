"""Text differences as replaced ranges: what is shared stays, ties go to insertion, offsets are UTF-16 units."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Above so many cells an alignment is not worth its cost: the middle is one change.
CELLS = 1_000_000


def _script(a: str, b: str) -> Iterator[str]:
    """= for a shared character, + for one inserted, - for one removed, along a longest common subsequence."""
    x, y = (np.array(list(map(ord, s)), dtype=np.int64) for s in (a, b))
    best = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int64)
    for i in range(len(x) - 1, -1, -1):
        # A cell is the best of the diagonal step and the row below, then carried leftwards.
        step = np.maximum(best[i + 1, :-1], np.where(x[i] == y, best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            yield "="
            i, j = i + 1, j + 1
        elif j < len(y) and (i == len(x) or best[i, j + 1] >= best[i + 1, j]):
            yield "+"
            j += 1
        else:
            yield "-"
            i += 1


def units(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def text_diff(a: str, b: str) -> list[tuple[int, int, str]]:
    """(start, end, text) ranges of ``a`` that make it ``b``."""
    head = len(commonprefix([a, b]))
    tail = len(commonprefix([a[head:][::-1], b[head:][::-1]]))
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(mid_a) * len(mid_b) > CELLS:
        script = "-" * len(mid_a) + "+" * len(mid_b)
    else:
        script = "".join(_script(mid_a, mid_b))
    out, i, j, k = [], 0, 0, 0
    while k < len(script):
        run = len(script[k:]) - len(script[k:].lstrip("+-"))
        if run:
            gone, come = script[k : k + run].count("-"), script[k : k + run].count("+")
            start = units(a[: head + i])
            out.append((start, start + units(mid_a[i : i + gone]), mid_b[j : j + come]))
            i, j, k = i + gone, j + come, k + run
        else:
            i, j, k = i + 1, j + 1, k + 1
    return out


def diffs(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each changed range: the other columns of ``df``, then n, start, end, text."""
    keep = [c for c in df.columns if c not in (a, b)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*own, n, *h) for *own, x, y in frame[[*keep, a, b]].itertuples(index=False) for n, h in enumerate(text_diff(x or "", y or ""))]
            yield pd.DataFrame(rows, columns=[*keep, "n", "start", "end", "text"])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInPandas(run, f"{own}, n int, start int, `end` int, text string")
