"""Edits against splices of strings, style runs against lists, checks."""

import random

from pyspark.sql import functions as F

from quillgrid.functions import styles
from quillgrid.operators import checks, edits

RUNS = "array<struct<pos: int, id: int>>"


def test_random_edits():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abc \U0001f600") for _ in range(rng.randint(0, 20)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
        todo, want, shift = [], text, 0
        at = lambda i: len(text[:i].encode("utf-16-le")) // 2  # noqa: E731, B023
        for n, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=False)):
            new = "".join(rng.choice("xyz\n") for _ in range(rng.randint(0, 5)))
            todo.append((n, at(a), at(b), text[a:b], new))
            want = want[: a + shift] + new + want[b + shift :]
            shift += len(new) - (b - a)
        rng.shuffle(todo)
        assert edits.apply_edits(text, todo) == (want, [])


def test_refused_edits():
    got = edits.apply_edits("hello world", [(0, 0, 5, "hullo", "x"), (1, 6, 11, "world", "there"), (2, 5, 99, "", "x"), (3, 0, 5, "hello", "he\tllo")])
    assert got[0] == "he llo there" and [o for o, _ in got[1]] == [0, 2]


def test_edits_in_spark(spark):
    p = spark.createDataFrame([("f", 1, "abc"), ("f", 2, "same")], "form_id string, p int, text string")
    e = spark.createDataFrame([("f", 1, 0, 1, 2, "b", "BB"), ("f", 1, 1, 3, 3, "", "!"), ("g", 9, 0, 0, 0, "", "x")], "form_id string, p int, edit_ord int, start int, end int, from string, to string")
    got = {(r.form_id, r.p): (r.text, r.applied, len(r.failed)) for r in edits.apply_text_edits(p, e).collect()}
    assert got == {("f", 1): ("aBBc!", 2, 0), ("g", 9): (None, 0, 1)}


def runs(*pairs):
    return F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(i).alias("id")) for p, i in pairs))


def test_styles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    r = runs((0, 1), (4, 2), (8, 3))
    assert [one(styles.style_at(r, F.lit(p))) for p in (0, 3, 4, 99)] == [1, 1, 2, 3]
    assert one(styles.styles_in(r, F.lit(2), F.lit(5))) == [1, 2] and one(styles.styles_in(r, F.lit(4), F.lit(8))) == [2]
    plain = lambda c: [tuple(x) for x in one(c)]
    assert plain(styles.restyled(r, F.lit(2), F.lit(6), lambda i: F.lit(9))) == [(0, 1), (2, 9), (6, 2), (8, 3)]
    assert plain(styles.restyled(r, F.lit(4), F.lit(8), lambda i: F.lit(1))) == [(0, 1), (8, 3)]
    assert plain(styles.after_edit(r, F.lit(2), F.lit(6), F.lit(1))) == [(0, 1), (3, 2), (5, 3)]


def test_checks(spark):
    p = spark.createDataFrame([("f", 1, 5, 5, [(0, 1), (3, 2)], [0, 0, 4]), ("f", 2, 5, 4, [(1, 1), (1, 7)], [3, 2])], f"form_id string, p int, n_units int, text_units int, runs {RUNS}, segments array<int>")
    known = spark.createDataFrame([("f", 1), ("f", 2)], "form_id string, id int")
    got = checks.paragraph_problems(p, known)
    assert sorted((r.p, r.problem) for r in got.collect()) == [(2, "length differs"), (2, "line places"), (2, "no style at the start"), (2, "style places"), (2, "unknown style 7")]
    assert checks.new_problems(got, got).count() == 0
    cells = spark.createDataFrame([("f", 1, 0, 0, 1, 2, 2, 2), ("f", 1, 0, 1, 1, 1, 2, 2), ("f", 2, 0, 0, 3, 1, 2, 2)], "form_id string, t int, row int, col int, row_span int, col_span int, rows int, cols int")
    assert sorted((r.t, r.problem) for r in checks.tiling_problems(cells).collect()) == [(1, "cells overlap"), (2, "a cell leaves the table")]
