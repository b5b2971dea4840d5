"""Values written into blanks, pages as drawn, corpora and reports, where the registered queries do not reach."""

import random

from pyspark.sql import functions as F

from quillgrid.functions import blanks, fields, writing
from quillgrid.functions.values import text_width
from quillgrid.operators import corpus, layout
from quillgrid.plans import reports


def parts_of(spark, text):
    return blanks.find_blanks(spark.createDataFrame([(text, text)], "t string, own string"), "t")


def written(spark, text, value):
    df = parts_of(spark, text)
    values = writing.part_values(F.col("kind"), F.col("parts"), F.lit(value), F.get("display", 0))
    return [r[0] for r in df.select(writing.apply_edits(F.col("own"), writing.blank_edits(F.col("own"), F.col("parts"), values))).collect()]


def test_dates_go_into_their_parts(spark):
    (got,) = written(spark, "20    년    월    일", "2026. 3. 7.")
    assert got.replace(" ", "") == "2026년3월7일"
    assert written(spark, "20    년    월    일", "1999. 3. 7.") == [None]
    assert written(spark, "20    년    월    일", "no date") == [None]


def test_values_keep_a_space_to_their_neighbours_and_the_width(spark):
    part = F.array(F.struct(F.lit(2).alias("start"), F.lit(12).alias("end"), F.col("align"), F.lit(None).cast("string").alias("prefix")))
    rows = [("left", "ab          cd", "xy"), ("right", "ab          cd", "xy"), ("left", "ab          cd", "a long value for it"), ("right", "ab          cd", "a long value for it"), ("left", "(:          )", "xy"), ("left", "ab          cd", None)]
    df = spark.createDataFrame(rows, "align string, t string, v string")
    got = [r[0] for r in df.select(writing.apply_edits(F.col("t"), writing.blank_edits(F.col("t"), part, F.array("v")))).collect()]
    assert got[0] == "ab xy" + " " * 6 + " cd" and got[1] == "ab" + " " * 7 + "xy cd"
    assert got[2:4] == ["ab a long value for it cd"] * 2
    assert got[4] == "(: xy" + " " * 7 + ")" and got[5] == rows[5][1]


def test_controls_beside_a_blank_are_no_words(spark):
    part = lambda a, b: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("left").alias("align"), F.lit(None).cast("string").alias("prefix")))
    row = spark.range(1).select(
        writing.apply_edits(F.lit("ab" + " " * 8 + "\ufffccd"), writing.blank_edits(F.lit("ab" + " " * 8 + "\ufffccd"), part(2, 10), F.array(F.lit("xy")))).alias("a"),
        writing.apply_edits(F.lit("a\ufffc" + " " * 8 + "cd"), writing.blank_edits(F.lit("a\ufffc" + " " * 8 + "cd"), part(2, 10), F.array(F.lit("a long value")))).alias("b"),
        writing.plain_text(F.lit("a\ufffcb"), F.lit(0), F.lit(2)).alias("c"),
        writing.plain_text(F.lit("a\ufffcb"), F.lit(2), F.lit(3)).alias("d"),
        writing.choice_value(F.array(F.struct(F.lit("x").alias("label"), F.lit(None).cast("boolean").alias("checked")), F.struct(F.lit("y").alias("label"), F.lit(True).alias("checked"))), F.array(F.lit("x"), F.lit("y"))).alias("e"),
    ).first()
    assert row.a.startswith("ab xy ") and row.a.endswith("\ufffccd") and row.b == "a\ufffca long value cd"
    assert (row.c, row.d, row.e) == (None, "b", "x")


def test_widths_are_kept_over_parts(spark):
    """Random parts against the rule said once more, value by value."""
    import random

    from quillgrid.functions.values import GLYPHS

    rng, rows = random.Random(12), []
    for i in range(120):
        text, parts, at = "", [], 0
        for _ in range(rng.randrange(1, 5)):
            word = rng.choice(["", "20", "(", "ab", "-", "년", "x ", "\ufffc"])
            blank = " " * rng.choice([0, 1, 3, 6, 9])
            at = len(text) + len(word)
            text += word + blank
            parts.append((at, at + len(blank), rng.choice(["left", "right"]), rng.choice([None, None, None, "20"])))
        text += rng.choice(["", "일", ")", " y"])
        rows.append((i, text, parts, [rng.choice([None, "1", "26", "long value", ""]) for _ in parts]))
    df = spark.createDataFrame(rows, "i int, t string, parts array<struct<start: int, `end`: int, align: string, prefix: string>>, v array<string>")
    widths = {r.c: r.w for r in spark.createDataFrame([(c,) for c in sorted({c for r in rows for c in r[1] + "".join(v or "" for v in r[3])} | {" "})], "c string").select("c", text_width(F.col("c")).alias("w")).collect()}
    wide = lambda s: sum(widths[c] for c in s)
    word = lambda c: bool(c) and c not in " \u3000\u00a0\n\t\ufffc"
    for r in df.select("i", writing.blank_edits(F.col("t"), F.col("parts"), F.col("v")).alias("e")).collect():
        _, text, parts, values = rows[r.i]
        due, want = 0.0, []
        for (a, b, align, prefix), v in zip(parts, values):
            if v is None:
                due = 0.0
                continue
            left, right = text[a - 1 : a] if a else "", text[b : b + 1]
            apart = word(left) and left not in "(（[-~∼/"
            after = " " if word(right) and right not in ")）],.，。:：-~∼/" else ""
            lead = " " if align == "left" and prefix is None and apart else ""
            due += wide(text[a:b]) - wide(lead + v + after)
            if prefix is not None or a == b:
                out, due = (" " if a == b and word(left) else "") + v, due if prefix is not None else 0.0
            else:
                n = max(0, int((due / GLYPHS["space"] + 0.5) // 1))
                due -= n * GLYPHS["space"]
                out = lead + v + " " * n + after if align == "left" else " " * n + (" " if n == 0 and apart else "") + v + after
            want.append((a, b, out))
        assert [tuple(e) for e in r.e] == want[::-1], rows[r.i]


def test_marks_and_choices(spark):
    row = spark.range(1).select(
        writing.mark_text(F.lit(3), F.lit("v")).alias("a"),
        writing.mark_text(F.lit(0), F.lit("v")).alias("b"),
        writing.choice_fill(F.array(F.struct(F.lit("x").alias("label"), F.lit(True).alias("checked")), F.struct(F.lit("y").alias("label"), F.lit(False).alias("checked"))), F.array(F.lit("y"))).alias("c"),
        writing.set_checked(F.lit("other"), F.lit(True)).alias("d"),
        writing.plain_text(F.lit("a\x02b"), F.lit(0), F.lit(3)).alias("e"),
        writing.plain_text(F.lit("abc"), F.lit(1), F.lit(9)).alias("f"),
        writing.iso_date(F.lit("2026.3")).alias("g"),
        writing.profile_record(F.expr("array(named_struct('name', ' a ', 'value', '1'), named_struct('name', 'b', 'value', ' '), named_struct('name', 'a', 'value', '2'))")).alias("h"),
    ).first()
    assert (row.a, row.b, [o.checked for o in row.c], row.d, row.e, row.f, row.g, row.h) == (" v ", "v", [True, True], None, None, None, None, {"a": "2"})


def test_names_of_forms_and_guide_texts(spark):
    pattern = "지원서|신청서|서식"
    rows = [("", "신청서.hwp", True), ("", "신청서.pdf", False), ("", "모집 안내.hwp", False), ("", "모집 지원서.HWPX", True), ("", "공고문 서식.hwp", False), ("입사지원서", "아무.hwp", True), (None, None, False), (None, "메모.hwp", False)]
    df = spark.createDataFrame(rows, "slot string, name string, want boolean")
    assert [r[0] for r in df.select(fields.is_form(F.col("slot"), F.col("name"), pattern)).collect()] == [r[2] for r in rows]
    rows = [("Clickhere:set:9:Direction:wstring:4:ab;cxyz", "ab;c"), (r"a\;b;help", "a;b"), ("plain", None), (None, None)]
    df = spark.createDataFrame(rows, "command string, want string")
    assert [r[0] for r in df.select(fields.guide_text(F.col("command"))).collect()] == [r[1] for r in rows]


def test_crossings_against_all_pairs(spark):
    rng = random.Random(3)
    rules = [(p, i, rng.choice("hv"), rng.uniform(0, 500), a, a + rng.uniform(0, 300)) for p in range(3) for i in range(40) for a in [rng.uniform(0, 400)]]
    df = spark.createDataFrame(rules, "page int, id int, kind string, at double, lo double, hi double")
    got = {tuple(r) for r in layout.crossings(df.where("kind = 'h'"), df.where("kind = 'v'"), ["page"]).collect()}
    want = {(h[0], h[1], v[1]) for h in rules for v in rules if h[0] == v[0] and (h[2], v[2]) == ("h", "v") and h[4] - 1.5 <= v[3] <= h[5] + 1.5 and v[4] - 1.5 <= h[3] <= v[5] + 1.5}
    assert got == want and want


def test_lines_of_glyphs(spark):
    rows = [("a", 0.0, 5.0, 10.0), (" ", 5.0, 8.0, 10.0), ("b", 9.0, 14.0, 10.0), ("c", 14.0, 19.0, 10.0), ("d", 60.0, 65.0, 10.0), ("·", 66.0, 67.0, 10.0), ("·", 67.0, 68.0, 10.0), ("·", 68.0, 69.0, 10.0)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, " ", 0.0, 1.0, 9.0)], "page int, c string, x0 double, x1 double, size double")
    assert {r.page: r.text for r in layout.line_texts(df, ["page"]).collect()} == {1: "a bc    d … "}


def test_page_index(spark):
    paths = ["r/form_p2.jpg", "r/form/3.jpeg", "r/form.jpg", "r/other (4).JPG", "r/third-page5.jpg", "r/review/form_p9.jpg", "r/form.png"]
    got = {r.stem: dict(r.pages) for r in corpus.page_index(spark.createDataFrame([(p,) for p in paths], "path string"), "path").collect()}
    assert {s: sorted(p) for s, p in got.items()} == {"form": [1, 2, 3], "other": [4], "third": [5]}


def test_outputs_and_reports(spark):
    row = spark.range(1).select(reports.output_name("{none}", F.lit("form"), F.lit(3), F.create_map(F.lit("a"), F.lit("b"))).alias("a"), reports.output_name("{form}/{row} {a}", F.lit("form"), F.lit(3), F.create_map(F.lit("a"), F.lit("b"))).alias("b"), reports.addressable(F.array(F.lit("예"), F.lit("아니오"), F.lit("예 "), F.lit("a, b"))).alias("c")).first()
    assert (row.a, row.b, row.c) == ("form", "form_3 b", ["아니오"])
    saves = spark.createDataFrame([(1, 0, "a"), (1, 400, "b"), (1, 900, "c"), (2, 5, None)], "k int, at int, state string")
    assert sorted((r.k, r.at) for r in reports.settled_states(saves, ["k"], "at", "state", 500).collect()) == [(1, 400), (1, 900), (2, 5)]
    empty = spark.createDataFrame([], "form_id string")
    assert reports.fill_report(empty, empty, empty, empty).count() == 0
