"""Plans written into paragraphs: read back, several blanks of one paragraph, values that do not suit."""

from pyspark.sql import functions as F

from quillgrid.functions.writing import bound
from quillgrid.plans import fill as P

PART = "struct<role:string,start:int,end:int,align:string,prefix:string>"


def _applied(spark, plan, blanks, paragraphs):
    plan = spark.createDataFrame(plan, "form_id string, rec_id int, slot_key string, value string")
    blanks = spark.createDataFrame(blanks, f"form_id string, slot_key string, p int, kind string, label string, parts array<{PART}>")
    paragraphs = spark.createDataFrame(paragraphs, "form_id string, p int, text string")
    return {(r.form_id, r.rec_id, r.p): (r.text, r.filled, r.failed) for r in P.fill_apply(plan, blanks, paragraphs).collect()}


def _one(start, end, align="left", role="value", prefix=None):
    return (role, start, end, align, prefix)


def test_every_value_is_read_back(spark):
    text = "Name[" + " " * 30 + "] Phone[" + " " * 30 + "]"
    blanks = [("f", "name", 0, "text", "name", [_one(5, 35)]), ("f", "phone", 0, "text", "phone", [_one(43, 73)])]
    plan = [("f", i, k, f"{k}-{i}") for i in range(20) for k in ("name", "phone")]
    got = _applied(spark, plan, blanks, [("f", 0, text), ("f", 1, "nothing here")])
    assert len(got) == 20
    for (_, i, _), (t, filled, failed) in got.items():
        assert filled == ["name", "phone"] and failed == []
        inner = t.removeprefix("Name[").removesuffix("]").split("] Phone[")
        assert [x.strip() for x in inner] == [f"name-{i}", f"phone-{i}"]


def test_what_does_not_suit_fails_and_the_rest_is_written(spark):
    text = "on (    ).(  ).(  ) by [      ]"
    parts = [_one(4, 8, role="year"), _one(11, 13, role="month"), _one(16, 18, role="day")]
    blanks = [("f", "date", 0, "date", "", parts), ("f", "by", 0, "text", "", [_one(24, 30)]), ("f", "out", 0, "text", "", [_one(28, 99)]), ("f", "same", 0, "text", "", [_one(26, 29)])]
    plan = [("f", 1, "date", "2026-03-04"), ("f", 1, "by", "me"), ("f", 2, "date", "soon"), ("f", 2, "by", "you"), ("f", 3, "out", "x"), ("f", 4, "by", "a"), ("f", 4, "same", "b"), ("f", 5, "unknown", "x"), ("g", 1, "by", "x")]
    got = _applied(spark, plan, blanks, [("f", 0, text)])
    assert set(got) == {("f", i, 0) for i in (1, 2, 3, 4)}
    assert "2026" in got["f", 1, 0][0] and "me" in got["f", 1, 0][0] and sorted(got["f", 1, 0][1]) == ["by", "date"]
    assert got["f", 2, 0][0].startswith("on (    ).(  ).(  ) by [you") and got["f", 2, 0][1:] == (["by"], ["date"])
    assert got["f", 3, 0] == (text, [], ["out"])
    assert got["f", 4, 0][1:] == (["by"], ["same"])
    assert _applied(spark, [], blanks, [("f", 0, text)]) == {}


def test_bound_is_the_plain_expression(spark):
    """Null, empty and repeated values; within a lambda, and one bound value inside another."""
    rows = spark.createDataFrame([(1, ["a", None, "", "a"]), (2, []), (3, None)], "id int, v array<string>")
    wide = lambda x: F.concat(x, F.lit("|"), x, F.char_length(x).cast("string"))
    twice = lambda x: bound(wide(x), wide)
    got = rows.select("id", F.transform("v", twice).alias("a"), F.transform("v", lambda x: wide(wide(x))).alias("b")).orderBy("id").collect()
    assert [r.a for r in got] == [r.b for r in got] == [["a|a1|a|a14", None, "|0||02", "a|a1|a|a14"], [], None]
