"""Cases that once came out wrong: deep levels, JSON strings that look like numbers, decomposed names, taken file names."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import labels
from quillgrid.operators.groups import level_parents
from quillgrid.plans import fill
from quillgrid.sources import containers, records


def test_parents_at_any_level(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([0, 1, 2, 5, 40, 1023, None])) for k in range(5) for i in range(60)] + [(9, 0, 0), (9, 1, 4), (9, 2, 5)]
    df = spark.createDataFrame(rows, "k int, ord int, level int").repartition(3)
    got = {(r.k, r.ord): r.parent for r in level_parents(df, ["k"], "ord", "level").collect()}
    for k, i, level in rows:
        before = [j for q, j, other in rows if q == k and j < i and None not in (level, other) and other < level]
        assert got[k, i] == max(before, default=None)


def test_json_strings_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, '{"a": "3.0", "b": 3.0, "c": "1.00", "d": 7, "e": null}'), (2, None)], "id int, j string")
    got = {r.column: r.value for r in records.json_column_records(df, "id", "j").collect()}
    assert got == {"a": "3.0", "b": "3", "c": "1.00", "d": "7"}


def test_decomposed_columns_match(spark):
    columns = spark.createDataFrame([(unicodedata.normalize("NFD", "성명"),), ("주소",)], "column string")
    names = spark.createDataFrame([("f", 0, "성명", "성명", 80, ""), ("f", 1, "주소", "주소", 80, "")], "form_id string, slot_ord int, slot_key string, name string, score int, qualifier string")
    assert {r.slot_ord for r in fill.match(columns, names, labels.alias_table(spark)).collect()} == {0, 1}


@pytest.mark.parametrize("text", ["(" + "가" * 23 + ")", "가" * 25, "\U00020000" * 13, "* 참고", "성 명", "12-3", "", "이름을 정확하게 적어 주십시오.", unicodedata.normalize("NFD", "가" * 20), " : ", "전화번호:"])
def test_one_rule_for_labels(spark, text):
    composed = unicodedata.normalize("NFC", text)
    assert labels.is_label(text) is spark.range(1).select(labels.looks_like_label(F.lit(composed))).first()[0]


def test_taken_names_go_on(spark):
    rows = spark.createDataFrame([(0, i, "f", n) for i, n in enumerate(["x", "x", "x (2)", "x", "y", "", "x (2)"])], "form_ord int, row int, form string, who string")
    got = [r.name for r in containers.output_names(rows, ["who"], "form", "row").orderBy("row").collect()]
    assert got == ["x", "x (2)", "x (2) (2)", "x (3)", "y", "f", "x (2) (3)"]
