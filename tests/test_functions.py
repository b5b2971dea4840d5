"""Golden rows and random edits for the functions; every registered query against its SQL."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import labels, text, values
from quillgrid.functions.blanks import blanks_of
from quillgrid.functions.choices import choices_of, mark_for
from quillgrid.functions.diff import text_diff
from quillgrid.plans import fill
from quillgrid.plans.golden import BLANKS, CHOICES, DIFFS
from quillgrid.plans.queries import ORACLES, QUERIES
from quillgrid.sources import records
from quillgrid.streaming import ingest
from tests.conftest import DATA


@pytest.mark.parametrize("row", CHOICES, ids=lambda r: r[0][:20])
def test_choices(row):
    got = [(c.label or "", ",".join(c.options), c.item) for c in choices_of(row[0])]
    assert got == ([(row[1], row[2], row[3])] if row[2] else [])


@pytest.mark.parametrize("row", BLANKS, ids=lambda r: r[0][:20])
def test_blanks(row):
    wide = row[0].replace("\t", "\x01" * 8)
    part = lambda p: f'{p.role}="{wide[p.start : p.end]}"'.replace("\x01", "")
    got = [f"{b.kind}:{'/'.join(b.display)}{'@' + b.lead if b.lead else ''}:{','.join(map(part, b.parts))}" for b in blanks_of(row[0])]
    assert got == row[1]


def test_marks():
    assert mark_for(["없음", "○표를 합니다", "√표"]) == "○" and mark_for([]) == "√"


@pytest.mark.parametrize("row", DIFFS, ids=lambda r: r[0][:10] or "empty")
def test_diffs(row):
    assert [f"{s}-{e}:{t}" for s, e, t in text_diff(row[0], row[1])] == row[2]


def test_random_diffs():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("ab\U0001f600 \n") for _ in range(rng.randint(0, 14))) for _ in "ab")
        u = a.encode("utf-16-le")
        for s, e, t in reversed(text_diff(a, b)):
            u = u[: 2 * s] + t.encode("utf-16-le") + u[2 * e :]
        assert u.decode("utf-16-le") == b


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


LABELS = [("성 명", "성명"), ("성　명:", "성명"), ("(성명)", "성명"), ("(성명:)", "성명:"), ("※ Name 。", "name"), ("[주소)", "주소"), ("", "")]


@pytest.mark.parametrize("raw,want", LABELS)
def test_labels(spark, raw, want):
    assert one(spark, labels.normalise_label(F.lit(raw))) == want
    assert fill._plain(raw) == want


def test_label_predicate(spark):
    for raw, want in [("성명", True), ("※ 참고", False), ("", False), ("2020. 1. 1", False), ("가" * 25, False), ("이 문서는 참고용으로만 씁니다.", False)]:
        assert one(spark, labels.looks_like_label(F.lit(raw))) is want


def test_nfc(spark):
    assert one(spark, labels.nfc(F.lit("한"))) == "한"


DATES = [("2026-10-09", ("2026", "10", "9")), ("2026.1", ("2026", "1", None)), ("20261399", ("2026", "13", "99")), ("2026년 10월 9일", ("2026", "10", "9")), ("no", None), ("today", ("2024", "2", "3"))]


@pytest.mark.parametrize("raw,want", DATES)
def test_dates(spark, raw, want):
    got = one(spark, values.parse_date(F.lit(raw), F.lit(datetime.date(2024, 2, 3))))
    assert (tuple(got) if got else None) == want


SPLITS = [("900101-1234567", 2, "", ["900101", "1234567"]), ("9001011234567", 2, "", ["900101", "1234567"]), ("1-2-3-4", 3, "", ["1", "2", "3-4"]), ("1-2", 3, "", ["1", "2", None]), ("0212345678", 3, "", ["02", "1234", "5678"]), ("01012345678", 3, "", ["010", "1234", "5678"]), ("1234567890", 3, "사업자등록번호", ["123", "45", "67890"]), ("12", 3, "", ["12", None, None])]


@pytest.mark.parametrize("value,n,label,want", SPLITS)
def test_splits(spark, value, n, label, want):
    assert one(spark, values.split_number(F.lit(value), n, F.lit(label))) == want


OPTIONS = [(["있음", "없음"], "없음", ["없음"]), (["우편", "팩스", "전자우편"], "우편, 전자우편", ["우편", "전자우편"]), (["통합송달", "주간송달"], "통합", ["통합송달"]), (["주소 변동 없음"], "Y", ["주소 변동 없음"]), (["주소 변동 없음"], "N", []), (["있음", "없음"], "모름", None), (["보훈대상(10%)", "보훈대상(5%)"], "보훈", None), (["보훈대상(10%)", "보훈대상(5%)"], "보훈대상(5%)", ["보훈대상(5%)"])]


@pytest.mark.parametrize("options,value,want", OPTIONS)
def test_options(spark, options, value, want):
    assert one(spark, values.choose_options(F.array(*map(F.lit, options)), F.lit(value))) == want


def test_widths_and_colours(spark):
    assert math.isclose(one(spark, values.text_width(F.lit("가A1 ."))), 0.971 + 0.65 + 0.55 + 0.5 + 0.55)
    assert one(spark, values.display_width(F.lit("가a"))) == 3
    for hex_, want in [("#0000ff", True), ("ff0000", True), ("#000000", False), ("#ffffff", False), ("#404040", False), ("x", False), (None, False)]:
        assert one(spark, text.is_coloured(F.lit(hex_))) is want


def test_positions(spark):
    at = lambda p, *log: one(spark, text.replayed(F.lit(p), F.array(*(F.struct(F.lit(s).cast("bigint").alias("start"), F.lit(e).cast("bigint").alias("end"), F.lit(n).cast("bigint").alias("length")) for s, e, n in log))))
    assert [at(2, (3, 5, 9)), at(3, (3, 5, 9)), at(4, (3, 5, 9)), at(5, (3, 5, 9)), at(9, (3, 5, 1), (0, 0, 4))] == [2, 3, None, 12, 12]
    assert one(spark, text.replace_range(F.lit("abcdef"), F.lit(1), F.lit(3), F.lit("X"))) == "aXdef"
    assert one(spark, text.replace_range(F.lit("abc"), F.lit(1), F.lit(9), F.lit("X"))) is None


CSV = [("a,b\r\n1,2\n\n3", [{"a": "1", "b": "2"}, {"a": "3", "b": ""}]), ('﻿a;b\n"x""y\nz";"q"r', [{"a": 'x"y\nz', "b": "qr"}]), ("a\tb\n1\t2\t3", [{"a": "1", "b": "2"}]), (' a ,,b\r"open', [{"a": "open", "b": ""}]), ("", [])]


@pytest.mark.parametrize("raw,want", CSV)
def test_csv(raw, want):
    assert records.records_of_csv(raw) == want


def test_records_that_fail():
    with pytest.raises(ValueError):
        records.records_of_csv("name,name\n1,2")
    with pytest.raises(ValueError):
        records.records_of_json("[1]")
    assert records.records_of_json('{"a": 1.0, "b": null, "c": [1, null, "x"], "d": {"e": 1}, "f": true}') == [{"a": "1", "c": "1,,x", "d": "[object Object]", "f": "true"}]


def test_read_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,값\n홍,1\n".encode("cp949"))
    (tmp_path / "b.json").write_text('[{"k": 1}]')
    (tmp_path / "c.csv").write_text("x,x\n1,2")
    got = {(r.path.rsplit("/", 1)[-1], r.rec_id, r.column, r.value, r.error is None) for r in records.read_records(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.csv", 0, "이름", "홍", True), ("a.csv", 0, "값", "1", True), ("b.json", 0, "k", "1", True), ("c.csv", None, None, None, False)}


def test_parties():
    slot = fill.Slot("f", 1, "id1", ("대리인", "성명"), "대리인.성명")
    assert "성명" not in fill.slot_names(slot) and fill.slot_names(slot)["대리인.성명"][0] == 80
    own = fill.with_first_of_outer([fill.Slot("f", 1, "id1", ("학교", "기간"), "x"), fill.Slot("f", 2, "id2", ("학교", "과"), "y")])
    assert fill.slot_names(own[0])["학교"] == (80, "") and "학교" not in fill.slot_names(own[1]) and fill.slot_names(own[0])["기간"] == (50, "학교")


def test_stream(spark, tmp_path):
    top = f"file://{tmp_path}"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string").write.parquet(f"{top}/in")
    read = lambda: spark.readStream.schema("id long, text string").parquet(f"{top}/in")
    ingest.start(read(), f"{top}/out", f"{top}/cp").awaitTermination(60)
    spark.createDataFrame([(4, "b"), (5, "c")], "id long, text string").write.mode("append").parquet(f"{top}/in")
    ingest.start(read(), f"{top}/out", f"{top}/cp").awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(f"{top}/out").collect()) == ["a", "b", "c"]


def norm(v):
    return "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, name):
    sf = DATA / "sf0.001"
    if not sf.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in sf.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, str(sf))
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted("|".join(norm(v) for v in r) for r in got.select(*cols).collect())
    assert rows == sorted("|".join(norm(v) for v in r) for r in want.select(",".join(f'"{c}"' for c in cols)).fetchall())
