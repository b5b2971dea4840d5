"""Containers made by our own writers and read again; edge sizes of streams, records, trailers and damage."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillgrid.sources import containers as C

SIZES = [0, 1, 63, 64, 65, 4095, 4096, 4097, 20000, 300000]


def body(n):
    return random.Random(n).randbytes(n)


def test_compound_round_trip():
    files = {f"s{n}": body(n) for n in SIZES} | {"BodyText/Section0": body(77), "BodyText/Section10": b"x", "a/b/c": b"deep"}
    raw = C.compound_of(files)
    assert dict(C.CompoundFile(raw).streams()) == files
    assert dict(C.entries_of(raw)) == files


@pytest.mark.parametrize("cut", [100, 512, 700])
def test_damaged_compound(cut):
    raw = C.compound_of({"s": body(5000)})
    with pytest.raises((C.Damaged, struct.error)):
        dict(C.entries_of(raw[:cut]))


def test_streams_and_trailers():
    for n in SIZES:
        for trailer in (False, True):
            packed = C.encode_stream(body(n), True, trailer)
            assert C.decode_stream(packed, True) == body(n)
    with pytest.raises(C.Damaged):
        C.decode_stream(C.encode_stream(b"abc", True, False) + b"12345678", True)
    with pytest.raises(C.Damaged):
        C.inflate(C.encode_stream(body(99), True, False)[:-3])


def test_records():
    want = [(66, 0, b""), (67, 1, body(4094)), (68, 2, body(4095)), (1023, 1023, body(5000))]
    raw = C.join_records(want)
    assert list(C.split_records(raw)) == want
    for cut in (2, len(raw) - 1):
        with pytest.raises(C.Damaged):
            list(C.split_records(raw[:cut]))


def test_file_header():
    raw = C.FORM_SIGNATURE.ljust(32, b"\0") + bytes([1, 0, 1, 5]) + struct.pack("<I", 0b101)
    got = C.file_header(raw)
    assert got["version"] == "5.1.0.1" and got["compressed"] and got["distribution"] and not got["password"]


def test_zip():
    raw = C.zip_of([("mimetype", b"application/x"), ("한글.xml", b"<a/>" * 500), ("r", body(300))])
    assert dict(C.entries_of(raw))["한글.xml"] == b"<a/>" * 500
    new = C.replace_entries(raw, {"한글.xml": b"<b/>"})
    assert [n for n, _ in C.entries_of(new)] == ["mimetype", "한글.xml", "r"] and dict(C.entries_of(new))["한글.xml"] == b"<b/>"
    assert C.replace_entries(raw, {}) is raw
    with pytest.raises(KeyError):
        C.replace_entries(raw, {"none": b""})
    with pytest.raises(C.Damaged):
        dict(C.entries_of(raw[:-30]))


def test_files_in_spark(spark, tmp_path):
    section = C.encode_stream(C.join_records([(66, 0, b"ab"), (67, 1, b"")]), True, True)
    (tmp_path / "a.hwp").write_bytes(C.compound_of({"BodyText/Section0": section, "BodyText/Section10": section, "BodyText/Section9": b"bad"}))
    (tmp_path / "b.hwpx").write_bytes(C.zip_of([("Contents/section0.xml", b"<x/>")]))
    (tmp_path / "c.hwp").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(b"no form")
    files = C.read_files(spark, f"file://{tmp_path}")
    assert {(r.path[-5:], r.kind) for r in files.collect()} == {("a.hwp", "compound"), (".hwpx", "zip"), ("c.hwp", "unknown")}
    found = C.entries(files.where("kind <> 'unknown'"))
    numbered = C.sections(found)
    assert [r.section for r in numbered.where(F.col("path").endswith("a.hwp")).orderBy("section").collect()] == [0, 9, 10]
    got = C.records(numbered.where(F.col("path").endswith("a.hwp"))).collect()
    assert sum(r.tag is not None for r in got) == 4 and sum(r.error is not None for r in got) == 1
    assert C.entries(files.where("kind = 'unknown'")).first().error


def test_output_names(spark):
    rows = spark.createDataFrame([(1, 1, "f", "a/b"), (1, 2, "f", "a/b"), (2, 1, "g", None)], "form_ord int, row int, form string, who string")
    got = [r.name for r in C.output_names(rows, ["who"], "form", "row").orderBy("form_ord", "row").collect()]
    assert got == ["a_b", "a_b (2)", "g"] and zlib
