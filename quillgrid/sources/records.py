"""Records from CSV and JSON as the long table (rec_id, col_ord, column, value)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\r\x0b\x0c                 　﻿"


def decode(raw: bytes) -> str:
    """Strict UTF-8 (a byte order mark goes), else the Korean code page."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp949", "replace")


def delimiter_of(text: str) -> str:
    """By the first line: tabs before commas, semicolons before commas, each only if there are more of them."""
    line = text.splitlines()[0] if text else ""
    commas = line.count(",")
    return "\t" if line.count("\t") > commas else ";" if line.count(";") > commas else ","


def rows_of_csv(text: str, delimiter: str | None = None) -> list[list[str]]:
    """RFC 4180 rows: a quote opens a field only where it is still empty, text after its close is appended, rows without text go."""
    delimiter = delimiter or delimiter_of(text)
    rows: list[list[str]] = [[]]
    field: list[str] = []
    quoted = False
    i = 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c != '"':
                field.append(c)
            elif text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            else:
                quoted = False
        elif c == '"' and not field:
            quoted = True
        elif c == delimiter or c in "\r\n":
            rows[-1].append("".join(field))
            field = []
            if c != delimiter:
                i += text[i : i + 2] == "\r\n"
                rows.append([])
        else:
            field.append(c)
        i += 1
    rows[-1].append("".join(field))
    return [r for r in rows if any(f.strip(SPACES) for f in r)]


def records_of_csv(text: str, delimiter: str | None = None) -> list[dict[str, str]]:
    rows = rows_of_csv(text.removeprefix("﻿"), delimiter)
    names = [n.strip(SPACES) for n in rows[0]] if rows else []
    twice = {n for n in names if n and names.count(n) > 1}
    if twice:
        raise ValueError(f"repeated columns: {', '.join(sorted(twice))}")
    return [{n: (r[i] if i < len(r) else "") for i, n in enumerate(names) if n} for r in rows[1:]]


def text_of(value: object) -> str:
    """A JSON value as text: whole numbers without a point, arrays joined by commas."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, list):
        return ",".join("" if v is None else text_of(v) for v in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def records_of_json(text: str) -> list[dict[str, str]]:
    got = json.loads(text.removeprefix("﻿"))
    got = got if isinstance(got, list) else [got]
    if not all(isinstance(r, dict) for r in got):
        raise ValueError("records are objects")
    return [{k: text_of(v) for k, v in r.items() if v is not None} for r in got]


def read_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, rec_id, col_ord, column, value, error) of every data file; a file that can't be read gives one row with its error."""
    files = spark.read.format("binaryFile")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path_, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    text = decode(bytes(content))
                    looks = path_.lower().endswith(".json") or text.lstrip(SPACES)[:1] in ("[", "{")
                    records = records_of_json(text) if looks else records_of_csv(text, "\t" if path_.lower().endswith(".tsv") else None)
                    rows = [(path_, i, j, c, v, None) for i, r in enumerate(records) for j, (c, v) in enumerate(r.items())]
                except ValueError as e:
                    rows = [(path_, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "rec_id", "col_ord", "column", "value", "error"]).astype({"rec_id": "Int64", "col_ord": "Int32"})

    return files.mapInPandas(run, "path string, rec_id bigint, col_ord int, column string, value string, error string")


def long_records(df: DataFrame, rec_id: str, columns: dict[str, str]) -> DataFrame:
    """The long table of a wide one: ``columns`` maps a record's column to an expression over ``df``; all values are text."""
    cells = F.array(*(F.struct(F.lit(i).alias("col_ord"), F.lit(c).alias("column"), F.expr(e).cast("string").alias("value")) for i, (c, e) in enumerate(columns.items())))
    return df.select(F.col(rec_id).alias("rec_id"), F.explode(cells).alias("c")).select("rec_id", "c.col_ord", "c.column", "c.value")


def json_column_records(df: DataFrame, rec_id: str, column: str) -> DataFrame:
    """(rec_id, column, value) of a column of JSON objects, without nulls, numbers as they read in text."""
    text, typed = F.from_json(column, "map<string,string>"), F.from_json(column, "map<string,variant>")
    got = df.select(F.col(rec_id).alias("rec_id"), typed.alias("_typed"), F.explode(text).alias("column", "value")).where("value is not null")
    string = F.schema_of_variant(F.col("_typed")[F.col("column")]) == "STRING"
    return got.select("rec_id", "column", F.when(string, F.col("value")).otherwise(F.regexp_replace("value", r"^(-?\d+)\.0+$", "$1")).alias("value"))
