"""Fill plans over records of one file: winners are found in parts that grow in number with the records."""

from pyspark.sql import functions as F

from quillgrid.plans import fill


def test_records_are_dealt_before_they_meet_forms(spark, monkeypatch):
    monkeypatch.setattr(fill, "VALUES", 50, raising=False)
    rows = [(r, i, c, f"{c}{r}") for r in range(100) for i, c in enumerate("abc")] + [(7, 3, "d", None), (8, 3, "d", "")]
    records = spark.createDataFrame(rows, "rec_id bigint, col_ord int, column string, value string").coalesce(1)
    matches = spark.createDataFrame([("f", "a", 0, "k", 80, False), ("f", "b", 0, "k", 90, False), ("f", "c", 0, "k", 90, False), ("f", "d", 1, "e", 90, False)], "form_id string, column string, slot_ord int, slot_key string, score int, ambiguous boolean")
    got = fill.fill_plan(records, matches).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.rec_id, r.slot_key, r.column, r.value) for r in got) == [(r, "k", "b", f"b{r}") for r in range(100)]
    assert len({r.task for r in got}) > 3
