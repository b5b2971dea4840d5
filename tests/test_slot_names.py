"""Names of blanks as columns equal those that the driver's plain function gives."""

import random

from quillgrid.plans import fill as P
from quillgrid.plans.queries import SLOTS
from quillgrid.plans.slotnames import names_of

SCHEMA = "form_id string, slot_ord int, id string, labels array<string>, key string, index int, group string"


def test_names_of_many_blanks(spark):
    rng = random.Random(11)
    words = ["성명", "신청인", "본인", "대리인", "주소", "가족", "a b", "b", ""]
    keys = ["성명", "대리인.성명", "신청인.성명", "* 주소:", "", "b", "(b)"]
    slots = list(SLOTS)
    for i in range(300):
        labels = tuple(rng.choice(words).replace(" ", "") for _ in range(rng.randrange(4)))
        slots.append(P.Slot(f"f{i % 7}", i, rng.choice(["", "T1.r2", f"p{i}"]), labels, rng.choice([*keys, ".".join(x for x in labels if x)]), rng.choice([1, 1, 1, 2, 3]), rng.choice(["", "", "대리인 정보", "신청인", "위임하는 사람"])))
    want = {tuple(r) for r in P.names_table(spark, slots).collect()}
    df = spark.createDataFrame([(s.form_id, s.slot_ord, s.id, list(s.labels), s.key, s.index, s.group) for s in slots], SCHEMA)
    got = names_of(df.repartition(5)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 1000
    assert names_of(df.limit(0)).count() == 0


def test_nulls_count_as_empty(spark):
    df = spark.createDataFrame([("f", 1, None, None, None, None, None), ("f", 2, "x", ["a", None], None, None, None)], SCHEMA)
    assert {(r.slot_ord, r.name, r.score) for r in names_of(df).collect()} == {(2, "x", P.ID), (2, "a", P.FULL)}
