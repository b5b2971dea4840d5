"""Streams with state of their own, stopped and started in between, against their batch forms."""

import random

import pytest

pytest.importorskip("google.protobuf")

from quillgrid.streaming import stateful as T  # noqa: E402


def test_a_cap_holds_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows, schema = [], "k string, at long, v string"
    for batch in range(3):
        new = [(rng.choice(["hot", "hot", "a", "b", None]), 100 * batch + i, rng.choice(["x", None])) for i in rng.sample(range(100), 30)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        T.start(T.capped_stream(stream, ["k"], ["at"], 7), out, checkpoint).awaitTermination()
        want = T.capped(spark.createDataFrame(rows, schema), ["k"], ["at"], 7).collect()
        got = spark.read.parquet(out).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(got) == 28


def test_places_go_through_the_log_kept_so_far(spark, tmp_path):
    rng = random.Random(8)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema, log, want = "k string, at long, start long, stop long, length long, place long", {}, []
    for batch in range(3):
        new = []
        for i in range(25):
            k, at, s = rng.choice("ab"), 100 * batch + i, rng.randrange(40)
            if rng.random() < 0.5:
                edit = (s, s + rng.randrange(4), rng.randrange(6))
                new.append((k, at, *edit, None))
                log.setdefault(k, []).append(edit)
            else:
                new.append((k, at, None, None, None, s))
                moved = s
                for a, b, n in log.get(k, []):
                    moved = moved + n - (b - a) if moved >= b else moved if moved <= a else None
                    if moved is None:
                        break
                want.append((k, at, s, moved))
        spark.createDataFrame(rng.sample(new, len(new)), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        T.start(T.places_stream(stream, ["k"]), out, checkpoint).awaitTermination()
        assert sorted(map(str, map(tuple, spark.read.parquet(out).collect()))) == sorted(map(str, want))
