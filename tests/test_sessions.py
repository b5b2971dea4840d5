"""Bursts of changes: in batch against brute force, as a stream with late rows and a restart."""

import random
from datetime import datetime, timedelta

from quillgrid.streaming import sessions

T0 = datetime(2026, 1, 1)
SCHEMA = "k string, at timestamp, state int"


def at(s):
    return T0 + timedelta(milliseconds=s)


def test_bursts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), at(rng.randrange(0, 20_000, 50)), rng.randrange(9)) for _ in range(150)] + [("a", None, 1)]
    got = sessions.session_states(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], "at", "state", "500 milliseconds").collect()
    want = []
    for k in ("a", "b", None):
        burst = []
        for t, s in sorted((t, s) for q, t, s in rows if q == k and t) + [(datetime.max, 0)]:
            if burst and t - burst[-1][0] > timedelta(milliseconds=500):
                want.append((k, burst[0][0], burst[-1][0], burst[-1][1], len(burst)))
                burst = []
            burst.append((t, s))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 20
    assert sessions.session_states(spark.createDataFrame([], SCHEMA), ["k"], "at", "state", "1 second").count() == 0


def test_a_stream_tells_each_burst_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame([("a", at(t), s) for t, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        sessions.start(stream, ["k"], "at", "state", "500 milliseconds", "1 second", out, checkpoint).awaitTermination()
        return sorted((r.at, r.state, r.n) for r in spark.read.parquet(out).collect())

    assert arrive((0, 1), (300, 2)) == []
    # The watermark passes the first burst; the stream was stopped and started in between.
    assert arrive((10_000, 3)) == [(at(300), 2, 2)]
    # Older than the watermark: dropped. In time, though out of order: joins its burst.
    assert arrive((400, 9), (9_800, 4)) == [(at(300), 2, 2)]
    assert arrive((30_000, 5)) == [(at(300), 2, 2), (at(10_000), 3, 2)]
