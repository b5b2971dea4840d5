"""Dictionaries, constraints and files against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import constraints as K
from quillgrid.operators import dictionaries as D
from quillgrid.sources import files as X


def test_dense_numbers_hold_for_a_key_in_many_tasks(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.7 else rng.choice(["b", "c", None]), i) for i in rng.sample(range(10_000), 3000)]
    got = D.dense_numbers(spark.createDataFrame(rows, "k string, x int").repartition(7), ["k"], ["x"]).collect()
    want = {(k, x): n for key in {k for k, _ in rows} for n, (k, x) in enumerate(sorted(r for r in rows if r[0] == key))}
    assert {(r.k, r.x): r.number for r in got} == want and len(got) == len(rows)
    assert D.dense_numbers(spark.createDataFrame([], "k string, x int"), ["k"], ["x"]).count() == 0


def test_upsert_finds_or_adds_in_the_order_of_asking(spark):
    rng = random.Random(9)
    for _ in range(3):
        old = {k: [(rng.randrange(4), rng.choice(["r", "g", None])) for _ in range(rng.randrange(6))] for k in "abc"}
        asks = [(rng.choice("abcd"), i, rng.randrange(5), rng.choice(["r", "g", "b", None])) for i in range(60)]
        entries = spark.createDataFrame([(k, i, *e) for k, es in old.items() for i, e in enumerate(es)] or [], "k string, id int, size int, colour string")
        grown, answers = D.upserted(entries, spark.createDataFrame(asks, "k string, at int, size int, colour string").repartition(5), ["k"], ["size", "colour"], ["at"])
        want, told = {k: list(v) for k, v in old.items()}, {}
        for k, _, *e in asks:
            entry, book = tuple(e), want.setdefault(k, [])
            if entry not in book:
                book.append(entry)
            told[k, entry] = book.index(entry), entry not in old.get(k, [])
        assert sorted(map(str, ((r.k, r.id, r.size, r.colour) for r in grown.collect()))) == sorted(map(str, ((k, i, *e) for k, b in want.items() for i, e in enumerate(b))))
        assert {(r.k, (r.size, r.colour)): (r.id, r.fresh) for r in answers.collect()} == told


def test_written_text_turns_black_and_nothing_else(spark):
    styles = spark.createDataFrame([("f", 0, 10, "#000000"), ("f", 1, 10, "#FF0000"), ("f", 2, 12, "0000ff"), ("f", 3, 9, "#ffffff"), ("f", 4, 9, "bad")], "form string, id int, size int, colour string")
    runs = spark.createDataFrame([("f", 1, 0, 5, 1), ("f", 1, 5, 9, 2), ("f", 1, 9, 12, 3), ("f", 2, 0, 4, 4), ("f", 2, 4, 8, 77), ("f", 3, 0, 8, 1), (None, 1, 0, 4, 1)], "form string, p int, start int, end int, id int")
    over = spark.createDataFrame([("f", 1, 2, 7), ("f", 1, 6, 11), ("f", 2, 0, 8), ("f", 3, 3, 3)], "form string, p int, start int, end int")
    grown, changed = D.recoloured(runs, over, styles, ["form"], ["size", "colour"])
    assert {tuple(r) for r in grown.collect()} - {tuple(r) for r in styles.collect()} == {("f", 5, 12, "#000000")}
    at = {(r.form, r.p, x): r.id for r in changed.collect() for x in range(r.start, r.end)}
    want = {(r.form, r.p, x): r.id for r in runs.collect() for x in range(r.start, r.end)}
    for form, p, a, b in over.collect():
        for x in range(a, b):
            want[form, p, x] = {1: 0, 2: 5}.get(want.get((form, p, x)), want.get((form, p, x)))
    assert at == {k: v for k, v in want.items() if v is not None}
    colours = spark.createDataFrame([("#404040",), ("#414040",), ("#d0d0d0",), ("#cfffff",), (None,), ("red",)], "c string")
    assert [r[0] for r in colours.select(D.marked_out(F.col("c"))).collect()] == [False, True, False, True, False, False]


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_ranges_and_nulls_turn_black_as_by_force(spark, monkeypatch, broadcast):
    """Pieces, colours and the order of new styles, over ranges that overlap, touch or repeat, with null keys and paragraphs."""
    if not broadcast:
        monkeypatch.setattr(D, "few", lambda df: False)
    rng = random.Random(12)
    styles = [(f, i, rng.choice([9, 10, None]), rng.choice(["#000000", "#ff0000", "#0000ff", "#ffffff", None])) for f in ("f", "g", None) for i in range(9)]
    paragraphs = [(f, p) for f in ("f", "g", None) for p in [None, *range(12)]]
    runs = [(f, p, 7 * i, 7 * i + rng.choice([0, 5, 7]), rng.choice([*range(10), None])) for f, p in paragraphs for i in range(rng.randrange(6))]
    over = [(f, p, a, a + rng.choice([0, 1, 4, 15])) for f, p in paragraphs for a in (rng.randrange(40) for _ in range(rng.randrange(5)))]
    over += over[:9]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(4)
    grown, changed = D.recoloured(make(runs, "form string, p int, start int, end int, id int"), make(over, "form string, p int, start int, end int"), make(styles, "form string, id int, size int, colour string"), ["form"], ["size", "colour"])
    cut = []
    for f, p, a, b, i in runs:
        mine = [(s, e) for g, q, s, e in over if (g, q) == (f, p) and s < e]
        at = sorted({a, b} | {x for r in mine for x in r if a < x < b})
        cut += [(f, p, s, e, i, any(x < e and y > s for x, y in mine)) for s, e in zip(at, at[1:])]
    of, want, book = {(f, i): (n, c) for f, i, n, c in styles}, {}, list(styles)
    for f, p, s, e, i, black in sorted(cut, key=lambda c: (c[1] is not None, c[1] or 0, c[2])):
        n, c = of.get((f, i), (None, None))
        if black and c in ("#ff0000", "#0000ff"):
            same = [x for g, x, m, d in book if (g, m, d) == (f, n, "#000000")]
            if not same:
                same = [1 + max(x for g, x, *_ in book if g == f)]
                book.append((f, same[0], n, "#000000"))
            i = min(same)
        want.setdefault((f, p, s, e), []).append(i)
    assert sorted(map(repr, map(tuple, changed.collect()))) == sorted(repr((*k, i)) for k, ids in want.items() for i in ids)
    assert sorted(map(repr, map(tuple, grown.collect()))) == sorted(map(repr, book)) and len(book) > len(styles)


def test_lines_are_read_once_and_first_places_are_found_without_sorting_pieces(spark, monkeypatch):
    from quillgrid.plans import growqueries as G

    plans, readers, write = {}, [], D.written

    def watched(df, name):
        readers.extend(name for f in df.inputFiles() if "lineitem" in f)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    def asked(entries, wanted, *how):
        plans["wanted"] = wanted._jdf.queryExecution().executedPlan().toString()
        return upsert(entries, wanted, *how)

    upsert = D.upserted
    monkeypatch.setattr(D, "upserted", asked)
    monkeypatch.setattr(D, "written", watched)
    monkeypatch.setattr(G, "written", watched, raising=False)
    got = G.recolour_runs(spark, "/root/testdata/sf0.001")
    assert got.count() and readers == ["lines"]
    assert "HashAggregate" in plans["wanted"] and "SortAggregate" not in plans["wanted"] and "BroadcastHashJoin" in plans["pieces"]


def _constraints(spark):
    there = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    return [K.Holds("positive", F.col("n") > 0, share=0.5), K.Holds("short", F.length("t") < 3, F.col("n") > 1), K.Refers("no such id", ("ref",), there, ("id",)), K.Once("twice", ("ref", "n"))]


def test_problems_and_tallies_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "a", "abcd"]), rng.choice([None, 1, 2, 3])) for i in range(80)]
    df, rules = spark.createDataFrame(rows, "i int, n int, t string, ref int").repartition(3), _constraints(spark)
    want, seen = [], {}
    for i, n, t, ref in rows:
        want += [(i, "positive")] * (not (n or 0) > 0) + [(i, "short")] * (n is not None and n > 1 and not (t is not None and len(t) < 3))
        want += [(i, "no such id")] * (ref == 3)
        if n is not None and ref is not None:
            seen.setdefault((ref, n), []).append(i)
    want += [(min(x), "twice") for x in seen.values() if len(x) > 1]
    assert sorted(map(tuple, K.problems(df, ["i"], rules).collect())) == sorted(want)
    told = {r.name: (r.checked, r.failed, r.passed) for r in K.tally(df, rules[:2]).collect()}
    bad = [sum(p == name for _, p in want) for name in ("positive", "short")]
    asked = [80, sum(n is not None and n > 1 for _, n, _, _ in rows)]
    assert told == {"positive": (80, bad[0], 80 - bad[0] >= 40), "short": (asked[1], bad[1], bad[1] == 0)}
    watched, seen_by = K.observed(df, rules[:2])
    assert watched.count() == 80 and K.broken(seen_by, rules[:2]) == [n for n, x in told.items() if not x[2]]
    none = df.limit(0)
    assert K.problems(none, ["i"], rules).count() == 0 and all(r.passed for r in K.tally(none, rules[:2]).collect()) and K.problems(df, ["i"], []).count() == 0


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    files = spark.createDataFrame([(f"f{i}.txt", bytes([i] * i)) for i in range(23)] + [("empty", None)], "name string, content binary").repartition(4)
    X.save(files, out)
    assert sorted(os.listdir(out)) == sorted([f"f{i}.txt" for i in range(23)] + ["empty"])
    assert (tmp_path / "out" / "f7.txt").read_bytes() == bytes([7] * 7) and (tmp_path / "out" / "empty").read_bytes() == b""
    manifest = X.digests(files)
    after = files.withColumn("content", F.when(F.col("name") == "f3.txt", F.lit(b"new")).otherwise(F.col("content"))).unionByName(spark.createDataFrame([("more", b"x")], "name string, content binary"))
    assert {r.name for r in X.changed(after, manifest).collect()} == {"f3.txt", "more"}
    X.save(X.changed(after, manifest), out)
    assert (tmp_path / "out" / "f3.txt").read_bytes() == b"new" and len(os.listdir(out)) == 25
    bad = spark.createDataFrame([("good", b"1"), ("a/b", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="not the name of a file"):
        X.save(bad, str(tmp_path / "none"))
    left = tmp_path / "none"
    assert not left.exists() or not [x for x in os.listdir(left) if not x.startswith("_")]
