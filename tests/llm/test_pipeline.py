"""The pipeline on small tables: each stage's decisions, and run() against the stages by brute force."""

import re

import corpus_pipeline as C
from tests.llm.test_operators import BLANKS, FOLD, PLAIN, components_by_force, contamination

GOOD = [(i, f"Document {i} tells about thing{i} and thing{i * 7} in plain sentences that end. " + " ".join(f"word{(i * 13 + j) % 500}" for j in range(60)) + ".") for i in range(1, 90)]
BAD = [(1000 + i, "$$$ buy buy buy | now " * (4 + i % 9)) for i in range(60)]


def write(spark, top, rows, bench, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")


def test_run(spark, tmp_path):
    top = f"file://{tmp_path}"
    passage = "this passage of the benchmark has more words than ten and is quoted whole"
    extra = [(500, GOOD[0][1]), (501, GOOD[1][1] + " tail"), (502, "Some other page has " + " ".join(f"word{(j * 17 + 5) % 500}" for j in range(60)) + " and says that " + passage + "."), (503, GOOD[3][1].replace("word", "verb") + " password=abcdefghijklmnop")]
    rows = [*GOOD, *BAD, *extra]
    write(spark, top, rows, [(1, passage)], [(i, 1, 0) for i, _ in GOOD] + [(i, 0, 1) for i, _ in BAD])
    docs = spark.read.parquet(f"{top}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, top)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    text = dict(rows)
    first = seen["quality classifier"]
    assert {i for i, _ in GOOD} <= set(first) and not {i for i, _ in BAD} & set(first)
    groups = components_by_force([(i, text[i]) for i in first], 5, 80)
    assert set(seen["near dedup"]) == {i for i, c in groups.items() if i == c}
    dirty = {i for i, _, n, _ in contamination([(i, text[i]) for i in seen["near dedup"]], [(1, passage)]) if n}
    assert dirty == {502}
    assert set(seen["benchmark decontamination"]) == set(seen["near dedup"]) - dirty
    assert set(seen["secret scan"]) == set(seen["benchmark decontamination"]) and not any(re.search("abcdefghijklmnop", t) for t in seen["secret scan"].values())
    got = C.run(spark, top)
    assert {r.doc_id for r in got.collect()} == set(seen["secret scan"])
    assert BLANKS and FOLD and PLAIN


def test_odd_rows(spark, tmp_path):
    top = f"file://{tmp_path}"
    write(spark, top, [*GOOD, *BAD], [(1, None), (2, "")], [(i, 1, 0) for i, _ in GOOD] + [(i, 0, 1) for i, _ in BAD] + [(None, 1, 0)])
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, h int, _d string"
    good = GOOD[0][1]
    rows = [(1, good), (1, good), (2, GOOD[1][1]), (2, GOOD[2][1]), (None, GOOD[4][1]), (3, None), (4, ""), (5, good + " long" * 50_000)]
    odd = spark.createDataFrame([(i, t, None, "s", 0, "kept", 7, "d") for i, t in rows], kind).repartition(3)
    for docs in (odd, odd.limit(0)):
        for _, stage in C.STAGES[:-1]:
            runs = [stage(spark, docs, top).collect() for _ in range(2)]
            assert sorted(runs[0], key=repr) == sorted(runs[1], key=repr)  # no stage chooses at random
            assert all(r.score == "kept" and (r.h, r["_d"]) == (7, "d") for r in runs[0])
            docs = spark.createDataFrame(runs[0], docs.schema)
        ids = [r.doc_id for r in docs.collect()]
        assert not ids or (None in ids and ids.count(1) == ids.count(2) == 1)
        got = C.STAGES[-1][1](spark, docs, top)
        assert got.where("doc_id = 1").count() in (0, 2)
