"""op9's result is the same in every run, and what it says of shards adds up."""

from collections import Counter

from quillgrid.llm.queries import op9_size_tiered_shards

from ..conftest import DATA


def test_result_is_repeatable_and_adds_up(spark):
    got = [sorted(map(tuple, op9_size_tiered_shards(spark, str(DATA / "sf0.01")).collect())) for _ in range(2)]
    assert got[0] == got[1]
    want = sorted(r.doc_id for r in spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")).collect())
    assert [r[0] for r in got[0]] == want
    sizes = Counter(r[2] for r in got[0])
    assert all(sizes[r[2]] == r[3] for r in got[0]) and len(sizes) == got[0][0][7]
