"""Pairs at exactly the threshold whose signatures agree seldom."""

import numpy as np
import pytest

from quillgrid.llm import neardup


def test_an_isolated_pair_whose_signatures_agree_in_36_places(spark):
    w = [f"p67974x{j}" for j in range(10)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w[:-1], "q67974"]))], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words_each=2).collect()}
    assert got == {1: 1, 2: 1}  # 8 of 10 shingles


@pytest.mark.parametrize(("short", "agree"), [(0, 0), (neardup.SHORT, neardup.FLOOR)])
def test_a_mixed_list_is_confirmed_under_the_match_count(spark, monkeypatch, short, agree):
    """Members of one list meet on full sets: from FLOOR matches on in short lists, whatever the signatures in long ones."""
    monkeypatch.setattr(neardup, "SHORT", short)
    w = [f"p67974x{j}" for j in range(10)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w[:-1], "q67974"]))], "doc_id bigint, text string")
    sketch = neardup.sketches(docs, 2, 64, 4).selectExpr("doc_id AS id", "n_shingles AS n", "k1")
    rows = [(i, np.array([7 if c < agree else i for c in range(64)], np.uint32)) for i in (1, 2)]
    signs = spark.createDataFrame([(i, m.tolist(), neardup.nibbles(m).tolist()) for i, m in rows], "id bigint, sig array<int>, nib array<bigint>")
    posts = spark.createDataFrame([(1, 7), (2, 7)], "id bigint, key bigint")
    first = spark.createDataFrame([], "node bigint, component bigint")
    got = neardup._rest(posts, first, sketch.join(signs, "id"), docs, 2, 80, 64, 34).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]
