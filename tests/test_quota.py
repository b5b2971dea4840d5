"""Quota samples against a draw row by row."""

import random

from pyspark.sql import functions as F

from quillgrid.operators.corpus import quota_sample


def drawn(rows, targets):
    titles, out = set(), []
    for value, quota, cap in targets:
        by_keyword = {}
        for r in sorted((r for r in rows if r[1] == value), key=lambda r: r[5]):
            by_keyword.setdefault(r[2], []).append(r)
        orgs, n = {}, 0
        while n < quota and any(by_keyword.values()):
            for k in sorted(by_keyword, key=lambda k: (k is not None, k or 0)):
                if not by_keyword[k] or n >= quota:
                    continue
                r = by_keyword[k].pop(0)
                title = None if r[4] is None else "".join(r[4].split())
                if title in titles or orgs.get(r[3], 0) >= cap:
                    continue
                titles.add(title)
                orgs[r[3]] = orgs.get(r[3], 0) + 1
                n += 1
                out.append(r[0])
    return sorted(out)


def test_quota_samples_against_a_draw(spark):
    for seed in range(6):
        rng = random.Random(seed)
        n = rng.randrange(20, 160)
        rows = [(i, rng.choice("ab"), rng.choice([0, 1, 2, None]), rng.choice(["o", "p", "q", None]), rng.choice([None, *(f"t {j}" for j in range(rng.choice([5, 60])))]), i * 7919 % 1009) for i in range(n)]
        targets = [("b", rng.randrange(12), rng.randrange(1, 5)), ("none", 3, 3), ("a", rng.randrange(1, 40), rng.randrange(1, 9))]
        df = spark.createDataFrame(rows, "id int, target string, kw int, org string, title string, h int").repartition(3)
        got = quota_sample(df, targets, "target", "kw", "org", "title", F.col("h"))
        assert got.columns == df.columns and sorted(r.id for r in got.collect()) == drawn(rows, targets), seed


def test_a_refused_row_frees_its_title(spark):
    rows = [(1, "a", 0, "o", "x", 1), (2, "a", 0, "o", "y", 2), (3, "b", 0, "p", "y", 1)]
    df = spark.createDataFrame(rows, "id int, target string, kw int, org string, title string, h int")
    assert sorted(r.id for r in quota_sample(df, [("a", 5, 1), ("b", 1, 1)], "target", "kw", "org", "title", F.col("h")).collect()) == [1, 3]
