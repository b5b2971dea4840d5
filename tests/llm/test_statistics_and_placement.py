"""op5's statistics and scores, and where op9 puts each row, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np

from quillgrid.llm import kernel, quality, shards
from quillgrid.llm.queries import op5_quality_classifier

from ..conftest import DATA

CHARS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "point": ".,;:!?'\"()-",
    "symbol": "#*$%&|<>{}[]\\/=+_@~^",
    "break": "\n",
}


def statistics(text: str) -> dict[str, float]:
    """Each statistic but the repeated n-grams' characters, which test_operators holds against brute force; sizes are in bytes."""
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size = max(len(words), 1), max(len(data), 1)
    length = [len(w) for w in words]
    mean = sum(length) / n
    low = Counter(bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words)
    out = {"n_words": math.log1p(len(words)), "n_bytes": math.log1p(len(data)), "mean_word": mean, "sd_word": math.sqrt(max(sum(x * x for x in length) / n - mean**2, 0)), "long_word": max(length, default=0)}
    out |= {name: sum(b in s.encode() for b in data) / size for name, s in CHARS.items()}
    out["beyond"] = sum(b >= 0x80 for b in data) / size
    out["distinct_words"], out["top_word"] = len(low) / n, max(low.values(), default=0) / n
    out["entropy"] = -sum(c / n * math.log2(c / n) for c in low.values())
    out["one_char_words"] = sum(x == 1 for x in length) / n
    out["plain_words"] = sum(all(b >= 0x80 or chr(b).isalpha() for b in w) for w in words) / n
    out["capital_words"] = sum(65 <= w[0] <= 90 for w in words) / n
    out["stop_words"] = sum(x <= 3 for x in length) / n
    five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    out["n_repeat_words"] = sum(any(five[tuple(words[i : i + 5])] > 1 for i in range(max(0, j - 4), min(j, len(words) - 5) + 1)) for j in range(len(words))) / n
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    points = lambda b: len(re.sub(rb"[\x20\x09-\x0D]+", b"", b).decode())
    count = Counter(lines)
    out["n_dup_lines"] = (len(lines) - len(count)) / n
    out["dup_line_chars"] = sum(points(x) for x in lines if count[x] > 1) / max(points(data), 1)
    return out


def buffer(texts):
    data = b"".join(t.encode() for t in texts)
    return np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_statistics_of_texts():
    rng = random.Random(6)
    words = ["a", "The", "the", "ab1", "한글", "$$", "x-y", "Zebra", "longer-word", "é", "{}", "B"]
    texts = ["", " ", "\n\n", "one", "a\nb\na\n", "Aa aA AA", "\tx \x0b y\r\n"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts.append(" ".join(words * 300))
    got = quality.features(*buffer(texts))
    for row, text in zip(got, texts, strict=True):
        for name, value in statistics(text).items():
            assert math.isclose(row[quality.FEATURES.index(name)], value, rel_tol=1e-9, abs_tol=1e-9), (name, text[:60])
    assert set(quality.FEATURES) - set(statistics("")) == {"dup_chars_10"}
    # A row's statistics are its own, whatever stands beside it.
    assert np.allclose(quality.features(*buffer(texts[-1:])), got[-1:])


def test_every_score_is_the_walk_through_the_trees(spark):
    folder = str(DATA / "sf0.001")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r for r in op5_quality_classifier(spark, folder).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    x = quality.features(*buffer([r.text or "" for r in rows]))
    for r, row in zip(rows, x, strict=True):
        raw = model.prior
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            raw += model.value[t, node - (2**model.depth - 1)]
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-raw)), rel_tol=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def _where(store):
    """doc_id -> shard, as the files hold it."""
    from pyspark.sql import functions as F

    path = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"(shards/.*)$", 1)
    return {r.doc_id: r.path for r in store.read().select("doc_id", path.alias("path")).collect()}


def _runs(now, target, fan_in, growth):
    """Groups of shards to merge, by a plain reading of the rule."""
    tiers = {}
    for s in sorted(now, key=lambda s: (s.arrival, s.path)):
        tier, limit = 0, 1 << 16
        while s.bytes > limit:
            tier, limit = tier + 1, limit * growth
        if s.bytes < target:
            tiers.setdefault(tier, []).append(s)
    out = []
    for members in tiers.values():
        if len(members) >= fan_in:
            groups = [[]]
            for s in members:
                if groups[-1] and sum(x.bytes for x in groups[-1]) + s.bytes > target:
                    groups.append([])
                groups[-1].append(s)
            out += [frozenset(s.path for s in g) for g in groups if len(g) > 1]
    return set(out)


def test_rows_land_where_the_rule_puts_them_over_many_arrivals(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).select("doc_id", "text")
    store, target, fan_in, versions = shards.Store(spark, f"file://{tmp_path}/store"), 300_000, 3, 0
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    merged = 0
    for k in range(8):
        part = docs.where(docs.doc_id.isin(ids[k::8]))
        store.append(part.coalesce(1 + k % 2))
        versions += 1
        before, now = _where(store), store.shards()
        want = _runs(now, target, fan_in, shards.GROWTH)
        version = store.compact(target, fan_in)
        versions += bool(want)
        assert version == versions == store.version()
        after, left = _where(store), store.shards()
        together = {}
        for doc, path in after.items():
            together.setdefault(path, set()).add(before[doc])
        # Shards that were not merged stay as they are; each run is one new shard.
        assert {frozenset(v) for path, v in together.items() if v != {path}} == want
        assert {s.path: s.rows for s in left} == Counter(after.values()) and set(after) == set(before)
        old = {s.path: s for s in now}
        for s in left:
            if s.path not in old:
                assert s.merges == 1 + max(old[p].merges for p in together[s.path]) and s.arrival == min(old[p].arrival for p in together[s.path])
        merged += len(want)
    assert sorted(after) == ids and merged >= 2
