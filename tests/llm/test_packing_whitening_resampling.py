"""Operators 11 to 13 against brute force, on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import packing, resampling, whitening
from quillgrid.llm.kernel import buffer_of
from quillgrid.llm.oracles import ORACLES
from quillgrid.llm.queries import TOKENIZERS, queries

from ..conftest import DATA
from .test_sql import rows as as_rows

FILE = f"{TOKENIZERS}/word_bpe_49k.json"
HARD = [
    None, "", " \t\n", "one", "One  TWO\x0bthree\x0cfour", "don't we'll it's §5 a§b § §§", "<|endoftext|>x<|endoftext|> y<|startoftext|", "é ́e ͏  x y z \x1c\x85 q", "İstanbul ΟΔΟΣ ΣΑΣ ǅ ﬁ",
    "한글 처리 \U0001f600\U0001f600 ‍…", "1234 5,6.7 -- !!! a.b,c", "word " * 30_000,
]
SCHEMA = "doc_id bigint, text string, ids string, row int, subject string, n string, weight int, rank int, _words int"


def table(spark, texts, parts=3):
    ids = [(None if i == 3 else 7 if i in (5, 6) else i) for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "x", 0, "y", "z", 1, 1, 1) for i, t in zip(ids, texts)], SCHEMA).repartition(parts)


# ---- 11 ---------------------------------------------------------------------------------


def test_ids_are_the_tokenizers_own():
    encode, rng = packing.Encoder(FILE, remembered=250, remembered_parts=100), random.Random(5)
    assert encode.by_words
    alphabet = list("abcXYZ019'.,;§<|> \t\n\r\x0b\x0c\x1c\x85 　éÉ́ßΣσς한가\U0001f600")
    texts = [t or "" for t in HARD] + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    for i in range(0, len(texts), 7):
        some = texts[i : i + 7]
        for t, got in zip(some, encode(*buffer_of(pa.array(some)))):
            assert np.frombuffer(got, encode.dtype).tolist() == encode.model.encode(t, add_special_tokens=False).ids, t


def test_tokenizers_that_keep_white_space_get_whole_texts():
    encode = packing.Encoder(f"{TOKENIZERS}/byte_bpe_50k.json")
    assert not encode.by_words
    for t in HARD[1:]:
        assert np.frombuffer(encode(*buffer_of(pa.array([t])))[0], encode.dtype).tolist() == encode.model.encode(t, add_special_tokens=False).ids


def windows_by_force(remainders, df, documents, average, window):
    """The greedy filling, with BM25 scores worked out from their definition for each pair."""
    idf = lambda t: max(0.0, math.log((documents - df[t] + 0.5) / (df[t] + 0.5)))
    counts = [Counter(r) for r in remainders]

    def score(seed, other):
        norm = packing.K1 * (1 - packing.B + packing.B * len(remainders[other]) / average)
        return sum(idf(t) * counts[other][t] * (packing.K1 + 1) / (counts[other][t] + norm) for t in counts[seed] if t in counts[other])

    unused, out, rest = list(range(len(remainders))), [], None
    while unused or rest:
        seed, start = rest or (unused[0], 0)
        if seed in unused:
            unused.remove(seed)
        row, rest = [(seed, start, len(remainders[seed]) - start)], None
        room = window - row[0][2]
        scores = {i: score(seed, i) for i in unused}
        for i in sorted(unused, key=lambda i: (-scores[i], i)):
            if not room:
                break
            unused.remove(i)
            took = min(room, len(remainders[i]))
            row.append((i, 0, took))
            room -= took
            if not room and took < len(remainders[i]):
                rest = (i, took)
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_against_brute_force(seed):
    rng = random.Random(seed)
    remainders = [np.array(rng.choices(range(5, 60), weights=range(1, 56), k=rng.randrange(1, 30)) + [1], np.uint16) for _ in range(120)]
    df = Counter(t for r in remainders for t in set(r.tolist()))
    counts = np.array([df[t] for t in range(61)])
    average = sum(map(len, remainders)) / len(remainders)
    got = list(packing.fill_windows(remainders, packing.idf_of(counts, len(remainders)), average, 64))
    want = windows_by_force([r.tolist() for r in remainders], df, len(remainders), average, 64)
    full = [row for row in got if sum(x[2] for x in row) == 64]
    assert full == [row for row in want if sum(x[2] for x in row) == 64] and full
    tail = [x for row in got[len(full) :] for x in row]
    assert sum(x[2] for x in tail) == sum(x[2] for row in want[len(full) :] for x in row)
    assert all((n := sum(x[2] for x in row)) & (n - 1) == 0 for row in got)


def check_pieces(pieces, texts, window):
    """Every id of every row in one piece; sequences gapless, full or as long as a power of two."""
    model = packing.Encoder(FILE).model
    want = Counter()
    for doc_id, text in texts:
        want[(doc_id, tuple(model.encode(text or "", add_special_tokens=False).ids + [1]))] += 1
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length, p.sequence_tokens))
        by_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
    for s in sequences.values():
        at = 0
        for offset, length, total in sorted(s):
            assert offset == at
            at += length
        assert at == total <= window and (total == window or total & (total - 1) == 0)
    for doc_id, parts in by_doc.items():
        rows = [list(ids) for (d, ids), n in want.items() if d == doc_id for _ in range(n)]
        assert sum(len(ids) for _, ids, _ in parts) == sum(map(len, rows))
        if len(rows) == 1:
            assert [x for _, ids, _ in sorted(parts) for x in ids] == rows[0] and {n for *_, n in parts} == {len(rows[0])}
        else:
            assert Counter(x for _, ids, _ in parts for x in ids) == Counter(x for r in rows for x in r)
    assert set(by_doc) == {d for d, _ in want}


@pytest.mark.parametrize("window, shard_tokens, shard_docs", [(2048, 1 << 19, 1 << 13), (64, 256, 5), (1, 1, 1)])
def test_pieces_of_hard_texts(spark, window, shard_tokens, shard_docs):
    texts = [t and t[:3000] for t in HARD] + ["a b c"] * 3
    docs = table(spark, texts)
    got = packing.pack(docs, FILE, window=window, shard_tokens=shard_tokens, shard_docs=shard_docs, partition_tokens=500).collect()
    check_pieces(got, [(r.doc_id, r.text) for r in docs.collect()], window)


def test_pieces_of_a_corpus_and_their_neighbours(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet"))
    got = packing.pack(docs, FILE, window=512).collect()
    check_pieces(got, [(r.doc_id, r.text) for r in docs.collect()], 512)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    together = defaultdict(list)
    for p in got:
        together[p.sequence_id].append(lang[p.doc_id])
    pairs = [(a, b) for x in together.values() for a, b in zip(x, x[1:])]
    by_chance = sum((n / len(lang)) ** 2 for n in Counter(lang.values()).values())
    assert sum(a == b for a, b in pairs) / len(pairs) > 1.5 * by_chance


def test_packing_of_nothing(spark):
    assert packing.pack(table(spark, ["a"]).limit(0), FILE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table(spark, ["a"]), FILE, window=0)


def test_packing_query(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet"))
    model = packing.Encoder(FILE).model
    ids = {r.doc_id: np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in docs.collect()}
    for p in queries()["op11_retrieval_packing"](spark, str(DATA / "sf0.001")).collect():
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])


# ---- 12 ---------------------------------------------------------------------------------


def force(vectors, most=32):
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), [int(a) for a in x.sum(axis=0)]
    d = n * x - np.array(s, dtype=object)
    z = (d / n).astype(float)
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    return [i for i, _ in kept], n, [int(r) for r in (d * d).sum(axis=1)], z, v, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("dims, tile", [(5, 2), (40, 32), (70, 32), (3, 32)])
def test_whitening_against_brute_force(spark, dims, tile, monkeypatch):
    monkeypatch.setattr(whitening, "HELD", 100)
    monkeypatch.setattr(whitening, "BLOCK", 8 * dims * 7)
    rng = np.random.default_rng(dims)
    data = (rng.normal(size=(150, dims)) @ rng.normal(size=(dims, dims))).astype(np.float32)
    vectors = [(i, v) for i, v in enumerate(data.tolist())]
    vectors += [(900, None), (901, []), (902, [None] + [0.0] * (dims - 1)), (903, [float("nan")] + [0.0] * (dims - 1)), (904, [float("inf")] + [0.0] * (dims - 1)), (3, data[5].tolist()), (None, data[6].tolist())]
    df = spark.createDataFrame([(i, v, 0.0, 1) for i, v in vectors], "vec_id long, embedding array<float>, whitened double, x int").repartition(4)
    rows, w, error = whitening.whiten(df, tile=tile)
    got = rows.collect()
    ids, n, far, z, v, e, u = force(vectors)
    k = min(dims, 32)
    assert w.n == n == 152 and sorted(map(str, (r.vec_id for r in got))) == sorted(map(str, ids))
    assert np.allclose(w.values, e[:k], rtol=1e-9) and np.allclose(w.explained, e[:k] / np.trace(v), rtol=1e-9)
    want = z @ (u[:, :k] / np.sqrt(e[:k]))
    sign = {}
    by_id = defaultdict(list)
    for i, a, b in zip(ids, far, want):
        by_id[i].append((a, b))
    for r in got:
        assert any(r.deviation == a and np.allclose(np.abs(r.whitened), np.abs(b), rtol=1e-6, atol=1e-6) for a, b in by_id[r.vec_id])
        if r.vec_id == 10:
            sign = np.sign(r.whitened) * np.sign(by_id[10][0][1])
    for r in got:
        assert any(np.allclose(np.array(r.whitened) * sign, b, rtol=1e-6, atol=1e-6) for _, b in by_id[r.vec_id])
    assert error < 1e-9


def test_whitening_of_few_and_degenerate_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows, w, _ = whitening.whiten(spark.createDataFrame([], schema))
    assert rows.count() == 0 and w.n == 0
    rows, w, _ = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema))
    assert [(r.deviation, r.whitened) for r in rows.collect()] == [(0, [])] and w.n == 1
    # Equal columns, a constant one and a vector of another length.
    rows, w, error = whitening.whiten(spark.createDataFrame([(i, [float(i % 7), float(i % 7), 3.0]) for i in range(50)] + [(99, [1.0])], schema), tile=2)
    assert len(w.values) == 1 and error < 1e-9 and rows.count() == 50
    # Far entries: exact deviations, null beyond a long.
    rows, w, _ = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema))
    assert w.n == 3 and {r.vec_id: r.deviation for r in rows.collect()}[1] is None
    (a, b), (c, d) = [float(1 << 24), 0.5], [-float(1 << 24), 1.5]
    rows, w, _ = whitening.whiten(spark.createDataFrame([(1, [a, b]), (2, [c, d])], schema))
    assert {r.deviation for r in rows.collect()} == {force([(1, [a, b]), (2, [c, d])])[2][0]}


def test_whitening_query(spark):
    folder = str(DATA / "sf0.001")
    got = queries()["op12_embedding_whitening"](spark, folder)
    source = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, n, far, z, v, e, u = force([(r.vec_id, r.embedding) for r in source])
    far_of = dict(zip(ids, far))
    rows = got.collect()
    k = max(r.component for r in rows)
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    for r in rows:
        assert r.deviation == far_of[r.vec_id] and abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-9 and r.identity_error < 1e-9
    of = {(r.vec_id, r.component): r.whitened for r in rows}
    w = np.array([[of[i, c + 1] for c in range(k)] for i in ids])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    assert np.allclose(np.abs(np.diag(w.T @ (z @ (u[:, :k] / np.sqrt(e[:k]))) / n)), 1, atol=1e-6)


# ---- 13 ---------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def resampled(docs, target, percent=25, least=20, buckets=10_000):
    def features(text):
        w = WORDS.findall((text or "").translate(FOLD))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return sorted(((i, n, f, w, s, rank.get(id(r))) for r in out for i, n, f, w, s in [r]), key=str)


def test_resampling_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 3)
    rng = random.Random(2)
    texts = HARD + [" ".join(rng.choices(["Alpha", "beta", "GAMMA", "delta42", "é", "x"], k=rng.randrange(45))) for _ in range(60)] + ["a b " * 15] * 3
    docs, target = table(spark, texts), [None, "", "beta beta gamma", "x é alpha"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((25, 20), (100, 0), (0, 20), (50, 1)):
        got = resampling.resample(docs, bench, percent=percent, least_words=least)
        got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
        assert got == resampled([(r.doc_id, r.text) for r in docs.collect()], target, percent, least)


def test_resampling_of_and_towards_nothing(spark):
    docs, none = table(spark, HARD), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    got = resampling.resample(docs, none, least_words=1).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == resampled([(r.doc_id, r.text) for r in docs.collect()], [], least=1)


def test_resampling_sql_on_hard_texts(spark, tmp_path):
    texts = HARD + [f"some words {i} " * 9 for i in range(20)]
    table(spark, texts).select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "words 3 some"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert as_rows(queries()["op13_importance_resampling"](spark, str(tmp_path)).toArrow()) == as_rows(con.sql(ORACLES["op13_importance_resampling"]).to_arrow_table())
