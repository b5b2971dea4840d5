"""The suffix tree of op4: every score against brute force over tuples of words, broadcast and joined."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgrid.llm import suffixtree as S


def rows_of():
    rng = np.random.default_rng(3)
    out = []
    for i in range(400):
        said = []
        for _ in range(int(rng.integers(1, 9))):
            said += [["red", "fox", "runs", "far"], ["blue", "fox", "sits", "still"], ["a", "dog"], ["the", "cat"]][rng.integers(4)] + [f"u{rng.integers(30)}"] * int(rng.random() < 0.4)
        out.append((i, " ".join(said)))
    odd = [(1000, "red fox runs far a dog"), (1001, "dog far a runs fox red"), (1002, None), (1003, "red fox sits still blue fox runs far"), (1004, " \n"), (1005, "never seen"), (1006, "the cat"), (1006, "the cat"), (None, "The CAT a dog")]
    return [*out, *odd]


class Tree:
    """The tree of all training rows, by the definitions in the module's docstring."""

    def __init__(self, rows):
        self.unigram = Counter()
        self.count = {d: Counter() for d in range(1, S.ORDER + 1)}
        self.total = {d: Counter() for d in range(1, S.ORDER + 1)}
        self.kept = {}
        for i, text in rows:
            if i is None or zlib.crc32(str(i).encode()) % 10:
                q = self.tokens(text)
                self.unigram.update(q[1:])
                for d in self.count:
                    for j in range(d, len(q)):
                        self.count[d][tuple(q[j - d : j]), q[j]] += 1
                        self.total[d][tuple(q[j - d : j])] += 1
        self.n, self.v = sum(self.unigram.values()), len(self.unigram)
        for d in self.count:
            self.kept |= dict(self.retained(d))

    @staticmethod
    def tokens(text):
        return ["<", *(text or "").lower().split(), ">"]

    def root(self, w):
        return (self.unigram[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, s, w):
        while s and s not in self.kept:
            s = s[1:]
        if not s:
            return self.root(w)
        f, own = self.kept[s]
        return (own.get(w, 0) + f * self.p(s[1:], w)) / self.total[len(s)][s]

    def retained(self, d):
        for s, t in list(self.total[d].items()):
            seen = {w: c for (x, w), c in self.count[d].items() if x == s}
            own = {w: c for w, c in seen.items() if t >= S.LEAST and c > 1 and c >= S.SHARE * t and c * math.log((c - 1) / (t * self.p(s[1:], w))) >= S.OWN}
            if own:
                f, others = t - sum(c - 1 for c in own.values()), t - sum(own.values())
                gain = sum(c * math.log((c - 2 + f * self.p(s[1:], w)) / ((t - 1) * self.p(s[1:], w))) for w, c in own.items())
                if gain + (others * math.log((f - 1) / (t - 1)) if others else 0) >= S.GAIN:
                    yield s, (f, {w: c - 1 for w, c in own.items()})

    def score(self, text):
        q = self.tokens(text)
        return sum(math.log10(self.p(tuple(q[max(j - S.ORDER, 0) : j]), q[j])) for j in range(1, len(q)))


@pytest.fixture(scope="module")
def tree():
    return Tree(rows_of())


def test_scores_are_those_of_brute_force(spark, tree):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, 1.0, 2, "x") for i, t in rows], "doc_id bigint, text string, base double, c int, h string").repartition(3)
    assert {len(s) for s in tree.kept} >= {1, 2}
    for kwargs in ({"words": 10, "pairs": 10}, {"words": 10, "held": 0}, {}):
        got = {}
        for r in S.score(docs, **kwargs).collect():
            got.setdefault(r.doc_id, []).append(r)
        assert sum(map(len, got.values())) == len(rows) and len(got[1006]) == 2
        for i, text in rows:
            for r in got[i]:
                q = tree.tokens(text)[1:]
                assert (r.n_tokens, r.n_known, r.train_tokens) == (len(q), sum(tree.unigram[w] > 0 for w in q), tree.n)
                assert math.isclose(r.base_score, sum(math.log10(tree.root(w)) for w in q), rel_tol=1e-9)
                assert math.isclose(r.score, tree.score(text), rel_tol=1e-9)
        assert got[1000][0].score > got[1001][0].score + 1  # the same words in another order
    held_out = [i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    assert sum(r.score - r.base_score for i in held_out for r in got[i]) > 0


def test_every_state_is_a_distribution(tree):
    words = [*tree.unigram, "unknown"]
    for s in [(), *tree.kept]:
        assert math.isclose(sum(tree.p(s, w) for w in words), 1, rel_tol=1e-9)


def test_no_training_rows_and_no_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = S.score(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert S.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pairs_as_bytes_are_summed_over_tasks():
    at, w, word = np.array([5, 1 << 40, 5, 7]), np.array([11, 12, 11, 13], np.uint64), np.array([2, -1, 2, -1])
    got = {}
    for batch in S.dealt(at, w, word, np.array([3, 1, 4, 2]), 4):
        for part, often, n, *data in zip(*(batch.column(i).to_pylist() for i in range(3)), *batch.columns[3:]):
            for a, s, c in zip(*(S.from_planes(x, n) for x in data)):
                got.setdefault((part, often, int(a), int(s)), []).append(int(c))
    assert {k[1:]: sorted(v) for k, v in got.items()} == {(True, 5, 2): [3, 4], (False, 1 << 40, 12): [1], (False, 7, 13): [2]}
    first, c = S.summed(np.array([9, 8, 9]), np.array([1, 2, 5]))
    assert list(c) == [2, 6] and list(first) == [1, 0]


def test_more_contexts_than_are_held_do_not_shuffle_every_token(spark):
    docs = spark.createDataFrame([(i, f"{t} n{i}") for i, (_, t) in enumerate(rows_of() * 10)], "doc_id bigint, text string").repartition(2)

    def shuffled(held):
        store = spark.sparkContext._jsc.sc().statusStore()
        total = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
        before = total()
        S.score(docs, held=held).write.format("noop").mode("overwrite").save()
        return total() - before

    assert shuffled(4) < 3 * shuffled(S.HELD)
