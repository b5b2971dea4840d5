"""Rows that share a doc_id with other texts, and JSON with numbers out of range: what no table shows."""

import json
import random

from quillgrid.llm import chat, neardup

A, B = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
SCHEMA = "doc_id long, text string"


def test_a_doc_id_with_two_texts_is_near_what_either_is_near(spark):
    for turn in range(3):
        given = [(1, A), (1, B), (2, A + " x"), (3, B + " y"), (4, None), (1, A)]
        random.Random(turn).shuffle(given)
        got = neardup.near_duplicates(spark.createDataFrame(given, SCHEMA).repartition(3), words_each=2).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]


def test_many_texts_under_one_doc_id_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", 3)
    rng = random.Random(8)
    base = [[f"w{j}x{i}" for i in range(30)] for j in range(4)]
    given = []
    for _ in range(120):
        j = rng.randrange(4)
        words = list(base[j])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(30)] = f"z{rng.randrange(50)}"
        given.append((rng.choice([5, rng.randrange(60), rng.randrange(60), rng.randrange(60)]) * 4 + j, " ".join(words[rng.randrange(3) :])))
    given += rng.choices(given, k=20)
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for _, t in given]
    least = [i for i, _ in given]
    while True:  # each row takes the least doc_id of what it is linked with, until none changes
        after = [min(least[j] for j in range(len(given)) if given[i][0] == given[j][0] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(len(given))]
        if after == least:
            break
        least = after
    got = neardup.near_duplicates(spark.createDataFrame(given, SCHEMA).repartition(4), words_each=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(s), c, i == c) for (i, _), s, c in zip(given, sets, least))
    assert len(set(least)) > 1


def test_numbers_out_of_range_and_empty_arguments(spark):
    schemas = {"f": {"type": "object"}, "g": {"type": "object", "required": ["x"]}}
    said = lambda *calls: json.dumps({"tool_calls": calls})
    turns = [
        (1, 1, "tool", '{"tool_call_id":"a","content":1e999}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":-1e400}}]}'),
        (1, 3, "assistant", said({"id": "b", "name": "f", "arguments": "{}"}, {"id": "c", "name": "g", "arguments": "{}"}, {"id": "d", "name": "f", "arguments": "{oops"}, {"id": "e", "name": "f", "arguments": '{"x": 1e999}'})),
        (1, 4, "assistant", "{" * 3000),
        (1, 5, None, None),
        (2, 1, "assistant", '{"tool_calls":' + "[" * 100_000 + "]" * 100_000 + "}"),
    ]
    got = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(2), schemas).collect()
    kinds = {(r.conv_id, r.turn, r.ord): (r.kind, r.problems) for r in got}
    assert {k: v[0] for k, v in kinds.items() if k[2] == 0} == {(1, t, 0): "message" for t in range(1, 6)} | {(2, 1, 0): "message"}
    assert [kinds[1, 3, i][1] for i in range(1, 5)] == [["no_result"], ["bad_arguments", "no_result"], ["bad_arguments", "no_result"], ["bad_arguments", "no_result"]]
    assert json.loads(next(r.json for r in got if r.call_id == "b"))["arguments"] == {}
