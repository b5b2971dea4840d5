"""Notices over several lines, without their openings, and scattered words, against brute force over runs."""

import re
import textwrap

from quillgrid.llm import licenses as L

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_force(text):
    w = PLAIN.findall((text or "").lower())
    out = {}
    for label, t in L.TEMPLATES.items():
        n = PLAIN.findall(t.lower())
        own, size = set(n), L.span(len(n), L.THRESHOLD)
        best = max((len(own & set(w[j : j + size])) for j in range(len(w))), default=0)
        if best >= L.needed(len(own), L.THRESHOLD):
            out[label] = best / len(own)
    return out


def test_notices_across_lines(spark):
    wrapped = {k: "code\n\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 72)) + "\n\nmore" for k, t in L.TEMPLATES.items()}
    rows = list(enumerate(wrapped.values()))
    scattered = " ".join(f"{w} " + "filler " * 40 for w in PLAIN.findall(L.TEMPLATES["mit-grant"]))
    rows += [(100, scattered), (101, None), (102, ""), (103, scattered + wrapped["bsd-source"]), (104, wrapped["mit-grant"].replace("free of charge", "")), (104, wrapped["mit-grant"].replace("free of charge", "")), (None, wrapped["gpl-copy"])]
    got = L.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        want = by_force(text[r.doc_id])
        assert set(r.labels.split(",")) - {""} - set(r.base_labels.split(",")) == set(want) - set(r.base_labels.split(","))
        assert r.score == (1.0 if r.n_base else max(want.values(), default=0.0))
    labels = {r.doc_id: r.labels.split(",") for r in got}
    assert all(k in labels[i] for i, k in enumerate(wrapped)) and "mit-grant" in labels[104] and "mit-grant" not in labels[100]
