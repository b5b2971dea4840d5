"""Outlines, runs without repeats and composed edit logs against brute force."""

import random

from quillgrid.operators import editlogs, outline, sequences

LOOKS = {0: (False, "#000000"), 1: (True, "#ff0000"), 2: (False, "#ff0000"), 3: (True, "#ffffff"), 4: (True, None)}


def outline_by_force(last, tables, holds, units, styles, marks):
    """Sign by sign: (kind, text, bold, color, slot, option, start, end)."""
    pending = sorted(marks, key=lambda m: (m[0], m[1], m[2] or "", -1 if m[3] is None else m[3]))
    out, skip = [], -1

    def emit(pos):
        nonlocal skip
        while pending and pending[0][0] <= pos:
            s, e, slot, option = pending.pop(0)
            out.append(["slot", None, None, None, slot, option, s, e])
            skip = max(skip, e)

    for pos, end, text in sorted(units, key=lambda u: u[:2]):
        for i, c in enumerate(text if text is not None else "\t"):
            p = pos + i
            emit(p)
            if p < skip or (text is None and end <= pos):
                continue
            if text is None:
                out.append(["tab", "\t", False, None, None, None, pos, end])
                continue
            style = max((s for s in styles if s[0] <= p), default=(0, None))[1]
            bold, color = LOOKS.get(style, (False, None))
            color = color if color == "#ff0000" else None
            before = out[-1] if out else None
            if before and before[0] == "text" and before[7] == p and before[2] == bold and before[3] == color:
                before[1] += c
                before[7] = p + 1
            else:
                out.append(["text", c, bold, color, None, None, p, p + 1])
    emit(1 << 60)
    if not out and not tables and holds:
        out.append(["text", "", False, None, None, None, last, last])
    return [tuple(x) for x in out]


def test_outlines_against_signs(spark):
    rng = random.Random(7)
    given, units, styles, marks = [], [], [], []
    for k in range(150):
        at = 0
        for _ in range(rng.randrange(5)):
            if rng.random() < 0.3:
                at += 8 if rng.random() < 0.5 else 0  # something that shows nothing
            text = None if rng.random() < 0.25 else "".join(rng.choices("ab é\U0001f600", k=rng.randrange(9)))
            width = 8 if text is None else len(text)
            units.append((k, at, at + width, text))
            at += width
        places = rng.sample(range(40), rng.randrange(4)) if k % 7 else []
        styles += [(k, p, rng.choice([0, 1, 2, 3, 4, 9])) for p in places]
        for j in range(rng.randrange(4)):
            s = rng.randrange(at + 3)
            marks.append((k, s, s + rng.choice([0, 0, 1, 4, 9]), f"s{j}", rng.choice([None, 1])))
        given.append((k, at, rng.choice([0, None, 2]), rng.random() < 0.8))
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    looks = spark.createDataFrame([(s, *v) for s, v in LOOKS.items()], "style int, bold boolean, color string")
    got = outline.segments(df(given, "k int, last int, tables int, holds boolean"), df(units, "k int, pos int, end int, text string"), df(styles, "k int, pos int, style int"), looks, df(marks, "k int, start int, end int, slot string, option int"), ["k"]).collect()
    by_key = {k: [] for k, *_ in given}
    for r in sorted(got, key=lambda r: (r.k, r.ord)):
        assert r.ord == len(by_key[r.k])
        by_key[r.k].append(tuple(r)[2:])
    for k, last, tables, holds in given:
        of = lambda rows: [r[1:] for r in rows if r[0] == k]  # noqa: E731, B023
        assert by_key[k] == outline_by_force(last, tables, holds, of(units), of(styles), of(marks)), k


def test_restyled_ranges(spark):
    rng = random.Random(8)
    styles, ranges, want = [], [], {}
    for k in range(60):
        own = {p: rng.randrange(3) for p in rng.sample(range(30), rng.randrange(5))}
        cuts = sorted(rng.sample(range(32), 2 * rng.randrange(4)))
        mine = [(a, b, rng.randrange(5)) for a, b in zip(cuts[::2], cuts[1::2])] + [(9, 9, 4)]
        styles += [(k, p, s) for p, s in own.items()]
        ranges += [(k, *r) for r in mine]
        for p in range(40):
            base = max(((q, s) for q, s in own.items() if q <= p), default=(0, None))[1]
            want[k, p] = next((s for a, b, s in mine if a <= p < b), base)
    got = outline.restyled(spark.createDataFrame(styles, "k int, pos int, style int"), spark.createDataFrame(ranges, "k int, start int, end int, style int"), ["k"]).collect()
    for (k, p), style in want.items():
        assert max(((r.pos, r.style) for r in got if r.k == k and r.pos <= p), key=lambda x: x[0], default=(0, None))[1] == style
    for k in range(60):
        mine = sorted((r.pos, r.style) for r in got if r.k == k)
        assert all(a[1] != b[1] for a, b in zip(mine, mine[1:]))


def test_runs_without_repeats(spark):
    rng = random.Random(9)
    rows = [(k, i * 2, rng.choice("abcd") if k < 20 else rng.choice(["a", None])) for k in range(25) for i in range(rng.randrange(60))] + [(99, i, "x") for i in range(200)] + [(None, 1, "q"), (None, 2, "q")]
    df = spark.createDataFrame(rows, "k int, ord long, v string").repartition(3)
    got = {(r.k, r.ord): r.island for r in sequences.repeat_islands(df.where("k is not null"), ["k"], "ord", "v").collect()}
    for k in {r[0] for r in rows} - {None}:
        seen, island = set(), 1
        for _, at, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if v in seen:
                seen, island = set(), island + 1
            seen.add(v)
            assert got[k, at] == island
    assert len(got) == len(rows) - 2 and sequences.repeat_islands(df.limit(0), ["k"], "ord", "v").count() == 0


def test_composed_logs(spark):
    rng = random.Random(10)
    log, places = [], [(k, p, "t") for k in range(40) for p in range(-1, 45)]
    for k in range(38):
        for i in range(rng.randrange(30)):
            s = rng.randrange(40)
            log.append((k, i, s, s + rng.choice([0, 0, 1, 2, 6]), rng.randrange(6)))
    log += [(1, 50, None, 3, 3), (1, 51, 9, 4, 3)]
    df = spark.createDataFrame(log, "k int, ord int, start int, end int, length int").repartition(4)
    steps = editlogs.composed(df, ["k"], ["ord"])
    got = {(r.k, r.place): r.moved for r in editlogs.mapped(spark.createDataFrame(places, "k int, place long, by_text string"), steps, ["k"], "place").collect()}
    assert len(got) == len(places)
    for k, p, _ in places:
        at = p
        for _, _, s, e, n in sorted((x for x in log if x[0] == k), key=lambda x: x[1]):
            if None in (s, e) or e < s or at is None:
                continue
            at = at + n - (e - s) if at >= e else None if at > s else at
        assert got[k, p] == at, (k, p)
