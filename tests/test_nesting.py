"""Pairs, trees, innermost holders and paths against brute force, where the pages of the tables do not reach."""

import random
import re

from pyspark.sql import functions as F

from quillgrid.operators import nesting as N


def test_pairs_with_stray_ends(spark):
    rng = random.Random(1)
    rows = [(k, i * 3, rng.choice(["(", ")", ")", "(", ".", None])) for k in range(30) for i in range(rng.randrange(40))]
    df = spark.createDataFrame(rows + [(None, 1, "("), (None, 5, ")")], "k int, at long, c string").repartition(3)
    got = {tuple(r) for r in N.pairs(df, ["k"], "at", F.col("c") == "(", F.col("c") == ")").collect()}
    want = {(None, 1, 5, 1)}
    for k in range(30):
        open_ = []
        for _, at, c in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if c == "(":
                open_.append(at)
            elif c == ")" and open_:
                want.add((k, open_[-1], at, len(open_)))
                open_.pop()
    assert got == want and len(want) > 50
    assert N.pairs(df.limit(0), ["k"], "at", F.col("c") == "(", F.col("c") == ")").count() == 0


def tree_by_force(html):
    """A stack over the tokens of one page."""
    stack, out, at = [], [], 0
    def end(where):  # noqa: E306
        node, name, parent, start = stack.pop()
        out.append((node, name, parent, start, where))

    for node, m in enumerate(re.finditer(r"<!--.*?-->|<[^<>]*>|[^<]+|<", html, re.S)):
        token, at = m[0], m.end()
        tag = re.fullmatch(r"<(/?)\s*([A-Za-z][\w:.-]*)(.*?)(/?)>", token, re.S | re.A) if token[0] == "<" and token[1:2] != "!" else None
        name = tag and tag[2].lower()
        if name not in N.TREE_TAGS or (name == "img" and "src=" not in token):
            continue
        if name != "br" and tag[1]:
            if any(x[1] == name for x in stack):
                while stack[-1][1] != name:
                    end(m.start())
                end(m.end())
            continue
        single = name in ("br", "img") or bool(tag[4])
        if name in ("td", "th", "li", "p") and not single and stack and stack[-1][1] == name:
            end(m.start())
        while name == "tr" and not single and stack and stack[-1][1] in ("td", "th", "tr"):
            end(m.start())
        parent = stack[-1][0] if stack else None
        if single:
            out.append((node, name, parent, m.start(), m.end()))
        else:
            stack.append((node, name, parent, m.start()))
    while stack:
        end(at)
    return out


def test_trees_of_crossed_and_unclosed_tags(spark):
    rng = random.Random(2)
    bits = ["<b>", "</b>", "<i>", "</i>", "<p>", "</p>", "<tr>", "<td>", "</td>", "</tr>", "<table>", "</table>", "<li>", "</UL>", "<ul>", "<br>", "</br>", "<br/>", "<div/>", "<img>", '<img src="x">', "<x>", "</x>", "a < b", "<", "é\U0001f600", "<!-- <b> -->", "<B class='q'\n>", "< p>", "<p:q>", ">"]
    pages = [(i, "".join(rng.choices(bits, k=rng.randrange(60)))) for i in range(150)] + [(900, None), (901, ""), (902, "no tag"), (903, "<i>1<b><i>2</b></i>"), (904, "<b>" * 3000 + "</b>" * 10)]
    df = spark.createDataFrame(pages, "page int, html string").repartition(4).withColumn("n", F.length("html"))
    got = N.markup_tree(N.markup_tokens(df, ["page", "n"], "html"), ["page"], "n")
    want = sorted((p, *e) for p, h in pages if h for e in tree_by_force(h))
    assert sorted((r.page, r.node, r.name, r.parent, r.start, r.end) for r in got.collect()) == sorted(want) and len(want) > 3000


def nested(rng, lo, hi, depth, out):
    """Intervals that nest, empty ones and equal ones among them."""
    at = lo
    while at < hi and depth < 6:
        a = at + rng.randrange(3)
        b = a + rng.randrange(0, hi - lo + 1)
        if b > hi or a > hi:
            break
        out.append((a, b))
        if rng.random() < 0.3:
            out.append((a, b))
        nested(rng, a, b, depth + 1, out)
        at = b + (b == a)


def test_innermost_and_leaves(spark):
    rng = random.Random(3)
    rows, asked = [], []
    for k in range(70):
        all_ = []
        nested(rng, 0, rng.randrange(2, 40), 0, all_)
        rng.shuffle(all_)
        for i, (a, b) in enumerate(all_):
            (rows if rng.random() < 0.6 else asked).append((k, i, a, b))
    schema = "k int, id long, start long, end long"
    x, y = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(asked, schema)
    def holds(o, q, equal):  # noqa: E306
        """Whether o holds q; equal ones by side, then id."""
        if o[0] != q[0]:
            return False
        if q[2] == q[3]:
            return o[2] <= q[2] < o[3] if o[2] < o[3] else False
        return o[2] <= q[2] and q[3] <= o[3] and (o[2:] != q[2:] or equal)

    got = {(r.k, r.id): (r.inside, r.depth) for r in N.innermost(y.withColumn("inside_text", F.lit("x")), x, ["k"]).collect()}
    assert len(got) == len(asked) > 60
    for q in asked:
        over = [o for o in rows if holds(o, q, True)]
        inner = max(over, key=lambda o: (o[2], -o[3], o[1]), default=None)
        assert got[q[0], q[1]] == (inner and inner[1], len(over)), q
    leaves = {(r.k, r.id) for r in N.holds_no_other(x, ["k"]).collect()}
    want = {(o[0], o[1]) for o in rows if not any(q is not o and holds(o, q, o[1] < q[1]) for q in rows)}
    assert leaves == want
    assert N.innermost(y, x.limit(0), ["k"]).where("inside is not null or depth <> 0").count() == 0
    assert N.innermost(y.limit(0), x, ["k"]).count() == 0 and N.holds_no_other(x.limit(0), ["k"]).count() == 0


def test_parents_of_a_long_key_and_none(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice([0, 1, 2, 3, 9, None]), "x") for i in range(5000)] + [(None, 0, 1, None), (None, 1, 2, "y")]
    df = spark.createDataFrame(rows, "k int, ord long, level int, parent_text string").repartition(3)
    got = {(r.k, r.ord): (r.parent, r.parent_text) for r in N.level_parents(df, ["k"], "ord", "level").collect()}
    open_ = []
    for k, i, level, text in rows[:5000]:
        while level is not None and open_ and open_[-1][1] >= level:
            open_.pop()
        assert got[k, i] == (open_[-1][0] if open_ and level is not None else None, text)
        if level is not None:
            open_.append((i, level))
    assert got[None, 1] == (0, "y") and N.level_parents(df.limit(0), ["k"], "ord", "level").count() == 0


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    rounds, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df, name: rounds.append(name) or write(df, name))
    n = 10_000
    chain = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = N.climbed(chain, ["k"], kind=F.col("node") % 1000 == 7).agg(F.sum("depth"), F.max("depth"), F.max("root"), F.sum("nearest")).first()
    assert tuple(got) == (n * (n - 1) // 2, n - 1, 0, sum((i - 8) // 1000 * 1000 + 7 for i in range(8, n)))
    assert len(rounds) < 20


def test_paths_of_random_trees_orphans_and_cycles(spark):
    rng = random.Random(6)
    rows = [(k, f"n{i}", None if i == 0 or rng.random() < 0.1 else f"n{rng.randrange(i)}") for k in range(6) for i in range(40)]
    rows += [(7, "a", "gone"), (7, "b", "a"), (8, "x", "y"), (8, "y", "x"), (8, "z", "y"), (9, "s", "s")]
    df = spark.createDataFrame(rows, "k int, node string, parent string").repartition(3)
    got = {(r.k, r.node): r for r in N.climbed(df, ["k"], kind=F.col("node").endswith("3"), paths=True).collect()}
    of = {(k, n): p for k, n, p in rows}
    assert len(got) == len(rows)
    for k, n, _ in rows:
        way, at = [n], of[k, n]
        while (k, at) in of and len(way) < 100:
            way.append(at)
            at = of[k, at]
        r = got[k, n]
        if len(way) == 100:
            assert (r.depth, r.root, r.nearest, r.path) == (None, None, None, None)
        else:
            assert (r.depth, r.root, r.path) == (len(way) - 1, way[-1], way[::-1]) and r.nearest == next((x for x in way[1:] if x.endswith("3")), None)
    assert N.climbed(df.limit(0), ["k"], paths=True).count() == 0


def test_keys_of_few_rows_are_climbed_within_tasks_as_by_joins(spark, monkeypatch):
    """Small keys take one write and no join; nulls, repeated nodes, cycles and keys over several batches come out as by joins."""
    rng = random.Random(7)
    rows = [(k, i, rng.choice([None, rng.randrange(i + 1), rng.randrange(40)]), rng.choice([True, False, None]), f"t{i}") for k in range(60) for i in range(rng.randrange(1, 25))]
    odd = [(None, 1, None, True, "null key"), (None, 2, 1, True, "null key"), (90, None, 1, True, "null node"), (90, 1, None, True, "beside it"), (91, 5, None, True, "twice"), (91, 5, None, False, "twice"), (91, 6, 5, None, "under two"), (92, 1, 1, True, "own parent")]
    long = [(95, i, i - 1 if i else None, i % 7 == 3, "chain") for i in range(70)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rounds, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df, name: rounds.append(name) or write(df, name))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        df = spark.createDataFrame(rows + odd + long, "k int, node long, parent long, kind boolean, t string").repartition(3)
        told = lambda **how: sorted(repr(tuple(r)) for r in N.climbed(df, ["k"], kind=F.col("kind"), paths=True, **how).collect())
        by_joins = told(together=0)
        for together in (1, 5, 24, 69, 70, 1024):
            assert told(together=together) == by_joins, together
        rounds.clear()
        got = N.climbed(df.where("k < 60"), ["k"], kind=F.col("kind"), paths=True)
        assert got.count() == len(rows) and rounds == ["climbed"]
        text = spark.createDataFrame([("a", "x", None), ("a", "y", "x"), ("b", "y", "x")], "k string, node string, parent string")
        assert sorted((r.k, r.node, r.depth, r.root) for r in N.climbed(text, ["k"]).collect()) == [("a", "x", 0, "x"), ("a", "y", 1, "x"), ("b", "y", 0, "y")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_parents_of_levels_over_many_batches(spark):
    rng = random.Random(8)
    rows = [(k, str(k % 3), i, rng.choice([0, 1, 2, 3, 4, 50, None])) for k in range(40) for i in range(rng.randrange(60))]
    rows += [(77, None, i, i // 2) for i in range(50)] + [(77, "x", i, -i) for i in range(50)] + [(78, None, i, None) for i in range(30)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = {(r.a, r.b, r.n): r.parent for r in N.level_parents(spark.createDataFrame(rows, "a int, b string, n long, level int").repartition(4), ["a", "b"], "n", "level").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows) > 1000
    for a, b, n, level in rows:
        before = [m for x, y, m, up in rows if (x, y) == (a, b) and m < n and up is not None and level is not None and up < level]
        assert got[a, b, n] == max(before, default=None), (a, b, n)
