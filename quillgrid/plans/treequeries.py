"""Registered queries over what nests: pairs of tags, trees of elements, paths, innermost holders; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.operators import editlogs as L
from quillgrid.operators import nesting as N
from quillgrid.operators import outline as O
from quillgrid.operators import sequences as S
from quillgrid.plans.queries import query, table
from quillgrid.streaming import sessions

_TAGS = ", ".join(f"'{t}'" for t in N.TREE_TAGS)
_TAG = r"(?s)^<(/?)\s*([A-Za-z][\w:.-]*)(.*?)(/?)>$"
#: Tokens of pages as ``markup_tokens`` gives them.
_TOKENS = rf"""
p AS (SELECT page_id, length(html) AS n_chars, regexp_extract_all(html, '(?s)<!--.*?-->|<[^<>]*>|[^<]+|<') AS t FROM pages),
every AS (SELECT page_id, n_chars, unnest(t) AS token, unnest(range(len(t))) AS node FROM p),
placed AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY page_id ORDER BY node) AS BIGINT) AS stop FROM every),
tag AS (SELECT *, lower(regexp_extract(token, '{_TAG}', 2)) AS name, regexp_extract(token, '{_TAG}', 1) = '/' AS closing, regexp_extract(token, '{_TAG}', 4) = '/' AS slash FROM placed WHERE token[1] = '<' AND token[2] <> '!'),
token AS (SELECT page_id, n_chars, CAST(node AS BIGINT) AS node, name, stop - length(token) AS start, stop, row_number() OVER (PARTITION BY page_id ORDER BY node) AS i,
  CASE WHEN name = 'br' THEN 'single' WHEN closing THEN 'close' WHEN slash OR name = 'img' THEN 'single' ELSE 'open' END AS what
  FROM tag WHERE name IN ({_TAGS}) AND (name <> 'img' OR contains(token, 'src=')))"""
#: Elements of pages, by a stack that is carried from token to token; state: open elements; outs: elements that the token ended.
_TREE = f"""{_TOKENS},
walk(page_id, i, state, outs, n_chars) AS (
  SELECT DISTINCT page_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(node BIGINT, name VARCHAR, parent BIGINT, start BIGINT)[]), CAST([] AS STRUCT(node BIGINT, name VARCHAR, parent BIGINT, start BIGINT, "end" BIGINT)[]), n_chars FROM token
  UNION ALL
  SELECT page_id, i,
    CASE WHEN what = 'open' THEN list_append(state[1:k], {{'node': node, 'name': name, 'parent': CASE WHEN k > 0 THEN state[k].node END, 'start': start}}) ELSE state[1:k] END,
    CASE WHEN what = 'single' THEN [{{'node': node, 'name': name, 'parent': CASE WHEN k > 0 THEN state[k].node END, 'start': start, 'end': stop}}]
      ELSE list_transform(range(k + 1, len(state) + 1), lambda j: {{'node': state[j].node, 'name': state[j].name, 'parent': state[j].parent, 'start': state[j].start, 'end': CASE WHEN what = 'close' AND j = k + 1 THEN stop ELSE start END}}) END, n_chars
  FROM (SELECT walk.page_id, token.i, walk.state, token.node, token.name, token.what, token.start, token.stop, walk.n_chars,
      CASE WHEN what = 'close' THEN coalesce(list_max(list_filter(range(1, len(state) + 1), lambda j: state[j].name = token.name)) - 1, len(state))
        WHEN what = 'open' AND token.name IN ('td', 'th', 'li', 'p') AND len(state) > 0 AND state[len(state)].name = token.name THEN len(state) - 1
        WHEN what = 'open' AND token.name = 'tr' THEN coalesce(list_max(list_filter(range(1, len(state) + 1), lambda j: state[j].name NOT IN ('td', 'th', 'tr'))), 0)
        ELSE len(state) END AS k
    FROM walk JOIN token ON token.page_id = walk.page_id AND token.i = walk.i + 1)),
last AS (SELECT page_id, arg_max(state, i) AS state, any_value(n_chars) AS n_chars FROM walk GROUP BY page_id),
element AS (SELECT page_id, o.node AS node, o.name AS name, o.parent AS parent, o.start AS start, o."end" AS "end" FROM (SELECT page_id, unnest(outs) AS o FROM walk)
  UNION ALL SELECT page_id, s.node, s.name, s.parent, s.start, n_chars FROM (SELECT page_id, n_chars, unnest(state) AS s FROM last))"""
_INLINE = "'a', 'b', 'strong', 'i', 'em', 'u', 'span', 'font', 'sub', 'sup', 'br', 'img'"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("bigint").alias("n_chars"), "html")
    return N.markup_tokens(pages, ["page_id", "n_chars"], "html")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.markup_tree(_tokens(spark, sf_dir), ["page_id"], "n_chars")


@query(
    f"""WITH RECURSIVE {_TOKENS},
m AS (SELECT page_id, name, node, what, row_number() OVER (PARTITION BY page_id, name ORDER BY node) AS i FROM token WHERE what <> 'single'),
walk(page_id, name, i, open, "begin", "end", depth) AS (
  SELECT DISTINCT page_id, name, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM m
  UNION ALL
  SELECT m.page_id, m.name, m.i, CASE WHEN what = 'open' THEN list_append(open, node) ELSE open[1:greatest(len(open) - 1, 0)] END,
    CASE WHEN what = 'close' AND len(open) > 0 THEN open[len(open)] END, CASE WHEN what = 'close' AND len(open) > 0 THEN node END, CASE WHEN what = 'close' AND len(open) > 0 THEN len(open) END
  FROM walk JOIN m ON m.page_id = walk.page_id AND m.name = walk.name AND m.i = walk.i + 1)
SELECT page_id, name, "begin", "end", CAST(depth AS BIGINT) AS depth FROM walk WHERE "end" IS NOT NULL"""
)
def tag_pairs(spark, sf_dir):
    """Begin and end tags of each name on each page, paired by prefix sums."""
    t = _tokens(spark, sf_dir).where("what <> 'single'")
    return N.pairs(t, ["page_id", "name"], "node", F.col("what") == "open", F.col("what") == "close")


@query(f'WITH RECURSIVE {_TREE} SELECT page_id, node, name, parent, start, "end" FROM element')
def html_tree(spark, sf_dir):
    """Elements of pages with their parents and extents, implied ends and crossed tags settled."""
    return _elements(spark, sf_dir)


@query(f"WITH RECURSIVE {_TREE} SELECT a.page_id, a.node, a.name, (SELECT arg_max(b.node, b.start) FROM element b WHERE b.page_id = a.page_id AND b.name NOT IN ({_INLINE}) AND b.start <= a.start AND b.\"end\" >= a.\"end\") AS inside, (SELECT count(*) FROM element b WHERE b.page_id = a.page_id AND b.name NOT IN ({_INLINE}) AND b.start <= a.start AND b.\"end\" >= a.\"end\") AS depth FROM element a WHERE a.name IN ({_INLINE})")
def block_of_inline(spark, sf_dir):
    """The innermost block that holds each inline element, and how many blocks do."""
    e = _elements(spark, sf_dir)
    inline = F.col("name").isin(*(t.strip("' ") for t in _INLINE.split(",")))
    got = N.innermost(e.where(inline), e.where(~inline), ["page_id"], "node", "start", "end")
    return got.select("page_id", "node", "name", "inside", F.coalesce("depth", F.lit(0)).alias("depth"))


@query(f'WITH RECURSIVE {_TREE} SELECT page_id, node, name, start, "end" FROM element a WHERE NOT EXISTS (SELECT 1 FROM element b WHERE b.page_id = a.page_id AND b.node <> a.node AND b.start >= a.start AND b."end" <= a."end")')
def leaf_elements(spark, sf_dir):
    """Elements that hold no other one."""
    e = _elements(spark, sf_dir)
    return N.holds_no_other(e, ["page_id"], "node", "start", "end").select("page_id", "node", "name", "start", "end")


_LEVELS = "r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, CAST(l_quantity AS BIGINT) % 4 AS level FROM lineitem), t AS (SELECT a.l_orderkey, a.ord, a.level, (SELECT max(b.ord) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.ord < a.ord AND b.level < a.level) AS parent FROM r a)"


@query(
    f"""WITH RECURSIVE {_LEVELS},
w(l_orderkey, ord, depth, root, nearest, path) AS (
  SELECT l_orderkey, ord, CAST(0 AS BIGINT), ord, CAST(NULL AS BIGINT), CAST(ord AS VARCHAR) FROM t WHERE parent IS NULL
  UNION ALL
  SELECT t.l_orderkey, t.ord, w.depth + 1, w.root, CASE WHEN p.level % 2 = 1 THEN p.ord ELSE w.nearest END, w.path || '/' || t.ord FROM w JOIN t ON t.l_orderkey = w.l_orderkey AND t.parent = w.ord JOIN t p ON p.l_orderkey = w.l_orderkey AND p.ord = w.ord)
SELECT * FROM w"""
)
def tree_paths(spark, sf_dir):
    """Depth, root, nearest ancestor of an odd level and path of each row of the level trees."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("bigint").alias("ord"), (F.col("l_quantity").cast("bigint") % 4).alias("level"))
    t = N.climbed(N.level_parents(li, ["l_orderkey"], "ord", "level"), ["l_orderkey"], "ord", "parent", F.col("level") % 2 == 1, paths=True, grouped=True)
    return t.select("l_orderkey", "ord", "depth", "root", "nearest", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


# ---- outlines, lists of boxes, composed edits ---------------------------------------------

#: Each document as a paragraph: its first 40 signs, a tab of 8 places, 40 more; three styles; blanks of 5, 0 and 9 places, the last one over the tab's end.
_PARAGRAPH = """
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, 0 AS pos, length(t[1:40]) AS "end", t[1:40] AS text FROM d UNION ALL SELECT doc_id, length(t[1:40]), length(t[1:40]) + 8, NULL FROM d WHERE length(t) > 40 UNION ALL SELECT doc_id, length(t[1:40]) + 8, length(t[1:40]) + 8 + length(t[41:80]), t[41:80] FROM d WHERE length(t) > 40),
s AS (SELECT DISTINCT doc_id, pos, max(style) OVER (PARTITION BY doc_id, pos) AS style FROM (SELECT doc_id, CAST(0 AS BIGINT) AS pos, doc_id % 4 AS style FROM d UNION ALL SELECT doc_id, doc_id % 23, (doc_id + 1) % 4 FROM d UNION ALL SELECT doc_id, 50 + doc_id % 11, (doc_id + doc_id % 2) % 4 FROM d)),
m AS (SELECT doc_id, doc_id % 31 AS start, doc_id % 31 + 5 AS "end", 'b' AS slot, NULL AS option FROM d WHERE t <> '' UNION ALL SELECT doc_id, doc_id % 17, doc_id % 17, 'z', 1 FROM d WHERE t <> '' UNION ALL SELECT doc_id, 43, 52, 'w', 2 FROM d WHERE doc_id % 3 = 0 AND length(t) > 40),
look(style, bold, color) AS (VALUES (0, false, '#000000'), (1, true, '#ff0000'), (2, false, '#ff0000'), (3, true, '#808080'))"""


@query(
    f"""WITH {_PARAGRAPH},
c AS (SELECT doc_id, pos + i AS p, text[i + 1] AS ch FROM (SELECT doc_id, pos, text, unnest(range(length(text))) AS i FROM u WHERE text IS NOT NULL)
  UNION ALL SELECT doc_id, pos, NULL FROM u WHERE text IS NULL),
v AS (SELECT c.*, look.bold, CASE WHEN look.color <> '#000000' THEN color END AS color, EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND m.start = c.p) AS begins
  FROM c JOIN LATERAL (SELECT arg_max(style, pos) AS style FROM s WHERE s.doc_id = c.doc_id AND s.pos <= c.p) q ON true LEFT JOIN look USING (style)
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND m.start <= c.p AND m."end" > c.p)),
n AS (SELECT *, CASE WHEN ch IS NULL OR lag(ch) OVER w IS NULL OR lag(p) OVER w <> p - 1 OR lag(bold) OVER w <> bold OR lag(color) OVER w IS DISTINCT FROM color OR begins THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM n),
part AS (SELECT doc_id, CASE WHEN max(ch) IS NULL THEN 'tab' ELSE 'text' END AS kind, CASE WHEN max(ch) IS NULL THEN chr(9) ELSE string_agg(ch, '' ORDER BY p) END AS text, CASE WHEN max(ch) IS NULL THEN false ELSE any_value(bold) END AS bold, CASE WHEN max(ch) IS NOT NULL THEN any_value(color) END AS color, NULL AS slot, NULL AS option, min(p) AS start, CASE WHEN max(ch) IS NULL THEN min(p) + 8 ELSE max(p) + 1 END AS "end", 1 AS rank FROM g GROUP BY doc_id, island
  UNION ALL SELECT doc_id, 'slot', NULL, NULL, NULL, slot, option, start, "end", 0 FROM m
  UNION ALL SELECT doc_id, 'text', '', false, NULL, NULL, NULL, 0, 0, 1 FROM d WHERE t = '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, rank, "end", slot) - 1 AS BIGINT) AS ord, kind, text, bold, color, slot, CAST(option AS INT) AS option, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM part"""
)
def outline_segments(spark, sf_dir):
    """Documents as paragraphs: their text by look, with blanks and tabs in place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    one, two = F.substring("t", 1, 40), F.substring("t", 41, 40)
    d = d.withColumns({"a": one, "b": two, "n": F.length(one).cast("bigint")})
    long = d.where(F.length("t") > 40)
    units = d.select("doc_id", F.lit(0).cast("bigint").alias("pos"), F.col("n").alias("end"), F.col("a").alias("text"))
    units = units.unionByName(long.select("doc_id", F.col("n").alias("pos"), (F.col("n") + 8).alias("end"), F.lit(None).cast("string").alias("text")))
    units = units.unionByName(long.select("doc_id", (F.col("n") + 8).alias("pos"), (F.col("n") + 8 + F.length("b")).alias("end"), F.col("b").alias("text")))
    k = F.col("doc_id")
    style = lambda pos, s: F.struct(pos.cast("bigint").alias("pos"), s.cast("int").alias("style"))
    styles = d.select("doc_id", F.inline(F.array(style(F.lit(0), k % 4), style(k % 23, (k + 1) % 4), style(50 + k % 11, (k + k % 2) % 4))))
    mark = lambda start, end, slot, option: F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(slot).alias("slot"), F.lit(option).cast("int").alias("option"))
    marks = d.where("t <> ''").select("doc_id", F.inline(F.array(mark(k % 31, k % 31 + 5, "b", None), mark(k % 17, k % 17, "z", 1))))
    marks = marks.unionByName(long.where("doc_id % 3 = 0").select("doc_id", F.inline(F.array(mark(F.lit(43), F.lit(52), "w", 2)))))
    looks = spark.createDataFrame([(0, False, "#000000"), (1, True, "#ff0000"), (2, False, "#ff0000"), (3, True, "#808080")], "style int, bold boolean, color string")
    paragraphs = d.select("doc_id", F.lit(0).alias("last"), F.lit(0).alias("tables"), F.lit(True).alias("holds"))
    return O.segments(paragraphs, units, styles, F.broadcast(looks), marks, ["doc_id"])


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w(user_id, i, seen, island, event_id) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(1 AS BIGINT), CAST(NULL AS BIGINT) FROM e
  UNION ALL
  SELECT e.user_id, e.i, CASE WHEN list_contains(seen, event_type) THEN [event_type] ELSE list_append(seen, event_type) END, CASE WHEN list_contains(seen, event_type) THEN island + 1 ELSE island END, e.event_id FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, island FROM w WHERE i > 0"""
)
def repeat_islands(spark, sf_dir):
    """Runs of each user's events that end before a type the run already has."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return S.repeat_islands(e, ["user_id"], "event_id", "event_type").select("user_id", "event_id", "island")


@query(
    """WITH RECURSIVE l AS (SELECT user_id, event_id % 40 AS s, event_id % 40 + event_id % 4 AS e, event_id % 6 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w(user_id, place, i, moved) AS (
  SELECT user_id, place, CAST(0 AS BIGINT), place FROM (SELECT DISTINCT user_id FROM events), range(0, 60, 7) r(place)
  UNION ALL
  SELECT w.user_id, w.place, l.i, CASE WHEN moved >= e THEN moved + n - (e - s) WHEN moved > s THEN NULL ELSE moved END FROM w JOIN l ON l.user_id = w.user_id AND l.i = w.i + 1)
SELECT user_id, place, arg_max(coalesce(moved, -1), i) AS moved FROM w GROUP BY user_id, place"""
)
def edit_map(spark, sf_dir):
    """Places of each user's text after all edits of a log made of their events; -1 where an edit took them away."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 40).alias("start"), (F.col("event_id") % 40 + F.col("event_id") % 4).alias("end"), (F.col("event_id") % 6).alias("length"))
    places = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(56), F.lit(7))).cast("bigint").alias("place"))
    return L.mapped(places, L.composed(e, ["user_id"], ["event_id"]), ["user_id"], "place").select("user_id", "place", F.coalesce("moved", F.lit(-1)).alias("moved"))


@query(
    """WITH b AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM b)
SELECT user_id, epoch_us(min(ts)) AS since, epoch_us(max(ts)) AS "at", max({'ts': ts, 'e': event_id}).e AS state, count(*) AS n FROM i GROUP BY user_id, burst"""
)
def session_states(spark, sf_dir):
    """The last event of each burst of a user's events, two hours apart."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = sessions.session_states(e, ["user_id"], "ts", "event_id", "2 hours")
    return got.select("user_id", F.unix_micros("since").alias("since"), F.unix_micros("at").alias("at"), "state", "n")
