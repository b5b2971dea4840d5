"""Registered queries of the work around fills: values written, pages as drawn, corpora, reports; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import fields as D
from quillgrid.functions import writing as W
from quillgrid.operators import corpus as C
from quillgrid.operators import layout as Y
from quillgrid.plans import reports as R
from quillgrid.plans.queries import query, table

# ---- values written -----------------------------------------------------------------------

@query("SELECT o_orderkey, 'A ' || k || repeat(' ', greatest(0, CAST(floor((4.0 - 1.0 - 0.55 * length(k)) / 0.5 + 0.5) AS INT))) || ' Z' AS text FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k FROM orders)")
def write_blank(spark, sf_dir):
    blank = F.concat(F.lit("A"), F.repeat(F.lit(" "), F.lit(8)), F.lit("Z"))
    parts = F.array(F.struct(F.lit(1).alias("start"), F.lit(9).alias("end"), F.lit("left").alias("align"), F.lit(None).cast("string").alias("prefix")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", blank.alias("t"), F.array(F.col("o_orderkey").cast("string")).alias("v"))
    return o.select("o_orderkey", W.apply_edits(F.col("t"), W.blank_edits(F.col("t"), parts, F.col("v"))).alias("text"))


@query("SELECT o_orderkey, CASE WHEN y[1:2] = '20' THEN y[3:] || '|' || m || '|' || d END AS parts, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM (SELECT *, year(o_orderdate)::VARCHAR AS y, month(o_orderdate)::VARCHAR AS m, day(o_orderdate)::VARCHAR AS d FROM orders)")
def date_into_parts(spark, sf_dir):
    part = lambda role, prefix=None: F.struct(F.lit(role).alias("role"), F.lit(prefix).cast("string").alias("prefix"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy. M. d.").alias("v"))
    values = W.part_values(F.lit("date"), F.array(part("year", "20"), part("month"), part("day")), F.col("v"))
    return o.select("o_orderkey", F.array_join(values, "|").alias("parts"), W.iso_date(F.col("v")).alias("iso"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'b' ELSE 'b, c' END AS written, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Y' END AS single, repeat(' ', greatest(0, CAST(floor((p_size % 7 * 0.5 - 0.602) / 0.5 + 0.5) AS INT)) // 2) || 'v' || repeat(' ', greatest(0, CAST(floor((p_size % 7 * 0.5 - 0.602) / 0.5 + 0.5) AS INT)) - greatest(0, CAST(floor((p_size % 7 * 0.5 - 0.602) / 0.5 + 0.5) AS INT)) // 2) AS mark, CASE WHEN p_size % 2 = 0 THEN 'CHECKED' ELSE 'UNCHECKED' END AS state, CASE WHEN p_size % 2 = 0 THEN p_partkey | 32768 ELSE p_partkey & ~32768 END AS flags FROM part")
def write_choice(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    option = lambda label, checked: F.struct(F.lit(label).alias("label"), F.lit(checked).alias("checked"))
    k, even = F.col("p_size") % 3, F.col("p_size") % 2 == 0
    picked = F.when(k == 0, F.array(F.lit("a"))).when(k == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    one = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("only")))
    return p.select(
        "p_partkey",
        W.choice_value(F.array(option("a", True), option("b", False), option("c", False)), picked).alias("written"),
        W.choice_value(F.array(option("only", False)), one).alias("single"),
        W.mark_text(F.col("p_size") % 7, F.lit("v")).alias("mark"),
        W.set_checked(F.when(even, "UNCHECKED").otherwise("CHECKED"), even).alias("state"),
        W.with_dirty(F.col("p_partkey"), even).alias("flags"),
    )


@query("SELECT doc_id, CASE WHEN length(text) >= 20 AND NOT regexp_matches(text[6:20], '[\\x00-\\x08\\x0b-\\x1f]') THEN text[6:20] END AS piece FROM documents")
def plain_range(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.plain_text(F.col("text"), F.lit(5), F.lit(20)).alias("piece"))


@query("SELECT event_id, CASE WHEN value >= 50 THEN event_type ELSE event_type || ';' || user_id END AS guide, CASE event_id % 32 WHEN 13 THEN 'char' WHEN 0 THEN 'char' WHEN 10 THEN 'char' WHEN 24 THEN 'char' WHEN 25 THEN 'char' WHEN 26 THEN 'char' WHEN 27 THEN 'char' WHEN 28 THEN 'char' WHEN 29 THEN 'char' WHEN 30 THEN 'char' WHEN 31 THEN 'char' WHEN 4 THEN 'inline' WHEN 5 THEN 'inline' WHEN 6 THEN 'inline' WHEN 7 THEN 'inline' WHEN 8 THEN 'inline' WHEN 9 THEN 'inline' WHEN 19 THEN 'inline' WHEN 20 THEN 'inline' ELSE 'extended' END AS kind, CASE WHEN event_id % 32 = 13 THEN 4 WHEN event_id % 32 = 2 THEN 4 ELSE 4 + (1::BIGINT << (event_id % 32)::INT) END AS mask, event_id % 2 = 0 AS splits FROM events")
def field_facts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t, code = F.col("event_type"), F.col("event_id") % 32
    counted = F.concat(F.lit("Clickhere:set:9:Direction:wstring:"), F.length(t).cast("string"), F.lit(":"), t, F.lit(" HelpState:wstring:0:"))
    parts = F.concat(t, F.lit("\\;"), F.col("user_id").cast("string"), F.lit(";help;"))
    units = F.array(F.lit(0xD83D), F.when(F.col("event_id") % 2 == 0, 0xDE00).otherwise(0x41))
    return e.select("event_id", D.guide_text(F.when(F.col("value") >= 50, counted).otherwise(parts)).alias("guide"), D.control_kind(code).alias("kind"), D.control_mask(F.array(code.cast("int"), F.lit(13), F.lit(2), F.lit(65), F.lit(2))).alias("mask"), D.splits_pair(units, F.lit(1)).alias("splits"))


@query("SELECT doc_id, source || '.' || lang AS name, (lang IN ('en', 'ko')) AND source LIKE '%e%' AS form FROM documents")
def form_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "source", "lang").alias("name"))
    return d.select("doc_id", "name", D.is_form(F.lit("첨부"), F.col("name"), "e", ("en", "ko")).alias("form"))


# ---- pages as drawn -----------------------------------------------------------------------

_RULES = "SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS kind, l_quantity * 4 AS \"at\", CAST(l_partkey % 100 AS DOUBLE) AS lo, l_partkey % 100 + l_quantity * 6 AS hi FROM lineitem"


def _rules(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("v").alias("kind"), (q * 4).alias("at"), (F.col("l_partkey") % 100).cast("double").alias("lo"), (F.col("l_partkey") % 100 + q * 6).alias("hi"))


@query(f"WITH r AS ({_RULES}) SELECT h.page, h.id AS h, v.id AS v FROM r h JOIN r v ON h.page = v.page AND h.kind = 'h' AND v.kind = 'v' AND v.\"at\" BETWEEN h.lo - 1.5 AND h.hi + 1.5 AND h.\"at\" BETWEEN v.lo - 1.5 AND v.hi + 1.5")
def rule_crossings(spark, sf_dir):
    r = _rules(spark, sf_dir)
    return Y.crossings(r.where("kind = 'h'"), r.where("kind = 'v'"), ["page"])


@query(f"WITH r AS ({_RULES}) SELECT page, count(*) FILTER (kind = 'h') AS n_across, min(CASE WHEN kind = 'h' THEN lo ELSE \"at\" END) AS \"left\", max(CASE WHEN kind = 'h' THEN hi ELSE \"at\" END) AS \"right\", min(CASE WHEN kind = 'v' THEN lo ELSE \"at\" END) AS top, max(CASE WHEN kind = 'v' THEN hi ELSE \"at\" END) AS bottom FROM r GROUP BY page HAVING count(*) FILTER (kind = 'h') >= 2 AND count(*) FILTER (kind = 'v') >= 1")
def rule_extents(spark, sf_dir):
    return Y.extents(_rules(spark, sf_dir), ["page"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 30 THEN 3 WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 12 THEN 1 ELSE 0 END AS place FROM lineitem")
def glyph_cells(spark, sf_dir):
    edges = F.array(*(F.lit(x) for x in (10.0, 12.0, 25.0, 30.0, 40.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", Y.grid_place(edges, F.col("l_quantity")).alias("place"))


@query("WITH RECURSIVE g AS (SELECT l_orderkey AS page, l_quantity AS y, l_partkey::DOUBLE AS x, 6.0::DOUBLE AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey) AS k FROM (SELECT DISTINCT l_orderkey, l_quantity, l_partkey FROM lineitem)), f AS (SELECT page, k, y, x, y AS anchor, 0 AS line FROM g WHERE k = 1 UNION ALL SELECT g.page, g.k, g.y, g.x, CASE WHEN abs(g.y - f.anchor) <= 0.45 * 6.0 THEN f.anchor ELSE g.y END, f.line + CASE WHEN abs(g.y - f.anchor) <= 0.45 * 6.0 THEN 0 ELSE 1 END FROM f JOIN g ON g.page = f.page AND g.k = f.k + 1) SELECT page, x, y, line FROM f")
def glyph_lines(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y"), F.col("l_partkey").cast("double").alias("x")).distinct()
    return Y.glyph_lines(g.withColumns({"size": F.lit(6.0), "c": F.lit("x")}), ["page"]).select("page", "x", "y", "line")


@query("WITH g AS (SELECT DISTINCT l_orderkey, l_partkey * 2.0 AS x0, l_partkey * 2.0 + 5.0 AS x1, chr(97 + (l_partkey % 26)::INT) AS c FROM lineitem), b AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY l_orderkey ORDER BY x0) AS gap FROM g) SELECT l_orderkey, string_agg(CASE WHEN gap > 1.8 * 10 THEN '    ' WHEN gap > 0.3 * 10 THEN ' ' ELSE '' END || c, '' ORDER BY x0) AS text FROM b GROUP BY l_orderkey")
def glyph_texts(spark, sf_dir):
    k = F.col("l_partkey")
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", (k * 2.0).alias("x0"), (k * 2.0 + 5.0).alias("x1"), F.char(97 + k % 26).alias("c")).distinct()
    return Y.line_texts(g.withColumn("size", F.lit(10.0)), ["l_orderkey"])


_BLOCKS = "SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'caption' WHEN 'signup' THEN 'text' ELSE 'table' END AS type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 2 AS page, (user_id + event_id % 2) % 3 * 2.0 AS edge FROM events"


def _blocks(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "purchase", "caption").when(t == "signup", "text").otherwise("table")
    page = F.floor(F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) / 2)
    edge = (F.col("user_id") + F.col("event_id") % 2) % 3 * 2.0
    return table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("type"), page.alias("page"), F.array(F.lit(0.0), edge.cast("double")).alias("cols"), t.alias("text"))


@query(f"WITH b AS (SELECT *, lag(type) OVER w AS t, lag(page) OVER w AS p, lag(edge) OVER w AS e FROM ({_BLOCKS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CAST(sum(CASE WHEN type = 'table' AND t = 'table' AND page = p + 1 AND abs(edge - e) <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS table_id FROM b")
def continued_tables(spark, sf_dir):
    return Y.continued_tables(_blocks(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", F.col("table_id").cast("bigint").alias("table_id"))


@query(f"SELECT user_id, event_id, CASE WHEN n = 'caption' THEN 'purchase' END AS caption FROM (SELECT *, lead(type) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({_BLOCKS})) WHERE type = 'table'")
def table_captions(spark, sf_dir):
    return Y.captions(_blocks(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", "caption")


@query("WITH c AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders), p AS (SELECT o_custkey, k // 3 AS r, k % 3 AS c, o_orderpriority AS v FROM c) SELECT a.o_custkey, a.r, a.c, 'right' AS side, a.v = b.v AS same FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.r = b.r AND b.c = a.c + 1 UNION ALL SELECT a.o_custkey, a.r, a.c, 'below', a.v = b.v FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.r = a.r + 1 AND b.c = a.c")
def grid_neighbours(spark, sf_dir):
    return Y.neighbours(_grid(spark, sf_dir), ["o_custkey"], "text")


def _grid(spark, sf_dir):
    k = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint")
    o = table(spark, sf_dir, "orders").select("o_custkey", k.alias("k"), F.col("o_orderpriority").alias("text"))
    return o.select("o_custkey", F.floor(F.col("k") / 3).alias("r"), (F.col("k") % 3).alias("c"), "text")


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), l AS (SELECT o_custkey, k // 3 AS r, max(least(3, n)) AS cols, '| ' || coalesce(max(t) FILTER (k % 3 = 0), '') || CASE WHEN max(n) > 1 THEN ' | ' || coalesce(max(t) FILTER (k % 3 = 1), '') ELSE '' END || CASE WHEN max(n) > 2 THEN ' | ' || coalesce(max(t) FILTER (k % 3 = 2), '') ELSE '' END || ' |' AS line, max(t) AS raw FROM c GROUP BY o_custkey, k // 3) SELECT o_custkey, CASE WHEN max(cols) = 1 THEN '> ' || max(raw) ELSE string_agg(CASE WHEN r = 0 THEN line || chr(10) || '|' || repeat('---|', cols::INT) ELSE line END, chr(10) ORDER BY r) END AS markdown FROM l GROUP BY o_custkey")
def markdown_tables(spark, sf_dir):
    g = _grid(spark, sf_dir).select("o_custkey", F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"), "text")
    return Y.markdown_tables(g, ["o_custkey"])


# ---- corpora ------------------------------------------------------------------------------

@query("WITH a AS (SELECT p_partkey, 'large' AS stratum FROM part WHERE p_size > 40 ORDER BY p_retailprice, p_partkey LIMIT 8), b AS (SELECT p_partkey, 'dear' AS stratum FROM part WHERE p_retailprice > 900 AND p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY p_retailprice, p_partkey LIMIT 5), c AS (SELECT p_partkey, 'rest' AS stratum FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a UNION ALL SELECT p_partkey FROM b) ORDER BY p_retailprice, p_partkey LIMIT 7) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def strata_in_turn(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return C.first_strata(p, [("large", F.col("p_size") > 40, 8), ("dear", F.col("p_retailprice") > 900, 5), ("rest", F.lit(True), 7)], "p_partkey", ["p_retailprice", "p_partkey"])


_DRAWN = {"Brand#12": (12, 2), "Brand#34": (40, 3), "Brand#21": (25, 1)}


@query(
    f"""WITH RECURSIVE target(value, quota, cap, t) AS (VALUES {", ".join(f"('{v}', {q}, {c}, {i})" for i, (v, (q, c)) in enumerate(_DRAWN.items(), 1))}),
o AS (SELECT p_partkey, t, quota, cap, p_type || p_size % 3 AS org, regexp_replace(split_part(p_name, ' ', 1) || p_size % 9, '\\s+', '', 'g') AS title, p_size % 4 AS kw, row_number() OVER (PARTITION BY t, p_size % 4 ORDER BY md5('k' || p_partkey)) AS turn FROM part JOIN target ON p_brand = value),
l AS (SELECT *, row_number() OVER (ORDER BY t, turn, kw) AS i FROM o),
w(i, t, titles, orgs, n, taken) AS (
  SELECT CAST(0 AS BIGINT), 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, CAST(NULL AS BIGINT)
  UNION ALL
  SELECT i, t, CASE WHEN ok THEN list_append(titles, title) ELSE titles END, CASE WHEN ok THEN list_append(orgs, org) ELSE orgs END, n + ok::INT, CASE WHEN ok THEN p_partkey END FROM
    (SELECT l.i, l.t, l.title, l.org, l.p_partkey, w.titles, CASE WHEN w.t = l.t THEN w.orgs ELSE [] END AS orgs, CASE WHEN w.t = l.t THEN w.n ELSE 0 END AS n,
      NOT list_contains(w.titles, l.title) AND (w.t <> l.t OR len(list_filter(w.orgs, lambda x: x = l.org)) < l.cap) AND (w.t <> l.t OR w.n < l.quota) AS ok FROM w JOIN l ON l.i = w.i + 1))
SELECT p_brand, p_partkey FROM w JOIN part ON p_partkey = taken"""
)
def quota_sample(spark, sf_dir):
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), (F.col("p_size") % 9).cast("string"))
    p = table(spark, sf_dir, "part").withColumns({"kw": F.col("p_size") % 4, "title": name, "org": F.concat("p_type", (F.col("p_size") % 3).cast("string"))})
    h = F.md5(F.concat(F.lit("k"), F.col("p_partkey").cast("string")))
    return C.quota_sample(p, [(v, q, c) for v, (q, c) in _DRAWN.items()], "p_brand", "kw", "org", "title", h).select("p_brand", "p_partkey")


@query("SELECT page_id FROM pages ORDER BY md5('seed|' || page_id), page_id LIMIT 20")
def seeded_sample(spark, sf_dir):
    return C.seeded_sample(table(spark, sf_dir, "pages").select("page_id"), "page_id", "seed", 20)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 2) WHERE j <= 5")
def caps_in_turn(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return C.capped(o, [(["o_custkey", "o_orderpriority"], ["o_orderkey"], 2), (["o_custkey"], ["o_orderkey"], 5)]).select("o_custkey", "o_orderkey")


@query("SELECT doc_id, reused FROM documents d LEFT JOIN (SELECT sha256(text) AS s, min(doc_id) AS reused FROM documents WHERE source = (SELECT min(source) FROM documents) GROUP BY 1) e ON sha256(d.text) = e.s")
def content_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    first = d.join(d.agg(F.min("source").alias("source")), "source")
    return C.reuse(d.select("doc_id", "text"), first.select("text", F.col("doc_id").alias("old")), "text", "old").select("doc_id", "reused")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 200)")
def files_present(spark, sf_dir):
    return C.present(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("n_chars > 200"), "doc_id").select("doc_id", "quality")


@query("WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, n, a.o_orderkey AS \"left\", b.o_orderkey AS \"right\" FROM a JOIN b USING (o_custkey, n)")
def page_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.page_pairs(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"], ["o_orderkey"], "o_orderkey")


@query("SELECT 'form' || (page_id // 3) AS stem, CAST(count(*) AS BIGINT) AS n, string_agg(page_id % 3 + 1, ',' ORDER BY page_id) AS numbers FROM pages GROUP BY page_id // 3")
def page_index(spark, sf_dir):
    stem, n = F.concat(F.lit("form"), F.floor(F.col("page_id") / 3).cast("string")), (F.col("page_id") % 3 + 1).cast("string")
    shape = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("out/"), stem, F.lit(".jpg"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("out/"), stem, F.lit("_p"), n, F.lit(".jpeg"))).otherwise(F.concat(F.lit("out/"), stem, F.lit("/"), n, F.lit(".JPG")))
    got = C.page_index(table(spark, sf_dir, "pages").select(shape.alias("path")), "path")
    return got.select("stem", F.size("pages").cast("bigint").alias("n"), F.array_join(F.array_sort(F.map_keys("pages")).cast("array<string>"), ",").alias("numbers"))


@query("SELECT l_returnflag, count(*) FILTER (l_discount >= 0.05) AS passed, count(*) FILTER (NOT l_discount >= 0.05) AS failed, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem b WHERE b.l_returnflag = a.l_returnflag AND NOT b.l_discount >= 0.05 ORDER BY k LIMIT 5)) AS examples FROM lineitem a GROUP BY l_returnflag")
def tally_examples(spark, sf_dir):
    got = C.tally(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount") >= 0.05, "l_orderkey", 5)
    return got.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("SELECT user_id, CAST(sum(k) AS BIGINT) AS n, string_agg(event_type || ':' || k, ',' ORDER BY event_type) AS kinds FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) GROUP BY user_id")
def slot_counts(spark, sf_dir):
    return C.slot_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"), ["user_id"])


@query("WITH b AS (SELECT p_type, median(p_retailprice) AS base FROM part GROUP BY p_type), f AS (SELECT p_brand, p_type, count(*) AS n, median(p_retailprice) AS width, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY ALL) SELECT p_brand, p_type, n, width FROM f JOIN b USING (p_type) WHERE (n >= 3 OR (hi / lo - 1 <= 0.05 AND abs(width / base - 1) <= 0.15)) AND abs(width / base - 1) >= 0.02")
def face_widths(spark, sf_dir):
    return C.face_widths(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_retailprice").select("p_brand", "p_type", "n", "width")


@query("WITH p AS (SELECT e.vec_id, s, list_transform(range(greatest(1, 1 - s), greatest(1, 1 - s) + 64 - abs(s)), lambda i: e.embedding[i]::DOUBLE) AS x, list_transform(range(greatest(1, 1 + s), greatest(1, 1 + s) + 64 - abs(s)), lambda i: f.embedding[i]::DOUBLE) AS y FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1, range(-3, 4) AS t(s)), q AS (SELECT vec_id, s, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - list_avg(x)) * (y[i] - list_avg(y)))) / sqrt(list_sum(list_transform(x, lambda v: (v - list_avg(x)) ** 2)) * list_sum(list_transform(y, lambda v: (v - list_avg(y)) ** 2))), 9) AS score FROM p) SELECT vec_id, arg_max(s, score) AS shift, round(max(score), 6) AS score FROM q GROUP BY vec_id")
def best_shifts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return C.best_shift(pairs, "vec_id", "a", "b", 3).select("vec_id", F.col("shift").cast("bigint").alias("shift"), F.round("score", 6).alias("score"))


# ---- around a fill ------------------------------------------------------------------------

@query("SELECT c_custkey, n_nationkey AS form, c_name AS name, c_mktsegment AS segment, n_name AS place, 'fixed' AS set_value FROM customer, nation")
def records_on_forms(spark, sf_dir):
    m = lambda *kv: F.create_map(*(F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec_id"), m("name", F.col("c_name"), "segment", F.col("c_mktsegment"), "set", F.lit("own")).alias("rec"))
    screens = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("form_id"), m("place", F.col("n_name"), "segment", F.lit("screen")).alias("screen"))
    got = R.records_on_forms(R.with_values(records, {"set": "fixed"}), screens)
    return got.select(F.col("rec_id").alias("c_custkey"), F.col("form_id").alias("form"), F.col("rec")["name"].alias("name"), F.col("rec")["segment"].alias("segment"), F.col("rec")["place"].alias("place"), F.col("rec")["set"].alias("set_value"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS \"column\" FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def columns_uncovered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("column", F.col("o_custkey").cast("string"))
    return R.uncovered(o, o.where("o_totalprice > 250000"))


@query("SELECT user_id, event_type AS holder, max_value AS \"value\" FROM (SELECT user_id, event_type, min(value) AS max_value, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['signup', 'purchase', 'click'], event_type)) AS k FROM events WHERE event_type IN ('signup', 'purchase', 'click') GROUP BY user_id, event_type) WHERE k = 1")
def blank_holders(spark, sf_dir):
    return R.holders(table(spark, sf_dir, "events").withColumnRenamed("event_type", "holder"), ["user_id"], ["signup", "purchase", "click"]).select("user_id", "holder", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '+other' WHEN c_custkey % 3 = 1 THEN 'other' ELSE 'a, b' END AS offered FROM customer")
def options_by_name(spark, sf_dir):
    s, k = F.col("c_mktsegment"), F.col("c_custkey") % 3
    options = F.when(k == 0, F.array(s, F.lit("other"))).when(k == 1, F.array(s, F.lit("other"), F.lower(s))).otherwise(F.array(F.lit("a, b")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(R.addressable(options), "+").alias("offered"))


@query("SELECT user_id, event_type, \"text\" FROM (SELECT user_id, event_type, arg_max(CASE WHEN event_id % 3 = 0 THEN 'same' ELSE 'v' || event_id END, event_id) AS \"text\" FROM events GROUP BY ALL) WHERE \"text\" <> 'same'")
def edit_map(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "same").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return R.edit_map(table(spark, sf_dir, "events").withColumns({"original": F.lit("same"), "text": text}), ["user_id", "event_type"], "event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'form-' || o_orderkey || '-' || o_orderpriority || '_' ELSE 'form-' || o_orderkey || '-_' END AS name FROM orders")
def output_names(spark, sf_dir):
    record = F.create_map(F.lit("who"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.output_name("{form}-{row}-{who}{none}:", F.lit("form"), F.col("o_orderkey"), record).alias("name"))


@query("SELECT p_type AS form_id, p_partkey AS slot_ord, rtrim(p_brand || repeat(' ', (w - length(p_brand))::INT) || '  ' || p_name) AS line FROM part JOIN (SELECT p_type, least(36, max(length(p_brand))) AS w FROM part WHERE p_size > 5 GROUP BY p_type) USING (p_type) WHERE p_size > 5")
def slot_list(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("form_id"), F.col("p_partkey").alias("slot_ord"), F.col("p_brand").alias("key"), F.array(F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("")).alias("labels"))
    return R.slot_list(R.labelled(p))


@query("SELECT l_returnflag AS form_id, count(*) FILTER (l_linestatus = 'F') AS n_filled, count(*) FILTER (l_quantity > 49) AS n_unmatched, count(*) FILTER (l_tax > 0.07) AS n_ambiguous, count(*) FILTER (l_discount > 0.2) AS n_conflicts, count(*) FILTER (l_quantity > 49) + count(*) FILTER (l_tax > 0.07) + count(*) FILTER (l_discount > 0.2) = 0 AS clean FROM lineitem GROUP BY 1")
def fill_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "form_id")
    return R.fill_report(li.where("l_linestatus = 'F'"), li.where("l_quantity > 49"), li.where("l_tax > 0.07"), li.where("l_discount > 0.2"))


@query("SELECT o_custkey, string_agg(o_orderstatus || ': ' || o_orderpriority, chr(13) || chr(10) ORDER BY o_orderstatus || ': ' || o_orderpriority) || chr(13) || chr(10) AS log FROM orders GROUP BY o_custkey")
def problem_logs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("problem"))
    return R.problem_log(o, ["o_custkey"])


@query("SELECT c_nationkey, sha256(string_agg(c_name || chr(0) || c_mktsegment, '' ORDER BY c_name))[1:12] AS version FROM customer GROUP BY 1")
def build_stamp(spark, sf_dir):
    return R.stamp(table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("path"), F.col("c_mktsegment").alias("content")), ["c_nationkey"])


@query("SELECT user_id, s AS \"at\", event_id AS state FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) WHERE n IS NULL OR n - s >= 3600")
def settled_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("state"))
    return R.settled_states(e, ["user_id"], "at", "state", 3600)
