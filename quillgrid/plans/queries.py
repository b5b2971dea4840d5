"""Registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import labels as L
from quillgrid.functions.blanks import find_blanks
from quillgrid.functions.choices import find_choices
from quillgrid.functions.diff import diffs
from quillgrid.functions import text as T
from quillgrid.functions import values as V
from quillgrid.operators import corpus as C
from quillgrid.operators import groups as G
from quillgrid.operators import layout as Y
from quillgrid.operators import sequences as S
from quillgrid.plans import fill as P
from quillgrid.plans import golden as GOLDEN
from quillgrid.sources import records as R
from quillgrid.session import ship
from quillgrid.stages import shared_folder
from quillgrid.streaming import ingest as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---- filling forms ------------------------------------------------------------------------

SLOTS = [
    P.Slot("application", 1, "t1.r1c2", ("성명",), "성명"),
    P.Slot("application", 2, "t1.r2c2", ("주소",), "주소"),
    P.Slot("application", 3, "t1.r3c2", ("연락처",), "연락처"),
    P.Slot("application", 4, "t1.r4c2", ("대리인", "성명"), "대리인.성명"),
    P.Slot("application", 5, "t1.r5c2", ("등급",), "등급"),
    P.Slot("application", 6, "t1.r6c2", ("신청인", "생년월일"), "신청인.생년월일"),
    P.Slot("certificate", 1, "p3b1", ("이름",), "이름"),
    P.Slot("certificate", 2, "p4b1", ("소속기관",), "소속기관"),
    P.Slot("certificate", 3, "p5b1", ("학력", "기간"), "학력.기간"),
    P.Slot("certificate", 4, "p6b1", ("경력", "기간"), "경력.기간"),
    P.Slot("certificate", 5, "p7b1", ("전화번호",), "전화번호"),
    P.Slot("certificate", 6, "p7b2", ("전화번호",), "전화번호#2", 2),
    P.Slot("power", 1, "f1", ("위임인", "성명"), "위임인.성명", 1, "위임하는 사람"),
    P.Slot("power", 2, "f2", ("이메일",), "이메일"),
]
COLUMNS = {"성명": "c_name", "주 소:": "n_name", "전화": "lpad(cast(c_custkey as string), 9, '0')", "대리인(성명)": "concat('A-', cast(c_custkey as string))", "(이름)": "concat('B-', cast(c_custkey as string))", "직장": "case when c_custkey % 3 = 0 then '' else c_mktsegment end", "기간": "c_mktsegment", "생일": "cast(c_nationkey as string)", "전화번호2": "case when c_custkey % 2 = 0 then concat('02', cast(c_custkey as string)) end", "e-mail": "concat(lower(c_mktsegment), '@x')", "없는칸": "'x'", "성  명.": "concat('C-', cast(c_custkey as string))"}
_ALIAS_SQL = ", ".join(f"({g}, '{w}')" for g, ws in enumerate(L.ALIAS_GROUPS) for w in ws)
_NORM_SQL = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\s\x{{00a0}}\x{{3000}}]+', '', 'g'), '^[*※·•▪□■○●◦◎\-–—]+', ''), '[:：.。]+$', ''), '^[(（\[［<〈「『](.*)[)）\]］>〉」』]$', '\1'))"
_NAMES_SQL = ", ".join("('{}', {}, '{}', '{}', {}, '{}')".format(s.form_id, s.slot_ord, s.key, n, sc, q) for s in P.with_first_of_outer(SLOTS) for n, (sc, q) in P.slot_names(s).items())
_RECORDS_SQL = "SELECT c_custkey AS rec_id, i AS col_ord, col AS \"column\", v AS value FROM (" + " UNION ALL ".join(f"SELECT c_custkey, {i} AS i, '{c}' AS col, CAST({e.replace('cast(c_custkey as string)', 'c_custkey::VARCHAR').replace('as string', 'AS VARCHAR')} AS VARCHAR) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey" for i, (c, e) in enumerate(COLUMNS.items())) + ") WHERE v IS NOT NULL AND v <> ''"
_MATCH_SQL = f"""WITH rec AS ({_RECORDS_SQL}),
names(form_id, slot_ord, slot_key, name, score, qualifier) AS (VALUES {_NAMES_SQL}),
word(g, w) AS (SELECT g, {_NORM_SQL.format("w")} FROM (VALUES {_ALIAS_SQL}) AS t(g, w)),
alias AS (SELECT DISTINCT a.w AS word, b.w AS alias FROM word a JOIN word b USING (g) WHERE a.w <> b.w),
col AS (SELECT DISTINCT "column", {_NORM_SQL.format('"column"')} AS word FROM rec),
variant AS (SELECT "column", word AS name, 0 AS cost FROM col UNION ALL SELECT "column", alias, 5 FROM col JOIN alias USING (word)),
hit AS (SELECT form_id, "column", slot_ord, slot_key, score - cost AS score, qualifier,
  row_number() OVER (PARTITION BY form_id, "column", slot_ord ORDER BY score - cost DESC, cost, name) AS k FROM variant JOIN names USING (name)),
best AS (SELECT *, max(score) OVER (PARTITION BY form_id, "column") AS top FROM hit WHERE k = 1),
m AS (SELECT form_id, "column", slot_ord, slot_key, score, qualifier, (SELECT count(DISTINCT qualifier) FROM best b WHERE b.form_id = a.form_id AND b."column" = a."column" AND b.score = b.top) > 1 AS ambiguous FROM best a WHERE score = top),
want AS (SELECT form_id, rec_id, slot_ord, slot_key, rec."column", value, score, col_ord FROM rec JOIN m USING ("column") WHERE NOT ambiguous)
"""


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.long_records(wide, "c_custkey", COLUMNS)


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = customer_records(spark, sf_dir)
    return records, P.matches_of(records, P.names_table(spark, SLOTS))


@query(_MATCH_SQL + "SELECT form_id, rec_id, slot_key, \"column\", value, score FROM (SELECT *, row_number() OVER (PARTITION BY form_id, rec_id, slot_ord ORDER BY score DESC, col_ord) AS n FROM want) WHERE n = 1")
def fill_plan(spark, sf_dir):
    records, matches = _matched(spark, sf_dir)
    return P.fill_plan(records, matches)


@query(_MATCH_SQL + "SELECT form_id, rec_id, slot_key, \"column\", score FROM (SELECT *, max(score) OVER (PARTITION BY form_id, rec_id, slot_ord ORDER BY col_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM want) WHERE score = held")
def fill_conflicts(spark, sf_dir):
    records, matches = _matched(spark, sf_dir)
    return P.fill_conflicts(records, matches)


@query(_MATCH_SQL + "SELECT form_id, \"column\" FROM (SELECT DISTINCT form_id FROM names) CROSS JOIN col WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.form_id = names.form_id AND m.\"column\" = col.\"column\")".replace("FROM (SELECT DISTINCT form_id FROM names) CROSS", "FROM (SELECT DISTINCT form_id FROM names) AS names CROSS"))
def match_unmatched(spark, sf_dir):
    records, matches = _matched(spark, sf_dir)
    return P.unmatched(records, matches, P.names_table(spark, SLOTS))


@query(_MATCH_SQL + "SELECT form_id, \"column\", string_agg(slot_key, ',' ORDER BY slot_key) AS candidates FROM (SELECT DISTINCT form_id, \"column\", slot_key FROM m WHERE ambiguous) GROUP BY ALL")
def match_ambiguous(spark, sf_dir):
    return P.ambiguous(_matched(spark, sf_dir)[1])


@query("SELECT o_custkey, o_orderkey, score FROM (SELECT *, max(score) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM (SELECT o_custkey, o_orderkey, CAST(o_orderpriority[1] AS INTEGER) AS score FROM orders)) WHERE score = held")
def conflict_running_max(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("score"))
    return P.conflicts(o, ["o_custkey"], "o_orderkey", "score").drop("held")


@query("SELECT r_regionkey || '-' || n_nationkey AS rec_id, n_name AS name, r_name AS region, 'set' AS extra FROM region, nation")
def records_cross_override(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("rec_id"), F.create_map(F.lit("name"), "r_name", F.lit("region"), "r_name").alias("rec"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("rec_id"), F.create_map(F.lit("name"), "n_name").alias("rec"))
    over = F.create_map(F.lit("extra"), F.lit("set"))
    got = P.cross_records(a, b).withColumn("rec", F.map_concat(F.map_filter("rec", lambda k, v: k != "extra"), over))
    return got.select("rec_id", F.col("rec.name").alias("name"), F.col("rec.region").alias("region"), F.col("rec.extra").alias("extra"))


@query("SELECT event_id AS rec_id, unnest(json_keys(props)) AS \"column\", json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events WHERE props IS NOT NULL")
def json_records(spark, sf_dir):
    return R.json_column_records(table(spark, sf_dir, "events"), "event_id", "props")


@query(f"SELECT p_partkey, {_NORM_SQL.format('''('※ (' || p_name || ' ) ：')''')} AS wrapped, {_NORM_SQL.format('''('(' || p_type || ')')''')} AS label FROM part")
def label_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", L.normalise_label(F.concat(F.lit("※ ("), "p_name", F.lit(" ) ："))).alias("wrapped"), L.normalise_label(F.concat(F.lit("("), "p_type", F.lit(")"))).alias("label"))


_LABELISH = r"(trim({0}) <> '' AND NOT regexp_matches(trim({0}), '^[*※]') AND {1} <> '' AND length({1}) <= 24 AND NOT (regexp_matches(trim({0}), '[.?!。]$') AND length({1}) > 12) AND NOT regexp_matches(trim({0}), '^[\d\s.,~\-:/()]+$'))"


@query(f"SELECT p_partkey, {_LABELISH.format('p_name', _NORM_SQL.format('p_name'))} AS name_is, {_LABELISH.format('(p_type || chr(46))', _NORM_SQL.format('(p_type || chr(46))'))} AS type_is, {_LABELISH.format('(p_size::VARCHAR)', _NORM_SQL.format('(p_size::VARCHAR)'))} AS size_is FROM part")
def label_predicate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", L.looks_like_label(F.col("p_name")).alias("name_is"), L.looks_like_label(F.concat("p_type", F.lit("."))).alias("type_is"), L.looks_like_label(F.col("p_size").cast("string")).alias("size_is"))


@query(f"WITH word(g, w) AS (SELECT g, {_NORM_SQL.format('w')} FROM (VALUES {_ALIAS_SQL}) AS t(g, w)) SELECT DISTINCT a.w AS word, b.w AS alias FROM word a JOIN word b USING (g)")
def alias_expand(spark, sf_dir):
    return L.alias_table(spark)


@query("WITH a AS (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_brand || '.' || p_name ELSE p_name END AS k FROM part) SELECT p_partkey AS slot_ord, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN k || '@' || row_number() OVER (PARTITION BY k ORDER BY p_partkey) ELSE k END AS key FROM a")
def slot_keys(spark, sf_dir):
    return P.slot_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slot_ord"), F.col("p_name").alias("label"), F.col("p_brand").alias("group")))


# ---- tables, styles, sequences --------------------------------------------------------------

_CELLS = "SELECT l_orderkey AS t, l_linenumber AS \"row\", 1 AS \"col\", 1 + l_orderkey % 2 AS row_span, CAST(1 + l_quantity % 3 AS BIGINT) AS col_span, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem"


def _cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row"), F.lit(1).alias("col"), (1 + F.col("l_orderkey") % 2).alias("row_span"), (1 + F.col("l_quantity") % 3).cast("bigint").alias("col_span"), k.alias("k"))


def _places(cells):
    rows = cells.withColumn("r", F.explode(F.sequence(F.col("row").cast("bigint"), F.col("row") + F.col("row_span") - 1)))
    return rows.withColumn("c", F.explode(F.sequence(F.col("col").cast("bigint"), F.col("col") + F.col("col_span") - 1)))


@query(f"WITH cell AS ({_CELLS}), place AS (SELECT *, unnest(range(\"col\", \"col\" + col_span)) AS c FROM (SELECT *, unnest(range(\"row\", \"row\" + row_span)) AS r FROM cell)) SELECT a.t, a.\"row\" AS below, b.\"row\" AS above, a.c AS \"column\" FROM place a JOIN place b ON a.t = b.t AND a.c = b.c AND b.r = a.\"row\" - 1 WHERE a.r = a.\"row\"")
def grid_lookup(spark, sf_dir):
    p = _places(_cells(spark, sf_dir))
    above = p.select("t", "c", (F.col("r") + 1).alias("r"), F.col("row").alias("above"))
    return p.where("r = row").join(above, ["t", "c", "r"]).select("t", F.col("row").alias("below"), "above", F.col("c").alias("column"))


@query(f"WITH cell AS ({_CELLS}), place AS (SELECT t, r, unnest(range(\"col\", \"col\" + col_span)) AS c FROM (SELECT *, unnest(range(\"row\", \"row\" + row_span)) AS r FROM cell)) SELECT t, count(*) AS n_places, count(DISTINCT (r, c)) AS n_distinct, count(*) = count(DISTINCT (r, c)) AS tiled FROM place GROUP BY t")
def grid_tiling(spark, sf_dir):
    p = _places(_cells(spark, sf_dir)).groupBy("t", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("t").agg(F.sum("n").alias("n_places"), F.count(F.lit(1)).alias("n_distinct")).withColumn("tiled", F.col("n_places") == F.col("n_distinct"))


@query("SELECT a.l_linenumber AS line, count(*) AS n, sum(CASE WHEN a.l_returnflag = b.l_returnflag THEN 1 ELSE 0 END) AS same FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1")
def neighbour_agreement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_returnflag").alias("right"))
    return li.join(b, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == F.col("right")).cast("bigint")).alias("same"))


@query("WITH runs AS (SELECT user_id, ts, max(event_id) AS style FROM events WHERE event_type = 'signup' GROUP BY ALL) SELECT e.event_id, r.style FROM events e ASOF LEFT JOIN runs r ON e.user_id = r.user_id AND e.ts >= r.ts")
def asof_style(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("style"))
    return S.asof(e.select("user_id", "ts", "event_id"), runs, ["user_id"], "ts", "style", "style").select("event_id", "style")


_SPANS = "SELECT user_id, min(s) AS \"start\", max(s) + 1 AS \"end\" FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM (SELECT user_id, event_id, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))) GROUP BY user_id, island"
_FIXED = "SELECT DISTINCT user_id, s // 86400 * 86400 + 28800 AS lo, s // 86400 * 86400 + 36000 AS hi FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"


def _seconds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))


def _spans(spark, sf_dir):
    runs = S.gap_islands(_seconds(spark, sf_dir), ["user_id"], "s", "event_id", 21600)
    return runs.groupBy("user_id", "island").agg(F.min("s").alias("start"), (F.max("s") + 1).alias("end")).drop("island")


def _fixed(spark, sf_dir):
    day = F.floor(F.col("s") / 86400) * 86400
    return _seconds(spark, sf_dir).select("user_id", (day + 28800).alias("lo"), (day + 36000).alias("hi")).distinct()


@query(f"WITH a AS ({_SPANS}), b AS ({_FIXED}) SELECT a.user_id, \"start\", \"end\", lo, hi FROM a JOIN b ON a.user_id = b.user_id AND \"start\" < hi AND lo < \"end\"")
def interval_overlap(spark, sf_dir):
    return S.overlaps(_spans(spark, sf_dir), _fixed(spark, sf_dir), ["user_id"], 86400).select("user_id", "start", "end", "lo", "hi")


@query(f"WITH a AS ({_SPANS}), b AS ({_FIXED}) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND \"start\" < hi AND lo < \"end\")")
def interval_anti(spark, sf_dir):
    return S.overlaps(_spans(spark, sf_dir), _fixed(spark, sf_dir), ["user_id"], 86400, "left_anti")


@query(f"WITH a AS ({_SPANS}), b AS ({_FIXED}) SELECT a.user_id, lo, hi, CAST(sum(least(\"end\", hi) - greatest(\"start\", lo)) AS BIGINT) AS covered, sum(least(\"end\", hi) - greatest(\"start\", lo)) * 10 >= 6 * (hi - lo) AS enough FROM a JOIN b ON a.user_id = b.user_id AND \"start\" < hi AND lo < \"end\" GROUP BY a.user_id, lo, hi")
def interval_coverage(spark, sf_dir):
    met = S.overlaps(_spans(spark, sf_dir), _fixed(spark, sf_dir), ["user_id"], 86400)
    return Y.covered(met, ["user_id"])


@query("SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR prev <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, run")
def style_runs(spark, sf_dir):
    runs = S.value_runs(table(spark, sf_dir, "events"), ["user_id"], ("ts", "event_id"), "event_type")
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS label FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM events)")
def carry_label(spark, sf_dir):
    label = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return S.carried(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], label, F.col("event_type") == "purchase", "label").select("event_id", "label")


@query(f"SELECT user_id, count(*) AS n_bands, CAST(max(\"end\" - \"start\") AS BIGINT) AS longest FROM ({_SPANS}) GROUP BY user_id")
def bands(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_bands"), F.max(F.col("end") - F.col("start")).alias("longest"))


@query("SELECT l_orderkey, bool_and(coalesce(l_linenumber > p, true)) AS increasing, bool_and(coalesce(l_shipdate >= d, true)) AS dated FROM (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_linenumber) OVER w AS p, lag(l_shipdate) OVER w AS d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey)) GROUP BY 1")
def monotonic_check(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.coalesce(F.col("l_linenumber") > F.lag("l_linenumber").over(w), F.lit(True)).alias("a"), F.coalesce(F.col("l_shipdate") >= F.lag("l_shipdate").over(w), F.lit(True)).alias("b"))
    return li.groupBy("l_orderkey").agg(F.bool_and("a").alias("increasing"), F.bool_and("b").alias("dated"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, number FROM (SELECT *, CAST(sum(CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS number FROM lineitem) WHERE l_quantity >= 10")
def keep_prefix_sum(spark, sf_dir):
    kept = Y.renumbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity") >= 10)
    return kept.select("l_orderkey", "l_partkey", "l_linenumber", "number")


@query("SELECT user_id, \"start\", max(\"end\") AS \"end\" FROM (SELECT *, min(s) OVER (PARTITION BY user_id, island) AS \"start\" FROM (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(\"end\") OVER (PARTITION BY user_id ORDER BY s, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS \"end\" FROM events)))) GROUP BY user_id, \"start\"")
def merge_intervals(spark, sf_dir):
    e = _seconds(spark, sf_dir).select("user_id", F.col("s").alias("start"), (F.col("s") + 7200).alias("end"))
    return S.merged(e, ["user_id"], "start", "end").select("user_id", "start", "end")


@query("WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, CAST(l_quantity AS BIGINT) % 4 AS level FROM lineitem) SELECT a.l_orderkey, a.ord, a.level, (SELECT max(b.ord) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.ord < a.ord AND b.level < a.level) AS parent FROM r a")
def level_tree_parent(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("bigint").alias("ord"), (F.col("l_quantity").cast("bigint") % 4).alias("level"))
    return G.level_parents(li, ["l_orderkey"], "ord", "level")


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS u, 1000000 + c_nationkey * 10 + c_custkey % 10 AS v FROM customer), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, reach) AS (SELECT u, least(u, min(v)) FROM b GROUP BY u UNION SELECT b.u, r.reach FROM b JOIN r ON b.v = r.node) SELECT node, min(reach) AS component FROM r GROUP BY node")
def components(spark, sf_dir):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), (1000000 + F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).cast("bigint").alias("v"))
    return G.components(c)


# ---- aggregates ---------------------------------------------------------------------------

_FOLD = r"regexp_replace(regexp_replace(l, '[0-9]+', '#', 'g'), '\s+', '', 'g')"


@query(f"WITH k AS (SELECT DISTINCT doc_id, {_FOLD} AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) SELECT key, count(*) AS n_pages FROM k WHERE key <> '' GROUP BY key HAVING count(*) >= 3 AND count(*) >= 0.004 * (SELECT count(DISTINCT doc_id) FROM documents)")
def boilerplate_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return G.boilerplate(d, "doc_id", "line", 3, 0.004)


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, sf_dir):
    return I.digest(table(spark, sf_dir, "documents")).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang")
def manifest_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT p_type, median(p_retailprice) AS median_price FROM part GROUP BY p_type")
def median_by_class(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.median("p_retailprice").alias("median_price"))


@query("WITH m AS (SELECT p_type, median(p_retailprice) AS first_median FROM part GROUP BY p_type) SELECT p_type, first_median, median(p_retailprice) AS robust_median, count(*) AS n_near FROM part JOIN m USING (p_type) WHERE abs(p_retailprice - first_median) <= 0.15 * first_median GROUP BY ALL")
def robust_medians(spark, sf_dir):
    return G.robust_medians(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice", 0.15)


_FACE = "SELECT p_brand, p_type, count(*) AS n, CASE WHEN count(*) >= 3 THEN median(p_retailprice) WHEN max(p_retailprice) - min(p_retailprice) <= 0.05 * max(p_retailprice) THEN median(p_retailprice) END AS width FROM part GROUP BY ALL"


@query(f"WITH f AS ({_FACE}), m AS (SELECT p_type, median(p_retailprice) AS base FROM part GROUP BY p_type) SELECT p_brand, p_type, n, width FROM f JOIN m USING (p_type) WHERE abs(width - base) >= 0.02 * base")
def face_width(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lo, hi = F.min("p_retailprice"), F.max("p_retailprice")
    f = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.median("p_retailprice")).when(hi - lo <= 0.05 * hi, F.median("p_retailprice")).alias("width"))
    m = p.groupBy("p_type").agg(F.median("p_retailprice").alias("base"))
    return f.join(m, "p_type").where(F.abs(F.col("width") - F.col("base")) >= 0.02 * F.col("base")).select("p_brand", "p_type", "n", "width")


@query("SELECT l_returnflag, mode, n FROM (SELECT l_returnflag, CAST(round(l_quantity) AS BIGINT) AS mode, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, CAST(round(l_quantity) AS BIGINT)) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def mode_rounded(spark, sf_dir):
    return G.mode(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.round("l_quantity").cast("bigint"))


@query("SELECT l_returnflag, l_linestatus, count(*) FILTER (l_discount >= 0.05) AS passed, count(*) FILTER (NOT l_discount >= 0.05) AS failed FROM lineitem GROUP BY ALL")
def check_tally(spark, sf_dir):
    ok = F.col("l_discount") >= 0.05
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@query("SELECT user_id, bit_or(CAST(1 AS BIGINT) << code) AS mask FROM (SELECT user_id, CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 11 WHEN 'click' THEN 4 WHEN 'view' THEN 9 ELSE 13 END AS code FROM events) WHERE code <> 13 GROUP BY user_id")
def control_mask(spark, sf_dir):
    t = F.col("event_type")
    code = F.when(t == "signup", 2).when(t == "purchase", 11).when(t == "click", 4).when(t == "view", 9).otherwise(13)
    e = table(spark, sf_dir, "events").select("user_id", code.alias("code")).where("code <> 13")
    return e.groupBy("user_id").agg(F.expr("bit_or(shiftleft(1L, code))").alias("mask"))


@query("SELECT a.label, count(*) AS n_values, avg(d) AS mean_diff, count(*) FILTER (d > 0.5) AS over, min(i) FILTER (d > 0.5) AS left_edge, max(i) FILTER (d > 0.5) AS right_edge FROM (SELECT e.label, i, abs(e.embedding[i + 1] - f.embedding[i + 1])::DOUBLE AS d FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1, range(64) AS t(i)) a GROUP BY a.label")
def bbox_diff(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = e.join(f, "vec_id").select("label", F.posexplode(F.zip_with("embedding", "other", lambda a, b: F.abs(a - b).cast("double"))).alias("i", "d"))
    return C.difference_box(d, ["label"], "i", "d", 0.5)


@query("SELECT vec_id, arg_max(s, round(c, 9) * 1000 - s) AS shift FROM (SELECT vec_id, s, list_sum(list_transform(range(1, 65 - s), lambda i: embedding[i]::DOUBLE * embedding[i + s]::DOUBLE)) AS c FROM embeddings, range(1, 9) AS t(s)) GROUP BY vec_id")
def xcorr_shift(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("s", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))))
    dot = F.expr("aggregate(sequence(0, 63 - int(s)), double(0), (t, i) -> t + double(embedding[i]) * double(embedding[i + int(s)]))")
    return e.withColumn("c", F.round(dot, 9) * 1000 - F.col("s")).groupBy("vec_id").agg(F.max_by("s", "c").alias("shift"))


# ---- order, samples, sets -----------------------------------------------------------------

@query("SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('form' || p_name || p_partkey), p_partkey) AS rank FROM part) WHERE rank <= 3")
def stratified_topn(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.md5(F.concat(F.lit("form"), "p_name", F.col("p_partkey").cast("string"))).alias("h"))
    return G.top_each(p, ["p_brand"], ["h", "p_partkey"], 3).select("p_brand", "p_partkey", "rank")


@query("WITH d AS (SELECT DISTINCT l_returnflag, l_suppkey, l_orderkey FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey) AS rank, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM d) SELECT l_suppkey, l_returnflag, l_orderkey, rank FROM k WHERE n >= 4 AND rank <= CASE WHEN n >= 25 THEN 3 ELSE 2 END")
def topk_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey").distinct()
    d = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_suppkey", "l_returnflag"))).where("n >= 4")
    return G.top_each(d, ["l_suppkey", "l_returnflag"], ["l_orderkey"], F.when(F.col("n") >= 25, 3).otherwise(2)).drop("n")


@query("SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k <= 2")
def org_cap(spark, sf_dir):
    return G.top_each(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"], 2).select("s_nationkey", "s_suppkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k % 5 = 1")
def stride_sample(spark, sf_dir):
    return C.every_kth(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey")


@query("SELECT o_orderpriority AS problem, o_custkey FROM orders WHERE o_totalprice > 100000 EXCEPT ALL SELECT o_orderpriority, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_problems(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mine = lambda d: d.select(F.col("o_orderpriority").alias("problem"), "o_custkey")
    return mine(o.where("o_totalprice > 100000")).exceptAll(mine(o.where("o_orderstatus = 'F'")))


@query("SELECT name, min(o) AS first_seen FROM (SELECT n_name AS name, n_nationkey AS o FROM nation UNION ALL SELECT r_name, 100 + r_regionkey FROM region UNION ALL SELECT DISTINCT c_mktsegment, 200 FROM customer) GROUP BY name")
def column_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("o"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (100 + F.col("r_regionkey")).alias("o"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.lit(200).alias("o"))
    return n.unionByName(r).unionByName(c).groupBy("name").agg(F.min("o").alias("first_seen"))


# ---- values and texts ---------------------------------------------------------------------

@query("SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y1, month(o_orderdate)::VARCHAR AS m1, day(o_orderdate)::VARCHAR AS d1, month(o_orderdate)::VARCHAR AS m2, day(o_orderdate)::VARCHAR AS d2, CAST(NULL AS VARCHAR) AS d3, true AS none FROM orders")
def parse_date_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = lambda f: V.parse_date(F.date_format(F.col("o_orderdate").cast("timestamp"), f))
    a, b, c = at("yyyy. MM. dd."), at("yyyyMMdd"), at("yyyy'년' M'월'")
    return o.select("o_orderkey", a["year"].alias("y1"), a["month"].alias("m1"), a["day"].alias("d1"), b["month"].alias("m2"), b["day"].alias("d2"), c["day"].alias("d3"), V.parse_date(F.col("o_orderpriority")).isNull().alias("none"))


@query("SELECT c_custkey, n[1:6] AS a1, n[7:] AS a2, t[1:2] AS b1, t[3:5] AS b2, t[6:] AS b3, '7' AS c1, 'x-' || c_custkey || '-y' AS c2, c_custkey::VARCHAR AS d1, CAST(NULL AS VARCHAR) AS d2 FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 13, '9') AS n, '02' || lpad(c_custkey::VARCHAR, 7, '3') AS t FROM customer)")
def split_number(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    a = V.split_number(F.lpad("k", 13, "9"), 2)
    b = V.split_number(F.concat(F.lit("02"), F.lpad("k", 7, "3")), 3)
    d = V.split_number(F.concat(F.lit("7-x-"), "k", F.lit("-y")), 2)
    e = V.split_number(F.col("k"), 2)
    return c.select("c_custkey", a[0].alias("a1"), a[1].alias("a2"), b[0].alias("b1"), b[1].alias("b2"), b[2].alias("b3"), d[0].alias("c1"), d[1].alias("c2"), e[0].alias("d1"), e[1].alias("d2"))


@query("SELECT o_orderkey, o_orderpriority AS exact, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority || '+1-URGENT' END AS two, o_orderpriority AS prefix FROM orders")
def choose_options(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    options = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    p = F.col("o_orderpriority")
    two = F.when(p != "4-NOT SPECIFIED", V.choose_options(options, F.concat(p, F.lit(" , 1 - urgent"))))
    return o.select("o_orderkey", F.array_join(V.choose_options(options, F.lower(p)), "+").alias("exact"), F.array_join(two, "+").alias("two"), F.array_join(V.choose_options(options, F.substring(p, 1, 3)), "+").alias("prefix"))


_COUNT = {k: f"len(regexp_extract_all(p_name, '{p}'))" for k, p in {"sp": "[ ]", "dg": "[0-9]", "up": "[A-Z]", "lo": "[a-z]", "pu": r"[!-/:-@\[-`{-~]"}.items()}


@query("SELECT p_partkey, round(CAST(0.5 * {sp} + 0.55 * {dg} + 0.65 * {up} + 0.602 * {lo} + 0.55 * {pu} + 1.0 * (length(p_name) - {sp} - {dg} - {up} - {lo} - {pu}) AS DOUBLE), 6) AS width FROM part".format(**_COUNT))
def text_width(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(V.text_width(F.col("p_name")), 6).alias("width"))


@query("SELECT n_nationkey, CAST(length(s) + len(regexp_extract_all(s, '[가-힣]')) AS BIGINT) AS width FROM (SELECT n_nationkey, n_name || ' 국가' || repeat('명', n_nationkey % 4) AS s FROM nation)")
def display_width(spark, sf_dir):
    s = F.concat("n_name", F.lit(" 국가"), F.expr("repeat('명', n_nationkey % 4)"))
    return table(spark, sf_dir, "nation").select("n_nationkey", V.display_width(s).cast("bigint").alias("width"))


@query("SELECT doc_id, sha256(regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(9), ' '), '[\\x00-\\x09\\x0b-\\x1f]', '', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("cleaned"))


@query("SELECT page_id, CASE WHEN n = '' THEN '_' ELSE n END AS name FROM (SELECT page_id, left(trim(regexp_replace(url, '[\\\\/:*?\"<>|\\x00-\\x1f]', '_', 'g')), 60) AS n FROM pages)")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("SELECT page_id, CAST(len(t) AS BIGINT) AS n_tags, CAST(len(list_filter(t, lambda x: x[2] = '/')) AS BIGINT) AS n_closing, sha256(array_to_string(t, '')) AS tags FROM (SELECT page_id, regexp_extract_all(html, '</?[a-zA-Z][^<>]*>') AS t FROM pages)")
def html_tokens(spark, sf_dir):
    t = F.regexp_extract_all("html", F.lit("(</?[a-zA-Z][^<>]*>)"), 1)
    p = table(spark, sf_dir, "pages").select("page_id", t.alias("t"))
    return p.select("page_id", F.size("t").cast("bigint").alias("n_tags"), F.size(F.filter("t", lambda x: F.substring(x, 2, 1) == "/")).cast("bigint").alias("n_closing"), F.sha2(F.array_join("t", ""), 256).alias("tags"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("link"))


@query("SELECT c_custkey AS slot, CASE WHEN c_acctbal < 0 THEN 'manual' WHEN c_nationkey % 2 = 0 THEN 'profile' ELSE 'earlier' END AS holder FROM customer")
def profile_priority(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    given = [("manual", 1, F.col("c_acctbal") < 0), ("profile", 2, F.col("c_nationkey") % 2 == 0), ("earlier", 3, F.lit(True))]
    claims = c.select(F.col("c_custkey").alias("slot"), F.explode(F.array(*(F.struct(F.when(ok, F.lit(p)).alias("p"), F.lit(n).alias("holder")) for n, p, ok in given))).alias("x")).where("x.p is not null")
    return claims.groupBy("slot").agg(F.min("x").alias("x")).select("slot", "x.holder")


@query("SELECT DISTINCT p_type AS \"column\" FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size < 3)")
def coverage_unused(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("column")).distinct().join(p.where("p_size < 3").select(F.col("p_type").alias("column")).distinct(), "column", "left_anti")


@query("SELECT p_partkey, CASE WHEN p_size + 4 <= length(p_name) THEN p_name[1:p_size] || '<new>' || p_name[p_size + 5:] END AS text FROM part")
def replace_range(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.replace_range(F.col("p_name"), F.col("p_size"), F.col("p_size") + 4, F.lit("<new>")).alias("text"))


@query("SELECT p_partkey, CASE WHEN a > 14 AND a < 16 THEN NULL WHEN a >= 16 THEN a - 2 ELSE a END AS at FROM (SELECT p_partkey, CASE WHEN p_size > 5 AND p_size < 8 THEN NULL WHEN p_size >= 8 THEN CAST(p_size AS BIGINT) + 2 ELSE CAST(p_size AS BIGINT) END AS a FROM part)")
def edit_log_map(spark, sf_dir):
    log = F.array(*(F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end"), F.lit(n).cast("bigint").alias("length")) for a, b, n in ((5, 8, 5), (14, 16, 0))))
    return table(spark, sf_dir, "part").select("p_partkey", T.replayed(F.col("p_size"), log).alias("at"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 >= 5 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 < 5) GROUP BY 2")
def incremental_ingest(spark, sf_dir):
    # Two arrivals make the case: the manifest of the first, then what is new in the second.
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = I.digest(d.where("doc_id % 10 < 5")).select("doc_id", "sha256")
    return I.new_items(d.where("doc_id % 10 >= 5"), manifest, "doc_id").select("doc_id", "sha256")


def _values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


@query("SELECT id, label, options, item FROM (VALUES " + _values([(i, x[1], x[2], x[3]) for i, x in enumerate(GOLDEN.CHOICES) if x[2]]) + ") AS t(id, label, options, item)")
def choice_lines_golden(spark, sf_dir):
    ship(spark)
    texts = spark.createDataFrame([(i, x[0]) for i, x in enumerate(GOLDEN.CHOICES)], "id int, text string")
    return find_choices(texts, "text").select("id", F.coalesce("label", F.lit("")).alias("label"), F.array_join("options", ",").alias("options"), "item")


@query("SELECT id, n, change FROM (VALUES " + _values([(i, n, c) for i, x in enumerate(GOLDEN.DIFFS) for n, c in enumerate(x[2])]) + ") AS t(id, n, change)")
def text_diff_golden(spark, sf_dir):
    ship(spark)
    pairs = spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(GOLDEN.DIFFS)], "id int, a string, b string")
    return diffs(pairs, "a", "b").select("id", "n", F.concat(F.concat_ws("-", "start", "end"), F.lit(":"), "text").alias("change"))


@query("SELECT id, n, blank FROM (VALUES " + _values([(i, n, b) for i, x in enumerate(GOLDEN.BLANKS) for n, b in enumerate(x[1])]) + ") AS t(id, n, blank)")
def inline_blanks_golden(spark, sf_dir):
    ship(spark)
    texts = spark.createDataFrame([(i, x[0], x[0]) for i, x in enumerate(GOLDEN.BLANKS)], "id int, text string, own string")
    # What a part prints: its characters, with each tab as the eight positions it counts.
    wide = F.replace("own", F.lit("\t"), F.lit("\x01" * 8))
    printed = lambda p: F.concat(p["role"], F.lit('="'), F.replace(F.substring(wide, p["start"] + 1, p["end"] - p["start"]), F.lit("\x01"), F.lit("")), F.lit('"'))
    got = find_blanks(texts, "text")
    lead = F.when(F.col("lead").isNotNull(), F.concat(F.lit("@"), "lead")).otherwise(F.lit(""))
    return got.select("id", "n", F.concat("kind", F.lit(":"), F.array_join("display", "/"), lead, F.lit(":"), F.array_join(F.transform("parts", printed), ",")).alias("blank"))
