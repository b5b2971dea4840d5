"""Registered queries over what is written and grows: plans in paragraphs, dictionaries, constraints, changed files; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.operators import constraints as K
from quillgrid.operators import dictionaries as D
from quillgrid.plans import fill as P
from quillgrid.plans.queries import _MATCH_SQL, SLOTS, customer_records, query, table
from quillgrid.plans.slotnames import names_of
from quillgrid.sources import files as X
from quillgrid.stages import deleted, small, written

# ---- plans written into paragraphs --------------------------------------------------------

#: Spaces of each blank; blanks of the form "power" and the last two of "certificate" share a paragraph.
BLANK = 40
_PLACED = [(s.form_id, s.slot_ord, s.key, 1 if s.form_id == "power" else 5 if s.key.startswith("전화번호") else s.slot_ord) for s in SLOTS]
_WIDTH = " + ".join(f"{w}::DOUBLE * (length(v) - length(regexp_replace(v, '[{c}]', '', 'g')))" for w, c in ((0.5, " "), (0.55, "0-9"), (0.65, "A-Z"), (0.602, "a-z"), (0.55, "!-/:-@\\[-`{-~")))


def _forms(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Blanks and paragraphs of the forms: each blank in brackets after its key."""
    texts: dict[tuple[str, int], str] = {}
    blanks = []
    for form, _, key, p in _PLACED:
        before = texts.get((form, p), "") + key + "["
        texts[form, p] = before + " " * BLANK + "]"
        blanks.append((form, key, p, "text", key, [("value", len(before), len(before) + BLANK, "left", None)]))
    part = "array<struct<role:string,start:int,end:int,align:string,prefix:string>>"
    paragraphs = spark.createDataFrame([(f, p, t) for (f, p), t in texts.items()], "form_id string, p int, text string")
    return spark.createDataFrame(blanks, f"form_id string, slot_key string, p int, kind string, label string, parts {part}"), paragraphs


@query(
    _MATCH_SQL
    + f""", plan AS (SELECT form_id, rec_id, slot_ord, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY form_id, rec_id, slot_ord ORDER BY score DESC, col_ord) AS n FROM want) WHERE n = 1),
place(form_id, slot_ord, key, p) AS (VALUES {", ".join(f"('{f}', {o}, '{k}', {p})" for f, o, k, p in _PLACED)}),
touched AS (SELECT DISTINCT form_id, rec_id, p FROM plan JOIN place USING (form_id, slot_ord)),
piece AS (SELECT form_id, rec_id, p, slot_ord, key, v, CASE WHEN v IS NULL THEN repeat(' ', {BLANK}) ELSE v || repeat(' ', greatest(0, CAST(floor((20.0::DOUBLE - ({_WIDTH})) / 0.5::DOUBLE + 0.5::DOUBLE) AS INT))) END AS inner_text
  FROM touched JOIN place USING (form_id, p) LEFT JOIN plan USING (form_id, rec_id, slot_ord))
SELECT form_id, rec_id, p, string_agg(key || '[' || inner_text || ']', '' ORDER BY slot_ord) AS text, string_agg(CASE WHEN v IS NOT NULL THEN key END, ',' ORDER BY slot_ord) AS filled, '' AS failed FROM piece GROUP BY form_id, rec_id, p"""
)
def fill_apply(spark, sf_dir):
    """Every customer's record written into the paragraphs of every form that asks for something of it."""
    records = customer_records(spark, sf_dir)
    slots = spark.createDataFrame([(s.form_id, s.slot_ord, s.id, list(s.labels), s.key, s.index, s.group) for s in SLOTS], "form_id string, slot_ord int, id string, labels array<string>, key string, index int, group string")
    plan = P.fill_plan(records, P.matches_of(records, names_of(slots)))
    got = P.fill_apply(plan, *_forms(spark))
    return got.select("form_id", "rec_id", "p", "text", F.array_join("filled", ",").alias("filled"), F.array_join("failed", ",").alias("failed"))


# ---- dictionaries -------------------------------------------------------------------------

_FACE = ["face", "size", "tax", "colour"]
_COLOUR_SQL = "CASE WHEN l_discount < 0.005 THEN '#000000' WHEN l_discount < 0.055 THEN '#ff0000' WHEN l_discount < 0.085 THEN '#0000ff' WHEN l_discount < 0.095 THEN '#202020' ELSE '#e0e0f0' END"
_STYLES_SQL = f"""line AS (SELECT o_orderpriority AS form, l_orderkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n, l_returnflag || l_linestatus AS face, CAST(l_quantity AS INT) AS size, CAST(round(l_tax * 100) AS INT) AS tax, {_COLOUR_SQL} AS colour FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
style AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY face, size, tax, colour) - 1 AS id FROM (SELECT DISTINCT form, face, size, tax, colour FROM line)),
loud AS (SELECT * FROM style WHERE colour IN ('#ff0000', '#0000ff')),
black AS (SELECT form, face, size, tax, id FROM style WHERE colour = '#000000')"""


def _colour() -> Column:
    d = F.col("l_discount")
    return F.when(d < 0.005, "#000000").when(d < 0.055, "#ff0000").when(d < 0.085, "#0000ff").when(d < 0.095, "#202020").otherwise("#e0e0f0")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as runs of a paragraph's text, with their styles."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("p"), F.col("o_orderpriority").alias("form"))
    w = Window.partitionBy("p").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "p").join(o, "p")
    face = F.concat("l_returnflag", "l_linestatus")
    return line.select("form", "p", (F.row_number().over(w) - 1).cast("bigint").alias("n"), face.alias("face"), F.col("l_quantity").cast("int").alias("size"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), _colour().alias("colour"))


def _styles(lines: DataFrame) -> DataFrame:
    """Styles of each form, numbered from 0; written, as they are read many times."""
    return written(D.dense_numbers(lines.select("form", *_FACE).distinct(), ["form"], _FACE, "id"), "styles")


@query(
    f"""WITH {_STYLES_SQL},
asked AS (SELECT form, face, size, tax, min(id) AS first FROM loud GROUP BY ALL),
fresh AS (SELECT form, face, size, tax, (SELECT max(id) FROM style s WHERE s.form = a.form) + row_number() OVER (PARTITION BY form ORDER BY first) AS id FROM asked a ANTI JOIN black b USING (form, face, size, tax))
SELECT form, face, size, tax, coalesce(b.id, f.id) AS id, b.id IS NULL AS fresh FROM asked LEFT JOIN black b USING (form, face, size, tax) LEFT JOIN fresh f USING (form, face, size, tax)"""
)
def style_upsert(spark, sf_dir):
    """The black variant of every coloured style, found or added with numbers that go on."""
    styles = _styles(_lines(spark, sf_dir))
    wanted = styles.where(D.marked_out(F.col("colour"))).withColumn("colour", F.lit("#000000"))
    _, answers = D.upserted(styles, wanted.withColumnRenamed("id", "at"), ["form"], _FACE, ["at"])
    return answers.select("form", "face", "size", "tax", "id", "fresh")


@query(
    f"""WITH {_STYLES_SQL},
span AS (SELECT o_orderkey AS p, o_orderkey % 20 + 5 AS s, o_orderkey % 20 + 5 + o_orderkey % 30 AS e FROM orders),
run AS (SELECT form, p, n * 10 AS a, n * 10 + 10 AS b, id, s, e, s < e AND s < n * 10 + 10 AND e > n * 10 AS met FROM line JOIN style USING (form, face, size, tax, colour) JOIN span USING (p)),
piece AS (SELECT form, p, a AS "start", b AS "end", id, false AS over FROM run WHERE NOT met
  UNION ALL SELECT form, p, a, s, id, false FROM run WHERE met AND a < s
  UNION ALL SELECT form, p, greatest(a, s), least(b, e), id, true FROM run WHERE met
  UNION ALL SELECT form, p, e, b, id, false FROM run WHERE met AND e < b),
asked AS (SELECT form, face, size, tax, min({{'p': p, 's': "start"}}) AS first FROM piece JOIN loud USING (form, id) WHERE over GROUP BY ALL),
fresh AS (SELECT form, face, size, tax, (SELECT max(id) FROM style s WHERE s.form = a.form) + row_number() OVER (PARTITION BY form ORDER BY first) AS id FROM asked a ANTI JOIN black b USING (form, face, size, tax)),
variant AS (SELECT l.form, l.id, coalesce(b.id, f.id) AS other FROM loud l LEFT JOIN black b USING (form, face, size, tax) LEFT JOIN fresh f USING (form, face, size, tax))
SELECT form, p, "start", "end", CASE WHEN over THEN coalesce(other, piece.id) ELSE piece.id END AS id FROM piece LEFT JOIN variant USING (form, id)"""
)
def recolour_runs(spark, sf_dir):
    """Runs of text after a stretch of each paragraph was written over: marked-out colours turn black there, whatever else a style holds."""
    lines = written(_lines(spark, sf_dir), "lines")
    styles = _styles(lines)
    runs = lines.join(small(styles), ["form", *_FACE]).select("form", "p", (F.col("n") * 10).alias("start"), (F.col("n") * 10 + 10).alias("end"), "id")
    k = F.col("o_orderkey")
    over = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("form"), k.alias("p"), (k % 20 + 5).alias("start"), (k % 20 + 5 + k % 30).alias("end"))
    _, changed = D.recoloured(runs, over, styles, ["form"], _FACE)
    deleted(lines)  # what is changed reads pieces, which are written
    return changed


# ---- constraints --------------------------------------------------------------------------

_BAD = {"discount too high": "l_quantity > 40 AND NOT l_discount < 0.085", "returned too late": "l_returnflag = 'R' AND NOT year(l_shipdate) < 2001"}


def _rules() -> list[K.Holds]:
    return [
        K.Holds("discount too high", F.col("l_discount") < 0.085, F.col("l_quantity") > 40, share=0.8),
        K.Holds("returned too late", F.year("l_shipdate") < 2001, F.col("l_returnflag") == "R"),
    ]


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, 'discount too high' AS problem FROM lineitem WHERE " + _BAD["discount too high"]
    + " UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'returned too late' FROM lineitem WHERE " + _BAD["returned too late"]
    + " UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'order not open' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"
    " UNION ALL SELECT l_orderkey, l_linenumber, min(l_partkey), 'line told twice' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
)
def constraint_problems(spark, sf_dir):
    """Lines that break a rule, refer to no open order or stand twice."""
    open_orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    rules = [*_rules(), K.Refers("order not open", ("l_orderkey",), open_orders, ("o_orderkey",)), K.Once("line told twice", ("l_orderkey", "l_linenumber"))]
    return K.problems(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], rules)


@query(
    f"""WITH t AS (SELECT l_linestatus, 'discount too high' AS name, 0.8 AS share, count(*) FILTER (l_quantity > 40) AS checked, count(*) FILTER ({_BAD["discount too high"]}) AS failed FROM lineitem GROUP BY 1
UNION ALL SELECT l_linestatus, 'returned too late', 1, count(*) FILTER (l_returnflag = 'R'), count(*) FILTER ({_BAD["returned too late"]}) FROM lineitem GROUP BY 1)
SELECT l_linestatus, name, checked, failed, checked - failed >= share * checked AS passed FROM t"""
)
def constraint_tally(spark, sf_dir):
    """How often each rule was looked at and broken, by state of the line, and whether the share asked for was reached."""
    return K.tally(table(spark, sf_dir, "lineitem"), _rules(), ["l_linestatus"])


# ---- files --------------------------------------------------------------------------------

@query("SELECT doc_id || '.txt' AS name, CAST(octet_length(encode(replace(text, chr(10), ' '))) AS BIGINT) AS n_bytes FROM documents WHERE contains(text, chr(10))")
def changed_files(spark, sf_dir):
    """Documents as files, of which lines were joined: those that a manifest of the originals doesn't hold as they are."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    before = X.digests(d.select("name", F.encode("text", "UTF-8").alias("content")))
    after = d.select("name", F.encode(F.replace("text", F.lit("\n"), F.lit(" ")), "UTF-8").alias("content"))
    return X.changed(after, before).select("name", F.octet_length("content").cast("bigint").alias("n_bytes"))
