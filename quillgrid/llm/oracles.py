"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from quillgrid.llm.licenses import PHRASES, TEMPLATES, THRESHOLD
from quillgrid.llm.secrets import ADDED, BASE, Rule

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASCII_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Links by a prefix join: of two sets with a Jaccard similarity of 0.8 or more, each holds 80 % of the other's shingles, so the
#: rarest n - ceil(0.8 n) + 1 of both share one.
OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS ws FROM documents),
lists AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS sh FROM d),
own AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(sh, chr(10)))) END AS rep, sh FROM lists),
sets AS (SELECT doc_id, n, unnest(sh) AS s FROM own WHERE doc_id = rep),
ranked AS (SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS k FROM sets JOIN (SELECT s, count(*) AS df FROM sets GROUP BY s) USING (s)),
prefix AS (SELECT doc_id, n, s FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT x, y FROM met JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y AND b.s = a.s GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT DISTINCT rep AS x, rep AS y FROM own UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
root AS (SELECT x AS rep, min(y) AS root FROM reach GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM own JOIN root USING (rep)
"""


def _either_case(pattern: str) -> str:
    """A pattern of letters in either case: ASCII only, where (?i) would fold other letters too."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            step = 4 if pattern[i + 1] == "x" else 2
            out, i = out + pattern[i : i + step], i + step
            continue
        inside = c == "[" or (inside and c != "]")
        out += f"[{c}{c.upper()}]" if c.islower() and not inside else c
        i += 1
    return out


def _spans(k: int, rule: Rule) -> str:
    """Spans of one rule, from what stands between its matches."""
    pattern = quoted((_either_case(rule.pattern) if rule.ignore_case else rule.pattern).replace(r"\s", r"\x20\x09-\x0D"))
    sizes = lambda c: f"list_transform({c}, lambda x: length(x))"
    return f"""
SELECT r, {k} AS k, '{rule.kind}' AS kind, start, start + size AS til FROM (
  SELECT r, m[i] AS size, g[i] AS told, list_sum(gaps[:i]) + coalesce(list_sum(m[:i - 1]), 0) AS start FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, {sizes(f"regexp_extract_all(text, {pattern})")} AS m, {sizes(f"regexp_extract_all(text, {pattern}, {rule.group})")} AS g, {sizes(f"string_split_regex(text, {pattern})")} AS gaps
      FROM d WHERE regexp_matches(text, {pattern})))) WHERE told >= {rule.least}"""


_KINDS = ", ".join(f"'{r.kind}'" for r in BASE)
OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(_spans(k, rule) for k, rule in enumerate(BASE + ADDED))}),
told AS (SELECT r, kind, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(til AS BIGINT) AS t, start, k FROM span),
facts AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in BASE)},
  string_agg(t, ',' ORDER BY start, k) FILTER (kind IN ({_KINDS})) AS base, string_agg(t, ',' ORDER BY start, k) AS spans FROM told GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{x.kind}, 0) AS BIGINT) AS n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN facts USING (r)
"""


OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ASCII_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_ASCII_WORDS} AS ws FROM benchmark),
bw AS (SELECT item, least(len(ws), 10) AS n, ws FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM bw)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT r, i, n, item FROM dw JOIN win USING (n, w)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

OP7 = """
SELECT conv_id, turn AS stage, CAST(0 AS INTEGER) AS depth, turn, CAST(0 AS INTEGER) AS ord, 'message' AS kind,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json, '' AS problems
FROM conversations
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (VALUES (5), (6), (7), (8), (9), (10)) AS t(n) WHERE len(ws) >= n)),
dup AS (SELECT r, n, i FROM g QUALIFY count(*) OVER (PARTITION BY r, n, w) > 1),
cover AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS p FROM dup),
chars AS (SELECT r, n, count(*) AS words, sum(length(ws[p])) AS chars FROM cover JOIN d USING (r) GROUP BY r, n),
line AS (SELECT r, l, count(*) AS k, sum(list_sum(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: length(x)))) AS c
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
lines AS (SELECT r, sum(k - 1) AS again, sum(CASE WHEN k > 1 THEN c ELSE 0 END) AS c FROM line GROUP BY r),
over AS (SELECT r, max(CASE WHEN n = 5 THEN words END) AS rep, bool_or(100 * chars > (25 - n) * total) AS bad
  FROM chars JOIN (SELECT r, list_sum(list_transform(ws, lambda x: length(x))) AS total FROM d) USING (r) GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.again, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, coalesce(bad, false) AS bad, coalesce(lines.c, 0) AS line_chars
  FROM d LEFT JOIN over USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT bad AND NOT 100 * line_chars > 30 * word_chars AS kept
FROM m
"""

#: Every run of words is looked at, from each template word on; no prefix, length or position filter.
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ASCII_WORDS} AS ws FROM documents),
phrase(phrase, label) AS (VALUES {", ".join(f"({quoted(p)}, {quoted(x)})" for p, x in PHRASES.items())}),
word AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
place AS (SELECT r, label, p FROM (SELECT r, ws, unnest(range(len(ws))) AS p FROM d), phrase WHERE array_to_string(ws[p + 1:p + len(string_split(phrase, ' '))], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
given(label, text) AS (VALUES {", ".join(f"({quoted(x)}, {quoted(t)})" for x, t in TEMPLATES.items())}),
sized AS (SELECT label, list_distinct(ws) AS own, len(list_distinct(ws)) AS size, (len(ws) * 100 + {THRESHOLD} - 1) // {THRESHOLD} AS span FROM (SELECT label, {_ASCII_WORDS} AS ws FROM given)),
tw AS (SELECT label, size, span, (size * {THRESHOLD} + 99) // 100 AS need, unnest(own) AS w FROM sized),
held AS (SELECT r, label, size, span, need, w, p FROM word JOIN tw USING (w)),
enough AS (SELECT r, label FROM held GROUP BY r, label, need HAVING count(DISTINCT w) >= need),
near AS (SELECT * FROM held SEMI JOIN enough USING (r, label)),
run AS (SELECT a.r, a.label, a.size, a.need, a.p, count(DISTINCT b.w) AS n FROM near a JOIN near b ON a.r = b.r AND a.label = b.label AND b.p >= a.p AND b.p < a.p + a.span GROUP BY ALL),
best AS (SELECT r, label, max(n) / any_value(size) AS containment FROM run GROUP BY r, label, need HAVING max(n) >= need),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM best UNION ALL SELECT r, label FROM place) GROUP BY r),
most AS (SELECT r, max(containment) AS containment FROM best GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN coalesce(n_base, 0) > 0 THEN 1 ELSE coalesce(containment, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN most USING (r)
"""

ORACLES = {
    "op1_minhash_near_dedup": OP1,
    "op3_secret_scan": OP3,
    "op6_winnowing_decontamination": OP6,
    "op7_chat_tool_linking": OP7,
    "op8_repetition_coverage": OP8,
    "op10_license_scan": OP10,
}

#: Words as in op13: ASCII letters in lower case, runs of digits, letters and all beyond ASCII.
_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 is a fold over the bytes of each different feature, by a table of the polynomial's 256 remainders.
ORACLES["op13_importance_resampling"] = f"""
WITH poly AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT {_PLAIN} AS w FROM benchmark),
df AS (SELECT r, unnest(w) AS f FROM d UNION ALL SELECT r, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM d WHERE len(w) > 1),
bf AS (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM b WHERE len(w) > 1),
fs AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
fb AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM fs, poly),
s AS (SELECT k, count(*) AS n FROM df JOIN fb USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bf JOIN fb USING (f) GROUP BY k),
g AS (SELECT i AS k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE)))::BIGINT AS gain FROM range(10000) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM df JOIN fb USING (f) JOIN g USING (k) GROUP BY r),
x AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT AS h FROM d LEFT JOIN m ON m.r = d.r),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS rank FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""
