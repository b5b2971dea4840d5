"""What nests: begin and end marks, intervals within intervals, trees out of levels and tags, paths in trees.

Three ways are used. Where marks of one kind pair, depths are prefix sums and partners are neighbours of one
depth: two windows over the same partitioning, one shuffle. Where a mark's effect depends on all that is open (levels,
tags that end others), rows are partitioned by their keys, sorted, and one pass keeps the open
ones in a stack, however long a key's run is. Where trees are given by parents, pointers
double: within a task for keys of few rows, by joins for the others, of which a chain of n steps takes log2(n).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgrid.stages import deleted, written


def pairs(marks: DataFrame, keys: Sequence[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """(keys, begin, end, depth): each end mark with the latest begin mark that is open; ``order`` values are theirs.

    Ends with nothing open and begins that are never ended pair with nothing; rows that are neither are
    passed over. Depth 1 is outermost.
    """
    step = F.when(opens, 1).when(closes, -1)
    m = marks.withColumn("_step", step).where("_step is not null").select(*keys, F.col(order).alias("_at"), "_step")
    run, sofar = Window.partitionBy(*keys).orderBy("_at"), Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_sum", F.sum("_step").over(sofar))
    # An end with nothing open takes the sum to a new least value; depths count from the least so far.
    m = m.withColumn("_floor", F.least(F.lit(0), F.min("_sum").over(sofar)))
    before = F.least(F.lit(0), F.lag("_floor", 1, 0).over(run))
    depth = F.when(F.col("_step") == 1, F.col("_sum") - F.col("_floor")).otherwise(F.col("_sum") + 1 - before)
    m = m.withColumn("depth", depth.cast("bigint")).where("depth > 0")
    level = Window.partitionBy(*keys, "depth").orderBy("_at")
    m = m.withColumns({"begin": F.lag("_at").over(level), "_last": F.lag("_step").over(level)})
    return m.where("_step = -1 and _last = 1").select(*keys, "begin", F.col("_at").alias("end"), "depth")


def _events(df: DataFrame, keys: Sequence[str], id_: str, start: str, end: str, asks: int) -> DataFrame:
    """Two rows an interval, in an order in which each is begun after, and ended before, what holds it."""
    base = df.select(*keys, F.col(id_).cast("bigint").alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(asks).alias("_asks"))
    empty = F.col("_s") >= F.col("_e")
    both = base.withColumn("_step", F.explode(F.array(F.lit(1), F.lit(-1))))
    on = F.col("_step") == 1
    return both.select(
        *keys, "_id", "_s", "_e", "_asks", "_step",
        F.when(on, F.col("_s")).otherwise(F.greatest("_s", "_e")).alias("_pos"),
        F.when(empty, 2).when(on, 1).otherwise(0).alias("_phase"),
        F.when(empty, F.lit(0)).when(on, -F.col("_e")).otherwise(-F.col("_s")).alias("_tie"),
        F.when(on | empty, F.col("_asks") * 2).otherwise(-F.col("_asks") * 2).alias("_side"),
        F.when(on | empty, F.col("_id")).otherwise(-F.col("_id")).alias("_by"),
        F.when(empty & ~on, 1).otherwise(0).alias("_last"),
    )


_ORDER = ("_pos", "_phase", "_tie", "_side", "_by", "_last")


def innermost(asked: DataFrame, intervals: DataFrame, keys: Sequence[str], id_: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """``asked`` (keys, id, start, end, ...) with ``inside``, the id of the innermost of ``intervals`` (keys, id, start, end) that holds it, and ``depth``, how many do.

    Both are half-open and nest: two of them are apart or one holds the other, equal ones hold each other
    by side (intervals hold what is asked) and then id; an empty one at another's start is in it, at its end
    it is not. Ids are whole numbers, one for each row of a key. No range join: starts and ends are put in one
    order, depths are prefix sums, and the innermost is the last one begun at that depth.
    """
    events = _events(intervals, keys, id_, start, end, 0).unionByName(_events(asked, keys, id_, start, end, 1).where("_step = 1"))
    sofar = Window.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.coalesce(F.sum(F.when(F.col("_asks") == 0, F.col("_step"))).over(sofar), F.lit(0))
    # What is asked and the interval begun last at its depth meet in one partition of keys and depth.
    events = events.withColumn("depth", depth.cast("bigint")).where("_step = 1")
    level = Window.partitionBy(*keys, "depth").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.when(F.col("depth") > 0, F.last(F.when(F.col("_asks") == 0, F.col("_id")), ignorenulls=True).over(level))
    found = events.withColumn("inside", inside).where("_asks = 1").select(*keys, F.col("_id").alias(id_), "inside", "depth")
    return asked.join(found, [*keys, id_], "left")


def holds_no_other(intervals: DataFrame, keys: Sequence[str], id_: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """Those of ``intervals`` (as for ``innermost``) that hold no other one: the next event after their begin is their end."""
    run = Window.partitionBy(*keys).orderBy(*_ORDER)
    events = _events(intervals, keys, id_, start, end, 0)
    events = events.withColumn("_next", F.lead(F.struct("_id", "_step")).over(run))
    leaves = events.where("_step = 1 and _next._id = _id and _next._step = -1").select(*keys, F.col("_id").alias(id_))
    return intervals.join(leaves, [*keys, id_], "left_semi")


# ---- passes over sorted rows --------------------------------------------------------------


def sorted_pass(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str], start: Callable[[], tuple[Callable, Callable]], schema: T.StructType) -> DataFrame:
    """One pass over the rows of each key in order: ``start()`` gives, for each key, (step, finish); both yield tuples that follow the keys' values in ``schema``.

    ``step`` gets the values of ``take``. A key's rows pass through one task without being held.
    """
    keys, take, names = list(keys), list(take), [f.name for f in schema.fields]
    arrow = [_arrow(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, finish = None, None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for key, values in zip(zip(*columns[: len(keys)]), zip(*columns[len(keys) :])):
                if key != now:
                    if now is not None:
                        out.extend(now + r for r in finish())
                    now, (step, finish) = key, start()
                out.extend(key + r for r in step(*values))
            yield _rows(out, names, arrow)
        if now is not None:
            yield _rows([now + r for r in finish()], names, arrow)

    met = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *take)
    return met.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _new_keys(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether each row's key differs from the one before; nulls are alike, the first row is new."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        a, b = c[1:], c[:-1]
        if pa.types.is_nested(c.type):
            new[1:] |= np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
        else:
            apart = pc.fill_null(pc.not_equal(a, b), False)
            new[1:] |= pc.or_(apart, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def _earlier_smaller(levels: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The nearest earlier place of the same run with a smaller level, -1 where none; runs begin where ``new``.

    Minima of 2, 4, 8... neighbours tell how far back all levels are not smaller, by halving steps.
    """
    n = len(levels)
    places = np.arange(n)
    first = np.maximum.accumulate(np.where(new, places, 0))
    least, width, longest = [levels], 1, int((places - first).max(initial=0)) + 1
    while width * 2 <= longest:
        least.append(np.minimum(least[-1][:-width], least[-1][width:]))
        width *= 2
    at = places
    for m in reversed(least):
        to = at - width
        ok = np.nonzero(to >= first)[0]
        ok = ok[m[to[ok]] >= levels[ok]]
        at = at.copy()
        at[ok] = to[ok]
        width //= 2
    return np.where(at > first, at - 1, -1)


def level_parents(df: DataFrame, keys: Sequence[str], order: str, level: str) -> DataFrame:
    """df with ``parent``: the ``order`` of the nearest earlier row of the key with a smaller level, whatever the levels.

    Levels are whole numbers. Rows without a level have no parent and are nobody's. The result's partitions hold their keys whole, one after the other.
    """
    keys = list(keys)
    n_keys = len(keys)
    fields = [df.schema[c] for c in (*keys, order, level, *(c for c in df.columns if c not in (*keys, order, level)))]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("parent", df.schema[order].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last key that may yet be a parent: of rising levels, the last of each.
        open_: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            with_level = pc.indices_nonzero(batch.column(n_keys + 1).is_valid())
            held = batch.select(range(n_keys + 2)).take(with_level)
            met = pa.Table.from_batches([held]) if open_ is None else pa.concat_tables([open_, pa.Table.from_batches([held])])
            met = met.combine_chunks()
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in met.columns]
            before = len(met) - len(held)
            parent = pa.nulls(batch.num_rows, batch.column(n_keys).type)
            if len(met):
                new, levels = _new_keys(columns[:n_keys]), columns[n_keys + 1].to_numpy(zero_copy_only=False)
                up = _earlier_smaller(levels, new)[before:]
                full = np.full(batch.num_rows, -1)
                full[with_level.to_numpy(zero_copy_only=False)] = up
                parent = columns[n_keys].take(pa.array(full, mask=full < 0))
                last = int(np.nonzero(new)[0][-1])
                tail = levels[last:]
                after = np.minimum.accumulate(tail[::-1])[::-1]
                open_ = met.take(last + np.nonzero(np.append(tail[:-1] < after[1:], True))[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, parent], names=schema.names)

    met = df.repartition(*keys).sortWithinPartitions(*keys, order).select(*(f.name for f in fields))
    return met.mapInArrow(run, schema).select(*df.columns, "parent")


#: Tags that make a tree; all others are content. Fixed values.
TREE_TAGS = ("div", "p", "span", "a", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "br", "b", "strong", "i", "em", "u", "sub", "sup", "font", "h1", "h2", "h3", "h4", "h5", "h6", "img")
#: A tag that begins ends these where they are innermost: once, or as long as one is. Fixed values.
ENDS_ONE = {t: (t,) for t in ("td", "th", "li", "p")}
ENDS_ALL = {"tr": ("td", "th", "tr")}


def markup_tokens(pages: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, node, name, what, start, stop) of each tag of TREE_TAGS: its number among all tokens, 'open', 'close' or 'single', and where it stands.

    Tokens cover the text: comments, tags, text between, and lone signs, so offsets are prefix sums of lengths.
    """
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"(?s)(<!--.*?-->|<[^<>]*>|[^<]+|<)"), 1)
    token = pages.select(*keys, F.posexplode(tokens).alias("node", "token"))
    place = Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.length("token")).over(place).cast("bigint")
    tag = r"(?s)^<(/?)\s*([A-Za-z][\w:.-]*)(.*?)(/?)>$"
    token = token.withColumn("stop", stop).where(F.col("token").rlike(r"^<[^!]"))
    part = lambda i: F.regexp_extract("token", tag, i)
    token = token.withColumns({"name": F.lower(part(2)), "_close": part(1) == "/", "_slash": part(4) == "/"})
    token = token.where(F.col("name").isin(*TREE_TAGS) & ((F.col("name") != "img") | F.contains("token", F.lit("src="))))
    what = F.when(F.col("name") == "br", "single").when(F.col("_close"), "close").when(F.col("_slash") | (F.col("name") == "img"), "single").otherwise("open")
    return token.select(*keys, F.col("node").cast("bigint").alias("node"), "name", what.alias("what"), (F.col("stop") - F.length("token")).alias("start"), "stop")


def markup_tree(tokens: DataFrame, keys: Sequence[str], end: str | None = None) -> DataFrame:
    """(keys, node, name, parent, start, end) of each element of ``markup_tokens``; parents are nodes, null at the top.

    A close tag ends the latest open element of its name and all within it, and is passed over where there is none; some tags
    end others as they begin; what is open at last ends at ``end`` (a column of tokens), or nowhere (null).
    """

    def start() -> tuple[Callable, Callable]:
        open_: list[tuple[int, str, int | None, int]] = []
        final: list[int | None] = [None]

        def pop(at: int) -> tuple:
            node, name, parent, begun = open_.pop()
            return (node, name, parent, begun, at)

        def step(node: int, name: str, what: str, begun: int, stop: int, last: int | None) -> list[tuple]:
            final[0] = last
            out: list[tuple] = []
            if what == "close":
                if any(x[1] == name for x in open_):
                    while open_[-1][1] != name:
                        out.append(pop(begun))
                    out.append(pop(stop))
                return out
            if what == "open":
                if open_ and open_[-1][1] in ENDS_ONE.get(name, ()):
                    out.append(pop(begun))
                while open_ and open_[-1][1] in ENDS_ALL.get(name, ()):
                    out.append(pop(begun))
            parent = open_[-1][0] if open_ else None
            if what == "open":
                open_.append((node, name, parent, begun))
            else:
                out.append((node, name, parent, begun, stop))
            return out

        return step, lambda: [pop(final[0]) for _ in range(len(open_))]

    kinds = [T.StructField(k, tokens.schema[k].dataType) for k in keys]
    schema = T.StructType([*kinds, T.StructField("node", T.LongType()), T.StructField("name", T.StringType()), T.StructField("parent", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    last = (F.col(end) if end else F.lit(None)).cast("bigint")
    return sorted_pass(tokens.withColumn("_end", last), keys, ["node"], ["node", "name", "what", "start", "stop", "_end"], start, schema)


# ---- trees by parents ---------------------------------------------------------------------


#: Keys of at most this many rows are climbed within a task; a batch's paths then hold at most half as many nodes a row.
TOGETHER = 1024


def climbed(tree: DataFrame, keys: Sequence[str], node: str = "node", parent: str = "parent", kind: Column | None = None, paths: bool = False, together: int = TOGETHER, grouped: bool = False) -> DataFrame:
    """``tree`` with ``depth`` (0 at a root) and ``root``; with ``nearest``, the nearest proper ancestor for which ``kind`` holds; with ``path``, the nodes from the root to the row's own.

    Pointers double: each round adds to what a row has climbed what the row it has come to has climbed. Keys of at most ``together`` rows
    are climbed in one pass over partitions sorted by key (``grouped``: each partition of ``tree`` already holds its keys whole, one after the
    other, as ``level_parents`` gives them), larger ones by joins, log2(n) + 1 rounds for a chain of n. A parent
    that is no node counts as none. In a cycle depth, root, nearest and path are null.
    """
    keys = list(keys)
    kinds = tree.schema[node].dataType, tree.schema[parent].dataType
    if not together or kinds[0] != kinds[1] or not (isinstance(kinds[0], T.IntegralType) or kinds[0] == T.StringType()):
        return _climbed_by_joins(tree, keys, node, parent, kind, paths)
    more = ["depth", "root", *(["nearest"] if kind is not None else []), *(["path"] if paths else [])]
    types = {"depth": T.LongType(), "root": kinds[0], "nearest": kinds[0], "path": T.ArrayType(kinds[0])}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in tree.schema.fields] + [T.StructField(c, types[c]) for c in more] + [T.StructField("_done", T.BooleanType())])
    arrow = {c: _arrow(types[c]) for c in more}
    columns = tree.columns
    at = [columns.index(k) for k in keys], columns.index(node), columns.index(parent)

    def climb(rows: pa.Table, whole: bool) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        cells = [c.chunk(0) for c in rows.columns]
        if whole:
            got = _climbed_in_memory([cells[i] for i in at[0]], cells[at[1]], cells[at[2]], cells[-1].to_numpy(zero_copy_only=False), paths, together)
        else:
            got = {c: pa.nulls(len(rows), arrow[c]) for c in more} | {"_done": pa.array(np.zeros(len(rows), bool))}
        return pa.RecordBatch.from_arrays([*cells[:-1], *(got[c].cast(arrow[c]) for c in more), got["_done"]], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: rows of the last key so far, kept until it ends or proves to be large.
        held, large = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            starts = np.nonzero(_new_keys([rows.column(i).combine_chunks() if rows.column(i).num_chunks == 1 else pa.concat_arrays(rows.column(i).chunks) for i in at[0]]))[0]
            # Of a large key one row stays, by which its next rows are known.
            begin = 0
            if large:
                end = int(starts[1]) if len(starts) > 1 else len(rows) - 1
                yield from [climb(rows.slice(0, end), False)] if end else []
                large, begin = len(starts) == 1, end
            if large:
                held = rows.slice(begin)
                continue
            last = max(int(starts[-1]), begin)
            if last > begin:
                yield climb(rows.slice(begin, last - begin), True)
            held = rows.slice(last)
            if len(held) > together:
                yield climb(held.slice(0, len(held) - 1), False)
                held, large = held.slice(len(held) - 1), True
        if held is not None:
            yield climb(held, not large)

    holds = F.coalesce(kind, F.lit(False)) if kind is not None else F.lit(False)
    met = tree.select(*columns, holds.alias("_k"))
    met = met if grouped else met.repartition(*keys).sortWithinPartitions(*keys)
    passed = written(met.mapInArrow(run, schema), "climbed")
    left = passed.where("not _done").select(*columns)
    done = passed.where("_done").drop("_done")
    return done if left.isEmpty() else done.unionByName(_climbed_by_joins(left, keys, node, parent, kind, paths))


def _climbed_in_memory(keys: list[pa.Array], node: pa.Array, parent: pa.Array, kind: np.ndarray, paths: bool, most: int) -> dict[str, pa.Array]:
    """depth, root, nearest, path of rows whose keys stand one after the other; ``_done`` is false for keys of more than ``most`` rows, null ones and those with null or repeated nodes."""
    n = len(node)
    new = _new_keys(keys)
    run = np.cumsum(new) - 1
    bad = np.bincount(run) > most
    for c in (*keys, node):
        bad[run[c.is_null().to_numpy(zero_copy_only=False)]] = True
    both = pa.concat_arrays([node, parent]).dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(both.dictionary) + 1
    mine, theirs = run * size + codes[:n] + 1, run * size + codes[n:] + 1
    order = np.argsort(mine, kind="stable")
    mine = mine[order]
    bad[run[order[1:][mine[1:] == mine[:-1]]]] = True
    place = np.minimum(np.searchsorted(mine, theirs), n - 1)
    up = np.where((codes[n:] >= 0) & (mine[place] == theirs) & ~bad[run], order[place], -1)
    own = np.arange(n)
    at, top, depth = up, np.where(up >= 0, up, own), (up >= 0).astype(np.int64)
    near = np.where((up >= 0) & kind[up], up, -1)
    reach = 1
    while reach <= most and (at >= 0).any():
        m = np.nonzero(at >= 0)[0]
        a = at[m]
        on, root, steps, seen = at[a], top[a], depth[a], near[a]
        at, top, depth, near = at.copy(), top.copy(), depth.copy(), near.copy()
        at[m], top[m] = on, root
        depth[m] += steps
        near[m] = np.where(near[m] >= 0, near[m], seen)
        reach *= 2
    none = (at >= 0) | bad[run]  # still climbing after more steps than rows: a cycle
    out = {"depth": pa.array(depth, mask=none), "root": node.take(pa.array(top, mask=none)), "nearest": node.take(pa.array(near, mask=none | (near < 0)))}
    if paths:
        offsets = np.append(0, np.cumsum(np.where(none, 0, depth + 1)))
        cells, rows, end = np.empty(offsets[-1], np.int64), own[~none], offsets[1:][~none] - 1
        while len(rows):
            cells[end] = rows
            on = up[rows]
            end, rows = end[on >= 0] - 1, on[on >= 0]
        out["path"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(none, False)), node.take(pa.array(cells)))
    return out | {"_done": pa.array(~bad[run])}


def _climbed_by_joins(tree: DataFrame, keys: list[str], node: str, parent: str, kind: Column | None, paths: bool) -> DataFrame:
    """``climbed`` by rounds of joins, however many rows a key has; rows that have passed their root leave them."""
    holds = F.coalesce(kind, F.lit(False)) if kind is not None else F.lit(False)
    rows = tree.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_p"), holds.alias("_k"))
    up = rows.select(*keys, F.col("_n").alias("_p"), F.lit(True).alias("_is"), F.col("_k").alias("_pk"))
    first = rows.join(up, [*keys, "_p"], "left")
    found = F.col("_is").isNotNull()
    # _at: where the climb stands (null past the root); _top: the last node met; _d: steps; _near: nearest of the kind met; _way: nodes met, nearest first.
    first = first.select(*keys, "_n", F.when(found, F.col("_p")).alias("_at"), F.when(found, F.col("_p")).otherwise(F.col("_n")).alias("_top"), found.cast("bigint").alias("_d"), F.when(F.col("_pk"), F.col("_p")).alias("_near"), *([F.when(found, F.array("_p")).otherwise(F.array().cast(T.ArrayType(tree.schema[node].dataType))).alias("_way")] if paths else []))
    state = written(first, "climb")
    most = state.count()
    done: list[DataFrame] = []
    states, reach = [state], 1
    while True:
        done.append(state.where("_at is null"))
        moving = state.where("_at is not null")
        if moving.isEmpty():
            break
        if reach > most:  # more steps than rows: a cycle
            none = {c: F.lit(None).cast(state.schema[c].dataType) for c in ("_top", "_d", "_near", *(["_way"] if paths else []))}
            done.append(moving.withColumns(none))
            break
        ahead = _all(done).unionByName(moving).select(*keys, F.col("_n").alias("_at"), F.col("_at").alias("_at2"), F.col("_top").alias("_top2"), F.col("_d").alias("_d2"), F.col("_near").alias("_near2"), *([F.col("_way").alias("_way2")] if paths else []))
        both = moving.join(ahead, [*keys, "_at"])
        state = written(both.select(*keys, "_n", F.col("_at2").alias("_at"), F.col("_top2").alias("_top"), (F.col("_d") + F.col("_d2")).alias("_d"), F.coalesce("_near", "_near2").alias("_near"), *([F.concat("_way", "_way2").alias("_way")] if paths else [])), "climb")
        states.append(state)
        reach *= 2
    end = written(_all(done), "climbed")
    deleted(*states)
    more = [F.col("_d").alias("depth"), F.col("_top").alias("root")]
    more += [F.col("_near").alias("nearest")] if kind is not None else []
    more += [F.concat(F.reverse("_way"), F.array("_n")).alias("path")] if paths else []
    return tree.join(end.select(*keys, F.col("_n").alias(node), *more), [*keys, node], "left")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
