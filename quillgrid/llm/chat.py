"""Chat formatting with tool-call linking.

An assistant text that is a JSON object with "tool_calls" ({"id", "name", "arguments"})
holds calls; a text of role "tool" that is an object with "tool_call_id" is a result.
Calls and results are linked by a hash join on (conv_id, call id). A call may refer to
another's result by {"$ref": id} inside its arguments; calls are levelled by repeated
joins (no conversation is gathered anywhere), so that (stage, depth, turn, ord, kind)
is a topological order: a result follows its call, a call follows the results it uses.
Arguments are checked against the schema of the tool's name, and every message, call
and result is serialised as canonical JSON (sorted keys, no blanks, UTF-8).

Problems, listed by name: bad_call (no id or name), duplicate_call (an id used before in
the conversation; the first by turn and place is linked), duplicate_result, no_result,
no_call, no_tool (no schema of that name), bad_arguments, cycle (also: refers to nothing).

Defined results: texts that are no such JSON (NaN, Infinity and numbers out of a double's range
are none), or are nested too deeply to be read, are plain messages; a {"$ref": id} fits every schema, as its
value is not known; arguments given as JSON text are read, "{}" as no arguments; fields besides those named here stay in the JSON; null texts and roles are
JSON null; a null conv_id links with nothing; repeated rows give repeated messages, and
calls or results of a repeated row are duplicates; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.scratch import discard, settle

KINDS = {"message": 0, "call": 1, "result": 2}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """Sorted keys, no blanks; a lone surrogate, which UTF-8 does not have, stays an escape."""
    return sound(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def sound(text: str) -> str:
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES.get(kind, object))


def fits(value: object, schema: object) -> bool:
    """Whether a value meets a JSON schema: type, enum, const, bounds, pattern, lengths, required, properties, additionalProperties, items, anyOf, allOf, oneOf."""
    if not isinstance(schema, dict):
        return schema is not False
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return True
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return False
    if any(k in schema and canonical(value) not in map(canonical, schema[k] if k == "enum" else [schema[k]]) for k in ("enum", "const")):
        return False
    of = {k: [fits(value, x) for x in schema[k]] for k in ("anyOf", "allOf", "oneOf") if k in schema}
    if not any(of.get("anyOf", [True])) or not all(of.get("allOf", [])) or sum(of.get("oneOf", [True])) != 1:
        return False
    if _is(value, "number"):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) and re.search(schema.get("pattern", ""), value) is not None
    if isinstance(value, dict):
        own, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        return all(k in value for k in schema.get("required", [])) and all(fits(v, own.get(k, others)) for k, v in value.items())
    return all(fits(v, schema.get("items", True)) for v in value) if isinstance(value, list) else True


def references(value: object) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            yield value["$ref"]
        else:
            for v in value.values():
                yield from references(v)
    elif isinstance(value, list):
        for v in value:
            yield from references(v)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError(f"{digits} is out of range")
    return value


def _object(text: str | None) -> dict | None:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        got = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(ord, kind, call id, canonical JSON, ids referred to, problems) of a turn."""
    got = _object(text)
    try:
        if role == "tool" and got is not None and isinstance(got.get("tool_call_id"), str):
            return [(0, "result", sound(got["tool_call_id"]), canonical({"content": None} | got | {"role": "tool"}), [], [])]
        if role == "assistant" and got is not None and isinstance(got.get("tool_calls"), list):
            said = {"content": None} | {k: v for k, v in got.items() if k != "tool_calls"} | {"role": role}
            return [(0, "message", None, canonical(said), [], []), *(_call(i, c, schemas) for i, c in enumerate(got["tool_calls"], 1))]
    except RecursionError:  # nested too deeply to be walked: a plain message
        pass
    return [(0, "message", None, canonical({"content": text, "role": role}), [], [])]


def _call(i: int, call: object, schemas: dict[str, dict]) -> tuple:
    """A call with all its fields; name and arguments may stand in a "function", arguments may be JSON text."""
    call = dict(call) if isinstance(call, dict) else {}
    if isinstance(call.get("function"), dict):
        call = {k: v for k, v in call.items() if k != "function"} | call["function"]
    if isinstance(call.get("arguments"), str):
        read = _object(call["arguments"])
        call["arguments"] = call["arguments"] if read is None else read
    call = {"arguments": {}, "id": None, "name": None} | call | {"type": "call"}
    name, id_, arguments = call["name"], call["id"], call["arguments"]
    problems = []
    if not isinstance(name, str) or not isinstance(id_, str):
        problems.append("bad_call")
    elif name not in schemas:
        problems.append("no_tool")
    elif not fits(arguments, schemas[name]):
        problems.append("bad_arguments")
    needs = sorted({sound(r) for r in references(arguments)})
    return (i, "call", sound(id_) if isinstance(id_, str) else None, canonical(call), needs, problems)


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, stage, depth) of ``calls`` (conv_id, call_id, turn, needs), those in cycles left out."""
    done = settle(calls.where(F.size("needs") == 0).select("conv_id", "call_id", F.col("turn").alias("stage"), F.lit(0).alias("depth")), "levels")
    edges = settle(calls.where(F.size("needs") > 0).select("conv_id", "call_id", "turn", F.explode("needs").alias("need")), "needs")
    while not edges.isEmpty():
        have = edges.join(done.select("conv_id", F.col("call_id").alias("need"), "stage", "depth"), ["conv_id", "need"], "left")
        ready = have.groupBy("conv_id", "call_id", "turn").agg(F.count(F.when(F.col("stage").isNull(), 1)).alias("open"), F.max("stage").alias("s"), F.max("depth").alias("d"))
        new = settle(ready.where("open = 0").select("conv_id", "call_id", F.greatest("s", "turn").alias("stage"), (F.col("d") + 1).alias("depth")), "levels")
        if new.isEmpty():
            break
        left = settle(edges.join(new.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "needs")
        both = settle(done.unionByName(new), "levels")
        discard(edges, new, done)
        edges, done = left, both
    return done


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, stage, depth, turn, ord, kind, call_id, json, problems array<string>) of ``conversations`` (conv_id, turn, role, text, ...)."""
    schemas = schemas or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for r in parse(role, text, schemas):
                    at.append(i)
                    rows.append(r)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            where = pa.array(at, pa.int64())
            texts = pa.list_(pa.string())
            yield pa.record_batch([batch.column(0).take(where), batch.column(1).take(where), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:4]), pa.array(cols[4], texts), pa.array(cols[5], texts)], names=["conv_id", "turn", "ord", "kind", "call_id", "json", "needs", "problems"])

    given = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = settle(given.mapInArrow(run, "conv_id bigint, turn bigint, ord int, kind string, call_id string, json string, needs array<string>, problems array<string>"), "chat")
    plain = parts.where("kind = 'message' or call_id is null or conv_id is null").select("conv_id", F.col("turn").alias("stage"), F.lit(0).alias("depth"), "turn", "ord", "kind", "call_id", "json", "problems")
    linked = parts.where("kind <> 'message' and call_id is not null and conv_id is not null")
    if linked.isEmpty():
        return plain
    # The first of each id, by turn and place; a window over one id, not over a conversation.
    first = Window.partitionBy("conv_id", "call_id", "kind").orderBy("turn", "ord", "json")
    ranked = settle(linked.withColumn("again", F.row_number().over(first) > 1), "linked")
    calls = ranked.where("kind = 'call' and not again")
    results = ranked.where("kind = 'result' and not again")
    level = _levels(calls)
    link = calls.select("conv_id", "call_id", F.col("turn").alias("call_turn"), F.col("ord").alias("call_ord")).join(results.select("conv_id", "call_id", F.lit(True).alias("answered")), ["conv_id", "call_id"], "full").join(level, ["conv_id", "call_id"], "left")
    got = ranked.join(link, ["conv_id", "call_id"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    found = F.array_compact(F.array(F.when(call & F.col("again"), F.lit("duplicate_call")), F.when(result & F.col("again"), F.lit("duplicate_result")), F.when(call & F.col("answered").isNull(), F.lit("no_result")), F.when(result & F.col("call_turn").isNull(), F.lit("no_call")), F.when(F.col("call_turn").isNotNull() & F.col("stage").isNull(), F.lit("cycle"))))
    by_call = result & F.col("call_turn").isNotNull()
    stage = F.when(F.col("again") | F.col("stage").isNull(), F.col("turn")).otherwise(F.col("stage"))
    placed = got.select("conv_id", stage.alias("stage"), F.coalesce("depth", F.lit(0)).alias("depth"), F.when(by_call, F.col("call_turn")).otherwise(F.col("turn")).alias("turn"), F.when(by_call, F.col("call_ord")).otherwise(F.col("ord")).alias("ord"), "kind", "call_id", "json", F.array_sort(F.concat("problems", found)).alias("problems"))
    return plain.unionByName(placed)
