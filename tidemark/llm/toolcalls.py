"""Tool-call linking: calls and results joined by identifier, ordered, validated, and written as canonical JSON.

Calls and results meet in a shuffled hash join on (conversation, identifier). Of several results for one call the last
one by turn counts, the others are counted. A call depends on the calls that its ``needs`` names, of whichever turn.
Its level is the longest chain of needs below it, and a conversation's calls are in topological order by level, then
turn, then identifier. A conversation of up to ``SMALL`` calls is ordered by one task, from identifiers and needs
alone; a larger one by rounds of joins, one for each level, so that none has to fit in memory. Calls on a cycle, or
after one, have no level and follow the others.

Arguments are JSON text, validated against the tool's schema (type, required, properties, additionalProperties,
items, enum, minLength, maxLength, minimum, maximum). Canonical JSON has sorted keys, no blanks, and no ASCII
escapes but those needed; a lone surrogate, which UTF-8 can't hold, is escaped. ``NaN`` and ``Infinity`` are not JSON.

Defined cases: rows without a conversation or identifier are not linked and are left out of calls; results
without a call have status ``orphan``; calls without a result ``open``. Repeated call rows: the one of the
lowest turn (then of the least text) stays. Null or empty arguments are not JSON and so invalid. An unknown tool
is invalid. A need that names no call of the conversation, or null, is ignored. A call without a turn is ordered by
its needs like any other, and before those of its level with one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SMALL = 200_000


def canonical(value: Any) -> str:
    return _encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _encodable(text: str) -> str:
    return text.encode("utf-8", "backslashreplace").decode()


def _parse(text: str) -> Any:
    def no_constant(name: str) -> Any:
        raise ValueError(name)

    return json.loads(text, parse_constant=no_constant)


def _is(kind: str, x: Any) -> bool:
    number = isinstance(x, int | float) and not isinstance(x, bool)
    return {"object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None, "number": number, "integer": number and (isinstance(x, int) or x.is_integer())}.get(kind, False)


def problem(schema: dict, x: Any, at: str = "$") -> str | None:
    """The first fault of a value against a schema, or None."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(k, x) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"
    if "enum" in schema and x not in schema["enum"]:
        return f"{at}: not one of the values"
    if isinstance(x, str):
        if len(x) < schema.get("minLength", 0) or len(x) > schema.get("maxLength", math.inf):
            return f"{at}: length {len(x)}"
    elif isinstance(x, int | float) and not isinstance(x, bool):
        if not schema.get("minimum", -math.inf) <= x <= schema.get("maximum", math.inf):
            return f"{at}: out of range"
    elif isinstance(x, list):
        for i, y in enumerate(x):
            if "items" in schema and (found := problem(schema["items"], y, f"{at}[{i}]")):
                return found
    elif isinstance(x, dict):
        for name in schema.get("required", []):
            if name not in x:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(x):
            rule = known.get(name, schema.get("additionalProperties", True))
            if rule is False:
                return f"{at}.{name}: not allowed"
            if isinstance(rule, dict) and (found := problem(rule, x[name], f"{at}.{name}")):
                return found
    return None


def levels(needs: dict[str, list[str]]) -> dict[str, int]:
    """For each call, the longest chain of needs below it; calls on a cycle or after one are left out."""
    todo = {k: {x for x in v if x in needs} for k, v in needs.items()}
    after: dict[str, list[str]] = {}
    for k, v in todo.items():
        for x in v:
            after.setdefault(x, []).append(k)
    out = {k: 0 for k, v in todo.items() if not v}
    front = list(out)
    while front:
        new = []
        for k in front:
            for y in after.get(k, ()):
                out[y] = max(out.get(y, 0), out[k] + 1)
                todo[y].discard(k)
                if not todo[y]:
                    new.append(y)
        front = new
    return {k: v for k, v in out.items() if not todo[k]}


def _checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Add ``problem`` and ``canonical`` to linked calls."""

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                faults, texts = [], []
                for x in part.to_pylist():
                    try:
                        arguments, fault = _parse(x["arguments"] or ""), None
                    except (ValueError, RecursionError):
                        arguments, fault = x["arguments"], "$: not JSON"
                    if fault is None:
                        fault = problem(schemas[x["name"]], arguments) if x["name"] in schemas else "$: unknown tool"
                    try:
                        result = _parse(x["result"]) if x["result"] is not None else None
                    except (ValueError, RecursionError):
                        result = x["result"]
                    faults.append(fault and _encodable(fault))
                    texts.append(canonical({"arguments": arguments, "id": x["call_id"], "name": x["name"], "needs": sorted(y for y in x["needs"] or [] if y is not None), "result": result}))
                keep = part.drop_columns(["arguments", "result"])
                yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(faults, pa.string()), pa.array(texts, pa.string())], [*keep.schema.names, "problem", "canonical"])

    kept = [f for f in calls.schema.fields if f.name not in ("arguments", "result")]
    return calls.mapInArrow(serialise, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", problem string, canonical string")


def _levelled(calls: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, level): null for calls on or after a cycle. ``calls``: conv_id, call_id, turn, needs."""
    mixed = calls.select("conv_id", "call_id", "needs")
    big = common.cut(mixed.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("conv_id"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = levels({x["call_id"]: x["needs"] or [] for x in rows})
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(rows), pa.int64()), pa.array([x["call_id"] for x in rows], pa.string()), pa.array([found.get(x["call_id"]) for x in rows], pa.int32())], ["conv_id", "call_id", "level"])

    small = mixed.join(big, "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "needs")).alias("calls"))
    out = small.mapInArrow(order, "conv_id long, call_id string, level int")
    if big.limit(1).count():
        large = common.cut(mixed.join(big, "conv_id", "left_semi"))
        ids = large.select("conv_id", F.col("call_id").alias("need"))
        tables = common.Tables(calls.sparkSession)
        waits = tables.cut(large.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need")).join(ids, ["conv_id", "need"], "left_semi"))
        left, level = tables.cut(large.select("conv_id", "call_id")), 0
        while True:
            free = common.cut(left.join(waits, ["conv_id", "call_id"], "left_anti"))
            if not free.limit(1).count():
                out = out.unionByName(left.withColumn("level", F.lit(None).cast("int")))
                break
            out = out.unionByName(free.withColumn("level", F.lit(level)))
            before = (left, waits)
            left = tables.cut(left.join(free, ["conv_id", "call_id"], "left_anti"))
            waits = tables.cut(waits.join(free.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"))
            tables.drop(*before)
            level += 1
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls (conv_id long, call_id string, turn long, name, arguments, needs array<string>) with results (conv_id, call_id, turn, result).

    Rows (conv_id, call_id, turn, level, place, status, n_results, result_turn, problem, canonical); orphans have
    only their identifiers, status, number and turn. ``place``: from 1, in the conversation.
    """
    some = "conv_id is not null and call_id is not null"
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "needs").where(some)
    calls = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("c")).select("conv_id", "call_id", "c.*")
    got = results.where(some).groupBy("conv_id", "call_id").agg(F.max(F.struct("turn", "result")).alias("r"), F.count("*").alias("n_results"))
    got = got.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.result").alias("result"), "n_results")
    calls = common.cut(calls)
    both = calls.withColumn("called", F.lit(True)).join(got.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")
    both = both.select("conv_id", "call_id", "turn", "name", "arguments", "needs", "result", "result_turn", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.when(F.col("called").isNull(), "orphan").when(F.col("n_results").isNull(), "open").otherwise("linked").alias("status"))
    orphans = both.where("status = 'orphan'").select("conv_id", "call_id", "turn", "n_results", "result_turn", "status", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("long").alias("place"))
    # places are found on identifiers alone, so that texts move once, to the join with their results
    ids = calls.select("conv_id", "call_id", "turn").join(_levelled(calls), ["conv_id", "call_id"])
    # runs of turns are counted first, so that one long conversation is not one task's sort
    ids = ids.withColumn("run", F.floor(F.coalesce("turn", F.lit(0)) / RUN)).withColumn("sort", F.coalesce("level", F.lit((1 << 31) - 1)))
    before = ids.groupBy("conv_id", "sort", "run").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("sort", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = ids.join(before, ["conv_id", "sort", "run"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("conv_id", "sort", "run").orderBy("turn", "call_id")))
    done = _checked(both.where("status <> 'orphan'").join(placed.select("conv_id", "call_id", "level", "place"), ["conv_id", "call_id"]), schemas)
    columns = ("conv_id", "call_id", "turn", "level", "place", "status", "n_results", "result_turn", "problem", "canonical")
    return done.select(*columns).unionByName(orphans.select(*columns))


#: Turns that are counted together for places.
RUN = 256

#: The tool of the query: what a turn asks, and how many characters at most.
MOST_CHARS = 300
REPLY = {"reply": {"type": "object", "required": ["prompt", "role"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": MOST_CHARS}, "role": {"enum": ["system", "user"]}, "turn": {"type": "integer", "minimum": 0}}}}
#: In one of so many conversations and turns a call needs the one two turns on; in one of so many conversations that one needs it too.
FORWARD, CYCLE = 5, 7


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool traffic: every turn but the assistant's calls ``reply``; an assistant's turn is the result of the call before it.

    Identifiers are turns. A call needs those of the two turns before. Where (conversation + turn) is divisible by
    ``FORWARD`` it needs the call of two turns on instead, which then doesn't need it, but in conversations divisible
    by ``CYCLE``, where the two are a cycle.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    forward = lambda turn: F.pmod(F.col("conv_id") + turn, F.lit(FORWARD)) == 0
    cycles = F.pmod(F.col("conv_id"), F.lit(CYCLE)) == 0
    back = lambda k: F.when(~forward(F.col("turn") - k) | cycles, name(F.col("turn") - k))
    needs = F.when(forward(F.col("turn")), F.array(name(F.col("turn") + 2))).otherwise(F.array_compact(F.array(back(1), back(2))))
    calls = rows.where("role is null or role <> 'assistant'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "role", "turn")).alias("arguments"), needs.alias("needs"))
    results = rows.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.to_json(F.struct(F.col("text").alias("reply"))).alias("result"))
    return calls, results


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as tool calls, linked to their replies."""
    return link(*as_calls(common.table(spark, sf_dir, "conversations")), REPLY)


#: The same for conversations of turns that occur once; levels are lengths of the longest walks, endless ones being on or after cycles.
SQL = f"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 't' || turn AS call_id, text, role,
    CASE WHEN (conv_id + turn) % {FORWARD} = 0 THEN ['t' || (turn + 2)]
      ELSE list_filter([CASE WHEN (conv_id + turn - 1) % {FORWARD} <> 0 OR conv_id % {CYCLE} = 0 THEN 't' || (turn - 1) END,
        CASE WHEN (conv_id + turn - 2) % {FORWARD} <> 0 OR conv_id % {CYCLE} = 0 THEN 't' || (turn - 2) END], lambda x: x IS NOT NULL) END AS needs
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS DISTINCT FROM 'assistant'
), results AS (
  SELECT conv_id, 't' || (turn - 1) AS call_id, max(turn) AS result_turn, count(*) AS n_results, arg_max(text, turn) AS reply
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role = 'assistant' GROUP BY ALL
), edges AS (
  SELECT DISTINCT c.conv_id, c.call_id, n.need FROM calls c, unnest(c.needs) AS n(need) JOIN calls d ON d.conv_id = c.conv_id AND d.call_id = n.need
), sizes AS (SELECT conv_id, count(*) AS n FROM calls GROUP BY conv_id),
walks AS (
  SELECT conv_id, call_id, 0 AS depth FROM calls
  UNION SELECT e.conv_id, e.call_id, w.depth + 1 FROM walks w JOIN edges e ON e.conv_id = w.conv_id AND e.need = w.call_id JOIN sizes s ON s.conv_id = w.conv_id WHERE w.depth < s.n
), levels AS (
  SELECT w.conv_id, w.call_id, CASE WHEN max(w.depth) < any_value(s.n) THEN CAST(max(w.depth) AS INTEGER) END AS level
  FROM walks w JOIN sizes s ON s.conv_id = w.conv_id GROUP BY w.conv_id, w.call_id
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, l.level,
  CASE WHEN c.conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY c.conv_id ORDER BY l.level NULLS LAST, c.turn, c.call_id) END AS place,
  CASE WHEN c.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'open' ELSE 'linked' END AS status,
  coalesce(r.n_results, 0) AS n_results, r.result_turn,
  CASE WHEN c.conv_id IS NULL THEN NULL WHEN text IS NULL THEN '$.prompt: missing' WHEN role IS NULL THEN '$.role: missing'
    WHEN length(text) < 1 OR length(text) > {MOST_CHARS} THEN '$.prompt: length ' || length(text) WHEN role NOT IN ('system', 'user') THEN '$.role: not one of the values'
    WHEN c.turn < 0 THEN '$.turn: out of range' END AS problem,
  CASE WHEN c.conv_id IS NOT NULL THEN '{{"arguments":{{' || CASE WHEN text IS NOT NULL THEN '"prompt":' || to_json(text) || ',' ELSE '' END
    || CASE WHEN role IS NOT NULL THEN '"role":' || to_json(role) || ',' ELSE '' END || '"turn":' || c.turn || '}},"id":"' || c.call_id || '","name":"reply","needs":'
    || CAST(to_json(list_sort(needs)) AS VARCHAR) || ',"result":' || CASE WHEN r.conv_id IS NULL THEN 'null' WHEN reply IS NULL THEN '{{}}' ELSE '{{"reply":' || to_json(reply) || '}}' END || '}}' END AS canonical
FROM calls c LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""
