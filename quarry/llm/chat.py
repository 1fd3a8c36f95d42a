"""Chat formatting with tool-call linking (operator 8).

Messages are rows (conv_id, turn, role, text).  An assistant text that is a
JSON object with ``tool_calls`` holds calls ``{"id", "name", "arguments"}``;
a ``tool`` text that is a JSON object with ``tool_call_id`` is a result.  An
argument value ``{"$result": id}`` makes a call depend on another call's
result.  Everything else is an ordinary message.

Results are hash-joined to calls by (conversation, id); the order of a
conversation is topological: a call comes after the calls it depends on, a
result directly after its call.  The order is a sort key in columns
(``anchor, depth, place, part``), found by joins that run once per level of
dependence, so no conversation is gathered in one task however long it is.
Arguments are validated against a schema per tool, and every item becomes
one line of canonical JSON (sorted keys, no spaces, UTF-8).

Status: ``ok``; for calls ``unknown_tool``, ``invalid_arguments``,
``duplicate_id`` (a later call with an id already used), ``cycle`` (in one,
or after one), ``missing_dependency`` (it needs an id that no call has; for
the order that need does not count), ``unanswered``; for results
``orphan_result``.
Null or empty texts are ordinary empty messages, a null role is ``unknown``,
a null conv_id is a conversation of its own kind (joined null-safe).  A
repeated result row stays a row; a repeated call row is a duplicate.  A lone
surrogate in escaped JSON becomes a question mark.  Extra columns are
ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path

_PARSED = ("conv_id long, turn long, role string, kind string, place int, call_id string, name string, arguments string, "
           "content string, problem string, needs array<string>")
_TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}


def _sound(text: str) -> str:
    """The text with every lone surrogate, which JSON may escape and UTF-8 cannot hold, as a question mark."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def canonical(value) -> str:
    """Canonical JSON; raises ValueError for non-finite numbers (and numbers beyond a double's range)."""
    return _sound(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def schema_problem(value, schema: dict, at: str = "$") -> str | None:
    """First violation of a JSON schema (type, enum, required, properties, additionalProperties, items, bounds)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if isinstance(value, dict) and set(value) == {"$result"}:
        return None  # known only when the other call has answered
    if kinds and not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return f"{at}: not {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            return f"{at}: out of range"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{at}: length"
    if isinstance(value, list) and "items" in schema:
        return next((p for i, v in enumerate(value) if (p := schema_problem(v, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        for k in sorted(schema.get("required", ())):
            if k not in value:
                return f"{at}.{k}: missing"
        props = schema.get("properties", {})
        for k in sorted(value):
            if k in props:
                if p := schema_problem(value[k], props[k], f"{at}.{k}"):
                    return p
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: unexpected"
    return None


def _needs(value) -> set[str]:
    found, stack = set(), [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if set(v) == {"$result"}:
                found.add(_sound(str(v["$result"])))
            else:
                stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
    return found


def _object(text: str | None, key: str) -> dict | None:
    """The JSON object in ``text`` if it has ``key``."""
    if not text or key not in text or not text.lstrip().startswith("{"):
        return None
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) and key in v else None


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """Items of one message: kind, place, call_id, name, arguments, content, problem, needs."""
    blank = {"kind": "message", "place": 0, "call_id": None, "name": None, "arguments": None, "content": text or "", "problem": None, "needs": []}
    if role == "tool" and (v := _object(text, "tool_call_id")) is not None and v["tool_call_id"] is not None:
        content = v.get("content")
        try:
            content = content if isinstance(content, str) else canonical(content)
        except (ValueError, RecursionError):
            return [blank]
        return [blank | {"kind": "result", "call_id": _sound(str(v["tool_call_id"])), "content": _sound(content)}]
    if role == "assistant" and (v := _object(text, "tool_calls")) is not None and isinstance(v["tool_calls"], list):
        items = []
        if v.get("content"):
            items.append(blank | {"content": _sound(str(v["content"]))})
        for k, call in enumerate(v["tool_calls"]):
            call = call if isinstance(call, dict) else {}
            name, args, problem = call.get("name"), call.get("arguments"), None
            if isinstance(args, str):
                try:
                    args = json.loads(args)
                except (ValueError, RecursionError):
                    problem = "invalid_arguments"
            name = None if name is None else _sound(str(name))
            if problem is None:
                problem = "unknown_tool" if name not in schemas else "invalid_arguments" if schema_problem(args, schemas[name]) else None
            try:
                text_args = canonical([[[args]]])[3:-3]  # as deep as it will lie in a line
            except (ValueError, RecursionError):
                text_args, problem = "null", "invalid_arguments"
            items.append(blank | {"kind": "call", "place": k + 1, "call_id": None if call.get("id") is None else _sound(str(call["id"])), "name": name,
                                  "arguments": text_args, "content": "", "problem": problem, "needs": sorted(_needs(args))})
        return items or [blank]
    return [blank]


def _parse(schemas: dict[str, dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PARSED.split(", ")]
        for pdf in batches:
            rows = []
            for conv, turn, role, text in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"]):
                own = {"conv_id": conv, "turn": turn, "role": role if role is not None else "unknown"}
                rows += [own | item for item in parse_message(role, text, schemas)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})
    return run


def _line(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lines = []
        for kind, role, call, name, args, content, status in zip(*(pdf[c] for c in ("kind", "role", "call_id", "name", "arguments", "content", "status"))):
            if kind == "call":
                v = {"role": role, "tool_call": {"id": call, "name": name, "arguments": json.loads(args)}}
            elif kind == "result":
                v = {"role": role, "tool_call_id": call, "content": content}
            else:
                v = {"role": role, "content": content}
            if status != "ok":
                v["status"] = status
            lines.append(canonical(v))
        yield pdf.drop(columns=["name", "arguments", "content"]).assign(json=lines).astype({"conv_id": "Int64", "turn": "Int64", "anchor": "Int64"})


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message, call and result: conv_id, turn, role, kind, call_id,
    anchor, depth, place, part (the topological sort key), status, json."""
    spark = messages.sparkSession
    path = scratch_path(spark, "chat-items")
    (messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                     F.col("text").cast("string").alias("text"))
     .mapInPandas(_parse(schemas), _PARSED).withColumn("item", F.monotonically_increasing_id()).write.parquet(path))
    items = spark.read.parquet(path)
    calls = items.where("kind = 'call'")

    # the first call of an id is the one that results and dependences mean
    first = (calls.where("call_id is not null").groupBy("conv_id", "call_id")
             .agg(F.min(F.struct("turn", "place", "item")).alias("f")).select("conv_id", "call_id", F.col("f.item").alias("call_item")))
    path = scratch_path(spark, "chat-first")
    first.write.parquet(path)
    first = spark.read.parquet(path)

    need = calls.select("item", "conv_id", F.explode("needs").alias("need"))
    known = first.withColumnsRenamed({"conv_id": "c", "call_id": "i", "call_item": "on"})
    path = scratch_path(spark, "chat-needs")
    need.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("need") == F.col("i")), "left").select("item", "on").write.parquet(path)
    need = spark.read.parquet(path)

    # one round a level: calls whose known needs are all placed come next, at the following depth and the latest
    # anchor; a round joins the needs with the calls of the round before only
    open_calls = need.groupBy("item").agg(F.count("on").alias("n"), F.max(F.col("on").isNull()).alias("missing"))
    frontier = (calls.join(open_calls.where("n > 0"), "item", "left_anti").select("item", F.col("turn").alias("anchor"), F.lit(0).alias("depth")))
    placed = frontier
    if not need.isEmpty():
        waiting = (open_calls.where("n > 0").select("item", "n").join(calls.select("item", "turn"), "item")
                   .select("item", "n", F.lit(0).cast("long").alias("have"), F.col("turn").alias("anchor"), F.lit(0).alias("depth")))
        known_needs = need.where("`on` is not null")
        while True:
            met = (known_needs.join(frontier.select(F.col("item").alias("on"), F.col("anchor").alias("_a"), F.col("depth").alias("_d")), "on")
                   .groupBy("item").agg(F.count("*").alias("_have"), F.max("_a").alias("_a"), F.max("_d").alias("_d")))
            path = scratch_path(spark, "chat-waiting")
            (waiting.join(met, "item", "left")
             .select("item", "n", (F.col("have") + F.coalesce("_have", F.lit(0))).alias("have"), F.greatest("anchor", "_a").alias("anchor"),
                     F.greatest("depth", F.col("_d") + 1).alias("depth")).write.parquet(path))
            now = spark.read.parquet(path)
            frontier, waiting = now.where("n = have").drop("n", "have"), now.where("n > have")
            if frontier.isEmpty():
                break
            placed = placed.unionByName(frontier)

    answered = (items.where("kind = 'result'").select("conv_id", "call_id").distinct()
                .join(first.withColumnsRenamed({"conv_id": "c", "call_id": "i"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")))
                .select(F.col("call_item").alias("item"), F.lit(True).alias("answered")))
    state = (calls.select("item", "turn", F.col("place").alias("at"), "problem")
             .join(first.select(F.col("call_item").alias("item"), F.lit(True).alias("first")), "item", "left")
             .join(placed, "item", "left").join(open_calls.select("item", "missing"), "item", "left").join(answered, "item", "left")
             .select("item", "at", F.coalesce("anchor", "turn").alias("anchor"), F.coalesce("depth", F.lit(0)).alias("depth"),
                     F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("first").isNull(), "duplicate_id")
                     .when(F.col("missing"), "missing_dependency").when(F.col("anchor").isNull() & F.col("missing").isNotNull(), "cycle")
                     .when(F.col("answered").isNull(), "unanswered").otherwise("ok").alias("state")))
    path = scratch_path(spark, "chat-state")
    state.write.parquet(path)
    state = spark.read.parquet(path)

    mine = state.withColumnRenamed("item", "of")
    target = first.withColumnsRenamed({"conv_id": "c", "call_id": "i"}).join(state, F.col("call_item") == F.col("item")).select("c", "i", "at", "anchor", "depth")
    as_call = (items.where("kind = 'call'").join(mine, F.col("item") == F.col("of"))
               .select("conv_id", "turn", "role", "kind", "call_id", "anchor", "depth", F.col("at").alias("place"), F.lit(0).alias("part"), F.col("state").alias("status"), "name", "arguments", "content"))
    as_result = (items.where("kind = 'result'").join(target, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left")
                 .select("conv_id", "turn", "role", "kind", "call_id", F.coalesce("anchor", "turn").alias("anchor"), F.coalesce("depth", F.lit(0)).alias("depth"),
                         F.coalesce("at", F.lit(0)).alias("place"), F.lit(1).alias("part"),
                         F.when(F.col("at").isNull(), "orphan_result").otherwise("ok").alias("status"), "name", "arguments", "content"))
    as_message = (items.where("kind = 'message'")
                  .select("conv_id", "turn", "role", "kind", "call_id", F.col("turn").alias("anchor"), F.lit(0).alias("depth"), F.lit(0).alias("place"),
                          F.lit(0).alias("part"), F.lit("ok").alias("status"), "name", "arguments", "content"))
    return (as_message.unionByName(as_call).unionByName(as_result)
            .mapInPandas(_line, "conv_id long, turn long, role string, kind string, call_id string, anchor long, depth int, place int, part int, status string, json string"))
