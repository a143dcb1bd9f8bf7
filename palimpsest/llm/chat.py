"""Operator 8: linking tool calls with their results in conversations.

Calls and results are rows, brought together by conversation in one shuffle.  There they
are hash-joined by identifier, put in topological order (a call comes after the calls whose identifiers its arguments
name, then by turn), their arguments are checked against the tool's JSON schema, and each
conversation is serialised as canonical JSON: sorted keys, no white space, plain UTF-8.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A user's turn as a call that the assistant's next turn answers.
RESPOND = {"respond": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}

_CALLS = "content string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"
_EVENTS = "array<struct<kind:string,call_id:string,name:string,body:string,place:int>>"
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": (int, float)}
#: Keywords that say nothing about validity here.
_NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "$anchor", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_ONE, _MAPS, _LISTS = {"additionalProperties", "propertyNames", "items", "contains", "not", "if", "then", "else"}, {"properties", "patternProperties", "$defs", "definitions", "dependentSchemas"}, {"allOf", "anyOf", "oneOf", "prefixItems"}
_PLAIN = {"type", "enum", "const", "required", "$ref", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems", "uniqueItems", "minContains", "maxContains", "minProperties", "maxProperties", "dependentRequired"}
#: Arrays and objects within each other that are still taken as arguments.
DEEPEST = 200


def _target(ref: str, root: object) -> object:
    """What a reference within the schema, # or #/..., points to."""
    if not ref.startswith("#"):
        raise ValueError(f"only references within the schema are supported, not {ref!r}")
    for step in ref[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(root, list) and step.isdigit() and int(step) < len(root):
            root = root[int(step)]
        elif isinstance(root, dict) and step in root:
            root = root[step]
        else:
            raise ValueError(f"{ref!r} leads nowhere in the schema")
    return root


def check_schema(schema: object, root: object = None) -> None:
    """Raises ValueError for a keyword, type, pattern or reference that :func:`valid` doesn't know."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"a schema is an object or a boolean, not {schema!r}")
    if unknown := set(schema) - _NOTES - _ONE - _MAPS - _LISTS - _PLAIN:
        raise ValueError(f"unknown schema keywords: {', '.join(sorted(unknown))}")
    kinds = schema.get("type", [])
    if unknown := {kinds} - set(_TYPES) if isinstance(kinds, str) else set(kinds) - set(_TYPES):
        raise ValueError(f"unknown types: {', '.join(sorted(unknown))}")
    for pattern in [schema.get("pattern", ""), *schema.get("patternProperties", ())]:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"bad pattern {pattern!r}") from e
    if "$ref" in schema:
        _target(schema["$ref"], root)
    for part in [*(schema[k] for k in _ONE & set(schema)), *(x for k in _MAPS & set(schema) for x in schema[k].values()), *(x for k in _LISTS & set(schema) for x in schema[k])]:
        check_schema(part, root)


def _same(a: object, b: object) -> bool:
    """Equality of JSON values: true isn't 1, but 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) and (kind != "integer" or isinstance(value, int) or value.is_integer())


def valid(value: object, schema: object, root: object = None) -> bool:
    """JSON-schema check with the keywords of draft 2020-12 that a schema without remote parts needs.

    These are types, enum and const, string, number, array and object keywords, the combinations
    allOf, anyOf, oneOf, not and if, and references within the schema; see :func:`check_schema`.
    """
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    ok = lambda v, part: valid(v, part, root)
    get = schema.get
    kinds = get("type", ())
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        return False
    if "$ref" in schema and not ok(value, _target(schema["$ref"], root)):
        return False
    if not all(ok(value, p) for p in get("allOf", ())) or "anyOf" in schema and not any(ok(value, p) for p in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(ok(value, p) for p in schema["oneOf"]) != 1 or "not" in schema and ok(value, schema["not"]):
        return False
    if "if" in schema and not ok(value, get("then" if ok(value, schema["if"]) else "else", True)):
        return False
    if isinstance(value, dict):
        return _valid_object(value, schema, ok)
    if isinstance(value, list):
        first = get("prefixItems", ())
        if not get("minItems", 0) <= len(value) <= get("maxItems", len(value)) or not all(map(ok, value, first)) or not all(ok(v, get("items", True)) for v in value[len(first) :]):
            return False
        if "contains" in schema and not get("minContains", 1) <= sum(ok(v, schema["contains"]) for v in value) <= get("maxContains", len(value)):
            return False
        return not get("uniqueItems") or not any(_same(v, w) for k, v in enumerate(value) for w in value[:k])
    if isinstance(value, str):
        return get("minLength", 0) <= len(value) <= get("maxLength", len(value)) and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        above = "exclusiveMinimum" not in schema or value > schema["exclusiveMinimum"]
        below = "exclusiveMaximum" not in schema or value < schema["exclusiveMaximum"]
        return above and below and get("minimum", value) <= value <= get("maximum", value) and ("multipleOf" not in schema or Fraction(repr(value)) % Fraction(repr(schema["multipleOf"])) == 0)
    return True


def _valid_object(value: dict, schema: dict, ok: Callable[[object, object], bool]) -> bool:
    get = schema.get
    if any(k not in value for k in get("required", ())) or not get("minProperties", 0) <= len(value) <= get("maxProperties", len(value)):
        return False
    if any(k in value and any(n not in value for n in needed) for k, needed in get("dependentRequired", {}).items()) or any(k in value and not ok(value, p) for k, p in get("dependentSchemas", {}).items()):
        return False
    for k, v in value.items():
        parts = [p for pattern, p in get("patternProperties", {}).items() if re.search(pattern, k)]
        parts += [get("properties", {})[k]] if k in get("properties", {}) else []
        if not ok(k, get("propertyNames", True)) or not all(ok(v, p) for p in (parts or [get("additionalProperties", True)])):
            return False
    return True


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is no JSON number that can be held")
    return value


def parsed(text: str) -> object:
    """The JSON value; ValueError for what is no JSON, has NaN or an infinity, or is nested deeper than DEEPEST."""
    depth = most = 0
    for c in _BRACKETS.findall(text):  # strings are skipped as a whole
        depth += (c in "[{") - (c in "]}")
        most = max(most, depth)
    if most > DEEPEST:
        raise ValueError("nested too deep")
    return json.loads(text, parse_float=_finite, parse_constant=_finite)


_BRACKETS = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{}]', re.S)
_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """Sorted keys, no white space, plain UTF-8; half of a surrogate pair, which UTF-8 can't hold, is escaped."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v)


def topological(calls: list[dict]) -> list[dict]:
    """Calls after all calls whose ids occur as strings in their arguments; else by turn, place and id.

    Calls on a cycle come last, in that same order.
    """
    order = sorted(range(len(calls)), key=lambda k: (calls[k]["turn"] is None, calls[k]["turn"] or 0, calls[k]["place"], calls[k]["id"] or ""))
    calls = [calls[k] for k in order]
    holder: dict[str, list[int]] = {}
    for k, c in enumerate(calls):
        holder.setdefault(c["id"], []).append(k)
    needs = [{j for s in set(_strings(c["arguments"])) if s != c["id"] for j in holder.get(s, ())} for c in calls]
    users: list[list[int]] = [[] for _ in calls]
    for k, need in enumerate(needs):
        for j in need:
            users[j].append(k)
    missing = [len(n) for n in needs]
    ready = [k for k, n in enumerate(missing) if not n]
    heapq.heapify(ready)
    out: list[int] = []
    while ready:
        k = heapq.heappop(ready)
        out.append(k)
        for u in users[k]:
            missing[u] -= 1
            if not missing[u]:
                heapq.heappush(ready, u)
    done = set(out)
    return [calls[k] for k in [*out, *(k for k in range(len(calls)) if k not in done)]]


def _serialise(schemas: dict[str, dict]):
    def conversation(conv_id: int, rows: list[dict]) -> tuple[str, int, int, int]:
        calls, messages = [], []
        results: dict[str, list[tuple]] = {}  # the build side of the hash join
        for r in rows:
            if r["kind"] == "result":
                results.setdefault(r["call_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["body"] is not None, r["body"] or "", r["body"]))
        for r in rows:
            if r["kind"] == "call":
                try:
                    arguments = parsed(r["body"]) if r["body"] is not None else None
                    ok = r["name"] in schemas and valid(arguments, schemas[r["name"]])
                except ValueError:
                    arguments, ok = r["body"], False
                except RecursionError:  # a schema that refers to itself without end
                    ok = False
                result = min(results[r["call_id"]])[-1] if r["call_id"] in results else None
                calls.append({"id": r["call_id"], "name": r["name"], "arguments": arguments, "result": result, "valid": ok, "turn": r["turn"], "place": r["place"]})
            elif r["kind"] == "message":
                messages.append({"content": r["body"], "role": r["name"], "turn": r["turn"]})
        called = {c["id"] for c in calls}
        loose = [{"content": x[-1], "id": i} for i, found in results.items() if i not in called for x in found]
        messages.sort(key=lambda m: (m["turn"] is None, m["turn"] or 0, m["role"] or "", m["content"] or ""))
        ordered = [{k: c[k] for k in ("id", "name", "arguments", "result", "valid")} for c in topological(calls)]
        out: dict = {"calls": ordered, "conv_id": conv_id, "messages": messages}
        if loose:
            out["unlinked"] = sorted(loose, key=canonical)
        return canonical(out), len(calls), sum(c["result"] is not None for c in calls), sum(c["valid"] for c in calls)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [conversation(i, rows) for i, rows in zip(ids, b.column(1).to_pylist())]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32())))], ["conv_id", "json", "calls", "linked", "valid"])

    return serialise


def link_calls(conversations: DataFrame, schemas: dict[str, dict] | None = None, exchanges: bool = True) -> DataFrame:
    """(conv_id, json, calls, linked, valid): each conversation serialised, with counts of its calls.

    An assistant's text that is a JSON object with ``tool_calls`` makes calls; a ``tool``
    turn that is one with ``tool_call_id`` is a result.  With ``exchanges``, a user's turn
    is also a call of ``respond`` named conversation:turn, and an assistant's plain turn
    right after it is its result.  All other turns are messages.  Of several results with
    one identifier the first by turn, then text, is linked; results that no call names are
    listed as unlinked.  A tool without a schema makes invalid calls, and arguments that are no JSON,
    hold NaN or an infinity, or are nested deeper than DEEPEST are invalid and stay a string.  A schema
    with a keyword or type that :func:`valid` doesn't know raises ValueError.  Rows without a
    conv_id are left out; null texts make null contents; repeated rows give repeated
    entries.  Other columns are not read.
    """
    schemas = RESPOND if schemas is None else schemas
    for schema in schemas.values():
        check_schema(schema)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.repartition("conv_id")  # the one shuffle by conversation: windows and groups below reuse it
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    marked = turns.withColumn("before", F.lag("role").over(order)).withColumn("asked", F.lag("turn").over(order))
    has_json = F.col("text").startswith("{") & F.col("text").contains('"tool_call')
    marked = marked.withColumn("o", F.when(has_json, F.from_json("text", _CALLS)))
    calling = (F.col("role") == "assistant") & F.col("o.tool_calls").isNotNull()
    returning = (F.col("role") == "tool") & F.col("o.tool_call_id").isNotNull()
    own = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit("null")))
    asking = F.coalesce(F.col("role") == "user", F.lit(False)) & F.lit(exchanges)
    answering = F.coalesce((F.col("role") == "assistant") & (F.col("before") == "user"), F.lit(False)) & F.lit(exchanges)

    def event(kind: str, call_id=None, name=None, body=None, place=None):
        null = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), (null if call_id is None else call_id).alias("call_id"), (null if name is None else name).alias("name"), (null if body is None else body).alias("body"), (F.lit(0) if place is None else place).cast("int").alias("place"))

    made = F.transform("o.tool_calls", lambda c, k: event("call", c["id"], F.coalesce(c["name"], c["function"]["name"]), F.coalesce(c["arguments"], c["function"]["arguments"]), k))
    said = F.when(F.coalesce(F.col("o.content"), F.lit("")) != "", F.array(event("message", None, F.col("role"), F.col("o.content")))).otherwise(F.array().cast(_EVENTS))
    events = (
        F.when(F.coalesce(calling, F.lit(False)), F.concat(made.cast(_EVENTS), said.cast(_EVENTS)))
        .when(F.coalesce(returning, F.lit(False)), F.array(event("result", F.col("o.tool_call_id"), None, F.col("o.content"))).cast(_EVENTS))
        .when(asking, F.array(event("call", own, F.lit("respond"), F.concat(F.lit('{"text":'), F.coalesce(_quoted("text"), F.lit("null")), F.lit("}")))).cast(_EVENTS))
        .when(answering, F.array(event("result", F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("asked").cast("string"), F.lit("null"))), None, F.col("text"))).cast(_EVENTS))
        .otherwise(F.array(event("message", None, F.col("role"), F.col("text"))).cast(_EVENTS))
    )
    flat = marked.select("conv_id", "turn", F.explode(events).alias("e")).select("conv_id", "turn", "e.*")
    grouped = flat.groupBy("conv_id").agg(F.collect_list(F.struct("kind", "call_id", "name", "body", "place", "turn")).alias("rows"))
    return grouped.mapInArrow(_serialise(schemas), "conv_id long, json string, calls int, linked int, valid int")


def _quoted(column: str):
    """The string as a JSON string literal; null for null."""
    wrapped = f"to_json(named_struct('v', {column}))"
    return F.when(F.col(column).isNotNull(), F.expr(f"substring({wrapped}, 6, length({wrapped}) - 6)"))


SQL = """
WITH marked AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(turn) OVER w AS asked
                FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
     call AS (SELECT conv_id, turn, text FROM marked WHERE role = 'user'),
     answer AS (SELECT conv_id, asked AS turn, text AS result FROM marked WHERE role = 'assistant' AND before = 'user'),
     linked AS (SELECT conv_id, turn, text, result FROM call LEFT JOIN answer USING (conv_id, turn)),
     calls AS (SELECT conv_id, count(*) AS calls, count(result) AS linked, count(*) FILTER (text <> '') AS valid,
                      string_agg('{"arguments":{"text":' || to_json(text)::VARCHAR || '},"id":"' || conv_id || ':' || turn || '","name":"respond","result":'
                        || coalesce(to_json(result)::VARCHAR, 'null') || ',"valid":' || (text <> '') || '}', ',' ORDER BY turn) AS c
               FROM linked GROUP BY conv_id),
     messages AS (SELECT conv_id, string_agg('{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn, role, text) AS m
                  FROM marked WHERE NOT (role = 'user' OR coalesce(role = 'assistant' AND before = 'user', false)) GROUP BY conv_id)
SELECT conv_id, '{"calls":[' || coalesce(c, '') || '],"conv_id":' || conv_id || ',"messages":[' || coalesce(m, '') || ']}' AS json,
       coalesce(calls, 0)::INTEGER AS calls, coalesce(linked, 0)::INTEGER AS linked, coalesce(valid, 0)::INTEGER AS valid
FROM calls FULL JOIN messages USING (conv_id)
"""
