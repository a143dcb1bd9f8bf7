import json

import pytest

from palimpsest.llm.chat import canonical, check_schema, link_calls, parsed, topological, valid

SCHEMA = "conv_id long, turn long, role string, text string, kind string, id string, result string, before string"
TOOLS = {"find": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "k": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "i", "r", "b") for r in rows], SCHEMA)


def run(spark, rows, **options):
    return {r.conv_id: (json.loads(r.json), r.calls, r.linked, r.valid, r.json) for r in link_calls(table(spark, rows), **options).collect()}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def test_valid():
    assert valid({"q": "x", "k": 2}, TOOLS["find"]) and not valid({"q": "x", "k": 0}, TOOLS["find"]) and not valid({"k": 1}, TOOLS["find"])
    assert not valid({"q": "x", "z": 1}, TOOLS["find"]) and not valid({"q": 1}, TOOLS["find"]) and not valid({"q": "x", "k": True}, TOOLS["find"])
    assert valid([1, 2.5], {"type": "array", "items": {"type": "number"}}) and not valid(["a"], {"type": "array", "items": {"type": "number"}})
    assert valid(None, {"type": ["null", "string"]}) and not valid("c", {"enum": ["a", "b"]}) and not valid("", {"type": "string", "minLength": 1})


def test_topological():
    make = lambda i, turn, *needs: {"id": i, "turn": turn, "place": 0, "arguments": {"n": list(needs)}}
    order = lambda *calls: [c["id"] for c in topological(list(calls))]
    assert order(make("a", 1, "c"), make("b", 2), make("c", 3)) == ["b", "c", "a"]
    assert order(make("a", 1, "b"), make("b", 2, "a"), make("c", 3)) == ["c", "a", "b"]  # a cycle comes last
    assert order(make("a", 1, "a"), make("z", 0)) == ["z", "a"]


def test_links(spark):
    rows = [
        (1, 0, "system", "be brief"),
        (1, 1, "user", "go"),
        (1, 2, "assistant", call(("c2", "find", {"q": "c1"}), ("c1", "find", {"q": "ü", "k": 3}))),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "one"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c2", "content": "two"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "gone", "content": "lost"})),
        (1, 6, "assistant", json.dumps({"content": "next", "tool_calls": [{"id": "c3", "function": {"name": "other", "arguments": '{"b":1,"a":2}'}}]})),
        (2, 0, "tool", json.dumps({"tool_call_id": "c3", "content": "another conversation"})),
    ]
    found = run(spark, rows, schemas=TOOLS, exchanges=False)
    one = found[1][0]
    assert [(c["id"], c["result"], c["valid"]) for c in one["calls"]] == [("c1", "one", True), ("c2", "two", True), ("c3", None, False)]
    assert one["unlinked"] == [{"content": "lost", "id": "gone"}] and [m["content"] for m in one["messages"]] == ["be brief", "go", "next"]
    assert found[1][1:4] == (3, 2, 2) and found[1][4] == canonical(one) and "ü" in found[1][4]
    assert found[2][0]["calls"] == [] and found[2][0]["unlinked"] == [{"content": "another conversation", "id": "c3"}]


def test_edge_cases(spark):
    rows = [(None, 0, "user", "x"), (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "user", "long " * 100_000), (3, None, None, None), (4, 0, "assistant", "{not json \"tool_call"), (5, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "a")]
    found = run(spark, rows)
    assert set(found) == {1, 2, 3, 4, 5}
    assert found[1][0]["calls"] == [{"id": "1:0", "name": "respond", "arguments": {"text": None}, "result": "", "valid": False}]
    assert found[2][1:4] == (1, 0, 1) and found[3][0]["messages"] == [{"content": None, "role": None, "turn": None}]
    assert found[4][0]["messages"][0]["content"].startswith("{not") and found[5][1:4] == (2, 2, 2)
    assert run(spark, []) == {}


@pytest.mark.parametrize(
    "schema,good,bad",
    [
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3], [2]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [1, 3.5], [4, 2.5]),
        ({"allOf": [{"type": "integer"}, {"maximum": 3}], "not": {"const": 2}}, [1, 3], [2, 4]),
        ({"pattern": "^a+$"}, ["aa", 5], ["ab", ""]),
        ({"const": {"a": [1, True]}}, [{"a": [1.0, True]}], [{"a": [1, 1]}, {}]),
        ({"enum": [0, "x"]}, [0, 0.0, "x"], [False, "y", None]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3, "multipleOf": 0.1}, [1.1, 2], [1, 3, 1.25]),
        ({"type": "integer"}, [1, 2.0], [True, 1.5, "1"]),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True, "contains": {"type": "string"}}, [["a"], ["a", 1]], [[], [1], ["a", "a"], ["a", 1, 2]]),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}}, [["a", 1], []], [[1], ["a", "b"]]),
        ({"$defs": {"tree": {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}, "additionalProperties": False}}, "$ref": "#/$defs/tree"}, [{}, {"kids": [{"kids": []}]}], [{"kids": [{"x": 1}]}, 1]),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"maxProperties": 0}}, [{}, {"a": 1, "b": 2}], [{"a": 1}, {"c": 1}]),
        ({"patternProperties": {"^x": {"type": "integer"}}, "propertyNames": {"maxLength": 2}, "additionalProperties": False}, [{"x1": 1}], [{"x1": "s"}, {"y": 1}, {"x11": 1}]),
        ({"dependentRequired": {"a": ["b"]}, "minProperties": 1}, [{"b": 1}, {"a": 1, "b": 1}], [{}, {"a": 1}]),
        (False, [], [1, None]),
    ],
)
def test_schema_keywords(schema, good, bad):
    check_schema(schema)
    assert all(valid(v, schema) for v in good) and not any(valid(v, schema) for v in bad)


@pytest.mark.parametrize("schema", [{"type": "text"}, {"minimun": 1}, {"properties": {"a": {"unevaluatedItems": False}}}, {"$ref": "other.json"}, {"$ref": "#/$defs/none"}, {"pattern": "("}, {"items": [3]}])
def test_unknown_schemas_raise(spark, schema):
    with pytest.raises(ValueError):
        link_calls(table(spark, []), {"find": schema})


def test_hostile_arguments(spark):
    deep = "[" * 50_000 + "]" * 50_000
    bodies = [deep, '{"q":"\\ud800"}', '{"q":NaN}', '{"q":1e999}', '{"q":"x","k":' + "9" * 5000 + "}", '{"q":"[[[{{{"}', "{", '{"q":"x","q":"y"}']
    rows = [(1, k, "assistant", call((f"c{k}", "find", body))) for k, body in enumerate(bodies)]
    out, calls, _, ok, text = run(spark, rows, schemas=TOOLS, exchanges=False)[1]
    assert calls == len(bodies) and [c["valid"] for c in out["calls"]] == [False, True, False, False, False, True, False, True] and ok == 3
    assert out["calls"][0]["arguments"] == deep and out["calls"][2]["arguments"] == '{"q":NaN}' and '"\\ud800"' in text and "NaN\"" not in text
    loop = {"loop": {"$ref": "#"}}
    assert run(spark, [(1, 0, "assistant", call(("a", "loop", "{}")))], schemas=loop)[1][3] == 0
    assert parsed('["[[[[", {"a": "\\""}]') == ["[[[[", {"a": '"'}]


def test_of_several_results_the_first_is_linked(spark):
    back = lambda text: json.dumps({"tool_call_id": "c", "content": text})
    rows = [(1, 0, "assistant", call(("c", "find", '{"q":"x"}'))), (1, 3, "tool", back("a")), (1, 2, "tool", back("z")), (1, 2, "tool", back("y")), (1, None, "tool", back("0"))]
    assert run(spark, rows, schemas=TOOLS)[1][0]["calls"][0]["result"] == "0"  # a turn that is null comes first
    assert run(spark, rows[:4], schemas=TOOLS)[1][0]["calls"][0]["result"] == "y"
