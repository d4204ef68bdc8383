"""Compiled JSON schemas against a walk over each document."""

import copy
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from runscribe.functions.schema import violations
from runscribe.sources.store import CARD_SCHEMA

SMALL = {
    "type": "object",
    "required": ["a", "$id"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": ["integer", "null"], "minimum": 2, "exclusiveMaximum": 5},
        "b": {"$ref": "#/$defs/list"},
        "c": {"const": 3},
        "d": {"enum": ["x", 1, None, True]},
        "$id": {"type": "string", "minLength": 1, "maxLength": 3, "pattern": "^[a-z]"},
    },
    "patternProperties": {"^p_": {"type": "number", "maximum": 1}},
    "$defs": {"list": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "boolean"}, "deep": {"$ref": "#/$defs/leaf"}}}}, "leaf": {"type": "string", "format": "date-time"}},
}


def walk(v, schema, root, path="$"):
    while "$ref" in schema:
        node = root
        for part in schema["$ref"][2:].split("/"):
            node = node[part]
        schema = node
    number = isinstance(v, int | float) and not isinstance(v, bool)
    kinds = {"null": v is None, "boolean": isinstance(v, bool), "string": isinstance(v, str), "array": isinstance(v, list), "object": isinstance(v, dict), "number": number, "integer": number and v == int(v)}
    if "type" in schema and not any(kinds[t] for t in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])):
        return [(path, "type")]

    def same(a, b):
        return isinstance(a, bool) == isinstance(b, bool) and a == b

    out = []
    checks = {"const": lambda b: same(v, b), "enum": lambda b: any(same(v, x) for x in b)}
    if number:
        checks |= {"minimum": lambda b: v >= b, "maximum": lambda b: v <= b, "exclusiveMinimum": lambda b: v > b, "exclusiveMaximum": lambda b: v < b}
    if isinstance(v, str):
        checks |= {"minLength": lambda b: len(v) >= b, "maxLength": lambda b: len(v) <= b, "pattern": lambda b: re.search(b, v), "format": lambda _: re.match(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d)T\d\d:\d\d:\d\dZ$", v)}
    if isinstance(v, list):
        checks |= {"minItems": lambda b: len(v) >= b, "maxItems": lambda b: len(v) <= b}
        for i, x in enumerate(v):
            out += walk(x, schema.get("items", {}), root, f"{path}[{i}]")
    out += [(path, k) for k, holds in checks.items() if k in schema and not holds(schema[k])]
    if isinstance(v, dict):
        out += [(path, f"required {k}") for k in schema.get("required", []) if k not in v]
        for k, x in v.items():
            fits = [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            if k in schema.get("properties", {}):
                out += walk(x, schema["properties"][k], root, f"{path}.{k}")
            elif fits:
                out += walk(x, fits[0], root, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append((path, f"additionalProperties {k}"))
    return out


def told(spark, values, schema):
    df = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i long, t string")
    rows = df.select("i", violations(F.try_parse_json("t"), schema).alias("p")).collect()
    return {r["i"]: sorted((p["path"], p["rule"]) for p in r["p"]) for r in rows}


def test_small_schema_on_random_documents(spark):
    rng = random.Random(9)

    def leaf():
        return rng.choice([None, True, False, 0, 1, 2, 3, 4.0, 4.5, 5, "", "x", "ab", "Zz", "abcd", "2024-02-03T04:05:06Z", "yesterday", [], {}])

    def document():
        one = {k: leaf() for k in ("a", "c", "d", "$id", "p_x", "p_'y", "other") if rng.random() < 0.6 and not (k == "p_'y")}
        if rng.random() < 0.7:
            one["b"] = rng.choice([leaf(), [rng.choice([leaf(), {"k": leaf()}, {"k": True, "deep": leaf()}]) for _ in range(rng.randrange(4))]])
        return one

    values = [document() for _ in range(400)] + [5, [], None, "{broken", {}]
    got = told(spark, values, SMALL)
    for i, v in enumerate(values):
        assert got[i] == ([("$", "type")] if v == "{broken" else sorted(walk(v, SMALL, SMALL))), v


@pytest.fixture(scope="module")
def good_card():
    entry = {"score": 8, "weight": 0.1, "weighted": 0.8, "justification": "why"}
    card = dict.fromkeys(("summary", "one_liner"), "s") | dict.fromkeys(("red_flags", "bonuses", "critical_issues", "recommendations"), []) | {"adjustments": {"deduction": 0.5, "bonus": 0}}
    card |= {"schemaVersion": "1.0.0", "skill": "s", "timestamp": "2026-04-18T08:27:18Z", "composite_score": 8.0, "grade": "B+", "grade_label": "good", "rubric_used": "default", "transcript_lines": 3}
    return card | {"dimensions": {d: dict(entry) for d in CARD_SCHEMA["properties"]["dimensions"]["required"]}}


def test_cards(spark, good_card):
    faults = [
        ({}, []), ({"grade": "Z"}, [("$.grade", "enum")]), ({"timestamp": "yesterday"}, [("$.timestamp", "format")]), ({"timestamp": "2026-02-30T00:00:00Z"}, [("$.timestamp", "format")]),
        ({"skill": 5}, [("$.skill", "type")]), ({"skill": ""}, [("$.skill", "minLength")]), ({"schemaVersion": "2"}, [("$.schemaVersion", "pattern")]), ({"model": None}, []), ({"model": 1}, [("$.model", "type")]),
        ({"adjustments": {"deduction": 3, "more": 1}}, [("$.adjustments", "additionalProperties more"), ("$.adjustments", "required bonus"), ("$.adjustments.deduction", "maximum")]), ({"own": [1]}, []),
    ]
    cards = [{**copy.deepcopy(good_card), **change} for change, _ in faults]
    cards.append({k: v for k, v in good_card.items() if k != "summary"})
    cards.append(copy.deepcopy(good_card))
    cards[-1]["dimensions"]["safety"] |= {"score": 11, "llm_score": 0, "llm_justification": 1}
    want = [sorted(w) for _, w in faults] + [[("$", "required summary")], sorted([("$.dimensions.safety.score", "maximum"), ("$.dimensions.safety.llm_score", "minimum"), ("$.dimensions.safety.llm_justification", "type")])]
    assert list(dict(sorted(told(spark, cards, CARD_SCHEMA).items())).values()) == want


def test_a_deep_schema_is_no_slower_by_the_power_of_its_depth(spark):
    """Types of nested expressions aren't derived anew for each value; keys with quotes are keys like others."""
    schema, value, want, depth = {"type": "integer", "minimum": 0}, -1, [("$" + ".n" * 7, "minimum")], 7
    for level in range(depth):
        schema = {"type": "object", "required": ["v"], "properties": {"n": schema, "v": {"enum": ["a", "b", "c"]}}, "patternProperties": {"^q": {"type": "string"}}, "additionalProperties": False}
        value = {"n": value, "v": "d", "q'": 1, 'q"].x': "s", "z'": 2}
        at = "$" + ".n" * (depth - 1 - level)
        want += [(f"{at}.v", "enum"), (f"{at}.q'", "type"), (at, "additionalProperties z'")]
    began = time.monotonic()
    assert told(spark, [value] * 200, schema) == dict.fromkeys(range(200), sorted(want))
    assert time.monotonic() - began < 60
