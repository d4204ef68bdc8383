"""A JSON schema compiled to one column expression over VARIANT documents: which rules are broken, and where."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a broken rule is told as.
PROBLEM = "array<struct<path:string,rule:string>>"
_DATE_TIME = r"^\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d+)?)?(Z|[+-]\d{2}:?[0-5]\d)?)?$"
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def violations(document: Column, schema: dict[str, Any]) -> Column:
    """(path, rule) of each rule that ``document`` (VARIANT) breaks; a null document, one that was no JSON, breaks ``type`` at ``$``.

    Keywords: type (or a list of types), const, enum, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern,
    format (date-time), minItems, maxItems, items, required, properties, additionalProperties (false), patternProperties and local $ref.  A value of a
    wrong type breaks that rule alone.  A number without a fraction is an integer.  ``required`` and ``additionalProperties`` name the key.
    Schemas that refer to themselves can't be compiled.
    """
    return _once(document, lambda x: F.when(x.isNull(), _broken(F.lit("$"), "type")).otherwise(_check(x, schema, schema, F.lit("$"))))


def _once(value: Column, told: Callable[[Column], Column]) -> Column:
    """``told`` (PROBLEM) of a value that is made once, however often it is named.

    An aggregate has the type of its start.  That of ``get(transform(…))`` is derived from all that is nested in it, which Spark
    does again for every value it meets.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(PROBLEM), lambda _, x: told(x))


def _broken(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _none() -> Column:
    return F.expr(f"CAST(array() AS {PROBLEM})")


def _resolved(schema: dict[str, Any], root: dict[str, Any]) -> dict[str, Any]:
    while "$ref" in schema:
        node: Any = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            node = node[part]
        schema = node
    return schema


def _is(kind: Column, number: Column, name: str) -> Column:
    return {
        "null": kind == "VOID",
        "boolean": kind == "BOOLEAN",
        "string": kind == "STRING",
        "array": kind == "ARRAY",
        "object": kind == "OBJECT",
        "number": number.isNotNull(),
        "integer": number == F.floor(number),
    }[name]


def _check(x: Column, schema: dict[str, Any], root: dict[str, Any], path: Column) -> Column:
    """What ``x`` breaks.  Its parts, kind, text and number are made once: in a lambda nothing else shares an expression."""
    schema = _resolved(schema, root)
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type")

    def part(name: str, kind: str) -> Column:
        return F.try_variant_get(x, "$", kind) if types is None or name in types else F.lit(None).cast(kind)

    parts = F.struct(part("object", "map<string,variant>").alias("fields"), part("array", "array<variant>").alias("items"))

    def typed(at: Column) -> Column:
        return F.when(at["fields"].isNotNull(), "OBJECT").when(at["items"].isNotNull(), "ARRAY").otherwise(F.substring_index(F.schema_of_variant(x), "(", 1))

    def with_kind(at: Column) -> Column:
        return _once(typed(at), lambda kind: with_values(at, kind))

    def with_values(at: Column, kind: Column) -> Column:
        values = F.struct(F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).alias("text"), F.when(kind.isin(*_NUMBERS), F.try_variant_get(x, "$", "double")).alias("number"))
        return _once(values, lambda v: _broken_by(x, kind, v["text"], v["number"], at["fields"], at["items"], schema, types, root, path))

    return _once(parts, with_kind)


def _broken_by(x: Column, kind: Column, text: Column, number: Column, fields: Column, items: Column, schema: dict[str, Any], types: list[str] | None, root: dict[str, Any], path: Column) -> Column:
    rules: dict[str, Column] = {}
    if "const" in schema:
        rules["const"] = ~F.coalesce(_equals(x, kind, text, number, schema["const"]), F.lit(False))
    if "enum" in schema:
        same = F.lit(False)
        for v in schema["enum"]:
            same = same | F.coalesce(_equals(x, kind, text, number, v), F.lit(False))
        rules["enum"] = ~same
    for rule, value, holds in (
        ("minimum", number, lambda v, b: v >= b), ("maximum", number, lambda v, b: v <= b), ("exclusiveMinimum", number, lambda v, b: v > b), ("exclusiveMaximum", number, lambda v, b: v < b),
        ("minLength", F.length(text), lambda v, b: v >= b), ("maxLength", F.length(text), lambda v, b: v <= b), ("minItems", F.size(items), lambda v, b: v >= b), ("maxItems", F.size(items), lambda v, b: v <= b),
        ("pattern", text, lambda v, b: v.rlike(b)),
    ):
        if rule in schema:
            rules[rule] = ~holds(value, schema[rule]) & (F.lit(True) if rule not in ("minItems", "maxItems") else items.isNotNull())
    if schema.get("format") == "date-time":
        rules["format"] = ~(text.rlike(_DATE_TIME) & F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull())
    found = [F.array_compact(F.array(*[F.when(c, F.struct(path.alias("path"), F.lit(r).alias("rule"))) for r, c in rules.items()]))] if rules else []
    if isinstance(schema.get("items"), dict):
        each = F.transform(items, lambda e, i: _check(e, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), _none()))
    found += _check_fields(fields, schema, root, path)
    told = F.concat(*found) if found else _none()
    if types is None:
        return told
    fits = F.lit(False)
    for name in types:
        fits = fits | F.coalesce(_is(kind, number, name), F.lit(False))
    return F.when(fits, told).otherwise(_broken(path, "type"))


def _equals(x: Column, kind: Column, text: Column, number: Column, value: Any) -> Column:
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean") == value)
    return text == value if isinstance(value, str) else number == float(value)


def _check_fields(fields: Column, schema: dict[str, Any], root: dict[str, Any], path: Column) -> list[Column]:
    """``fields``: an object's keys and values, null for another value."""
    found = []
    if schema.get("required"):
        lacking = F.array_except(F.array(*map(F.lit, schema["required"])), F.map_keys(fields))
        found.append(F.coalesce(F.transform(lacking, lambda k: F.struct(path.alias("path"), F.concat(F.lit("required "), k).alias("rule"))), _none()))
    alike: list[tuple[dict[str, Any], list[str]]] = []  # properties of one schema are checked by one expression
    for key, sub in (schema.get("properties") or {}).items():
        for known, keys_of in alike:
            if known == sub:
                keys_of.append(key)
                break
        else:
            alike.append((sub, [key]))
    for sub, names in alike:
        held = F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at(fields, F.lit(k)).alias("value")) for k in names])
        found.append(_each(held, sub, root, path))
    declared = list(schema.get("properties") or {})
    earlier: list[str] = []
    for pattern, sub in (schema.get("patternProperties") or {}).items():
        found.append(_each(F.filter(F.map_entries(fields), lambda e: _undeclared(e["key"], declared, earlier) & e["key"].rlike(pattern)), sub, root, path))  # noqa: B023
        earlier = [*earlier, pattern]
    if schema.get("additionalProperties") is False:
        rest = F.filter(F.map_keys(fields), lambda k: _undeclared(k, declared, earlier))
        more = F.transform(rest, lambda k: F.struct(path.alias("path"), F.concat(F.lit("additionalProperties "), k).alias("rule")))
        found.append(F.coalesce(more, _none()))
    return found


def _undeclared(key: Column, declared: list[str], patterns: list[str]) -> Column:
    out = ~key.isin(*declared) if declared else F.lit(True)
    for p in patterns:
        out = out & ~key.rlike(p)
    return out


def _each(held: Column, sub: dict[str, Any], root: dict[str, Any], path: Column) -> Column:
    there = F.filter(held, lambda p: p["value"].isNotNull())
    return F.coalesce(F.flatten(F.transform(there, lambda p: _check(p["value"], sub, root, F.concat(path, F.lit("."), p["key"])))), _none())
