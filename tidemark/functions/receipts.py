"""Validation of receipts: a small subset of JSON Schema on the driver, and the same rules as columns for flat rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _fits(value, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return (isinstance(value, int) or isinstance(value, float) and value.is_integer()) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def validate(value, schema: dict, root: dict | None = None, at: str = "$") -> list[str]:
    """Errors of a value: ``$ref, const, enum, type, minLength, minItems, minimum, items, required, properties, additionalProperties``."""
    root = schema if root is None else root
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            target = target[part]
        return validate(value, target, root, at)
    if "const" in schema and value != schema["const"]:
        return [f"{at} must be {schema['const']!r}"]
    if "enum" in schema and value not in schema["enum"]:
        return [f"{at} must be one of {schema['enum']!r}"]
    kinds = schema.get("type")
    if kinds and not any(_fits(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at} must be of type {kinds}"]
    out: list[str] = []
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at} is too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and "minimum" in schema and value < schema["minimum"]:
        out.append(f"{at} is below {schema['minimum']}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at} has too few items")
        for i, x in enumerate(value):
            out += validate(x, schema["items"], root, f"{at}[{i}]") if "items" in schema else []
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{at}.{k} is required" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in properties:
                out += validate(x, properties[k], root, f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k} is not allowed")
    return out


def errors(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def unexpected_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that aren't allowed."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
