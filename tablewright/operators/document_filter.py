"""Document filters, ``{"n": {"$gt": 3}, "$or": [...]}``, as one Column."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import expr, literal


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type at a dotted path; None inside a VARIANT or for an unknown field."""
    kind: T.DataType = schema
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.MapType):
            kind = kind.valueType
        elif isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
        else:
            return None
    return kind


def variant_root(schema: T.StructType, path: str) -> tuple[str, str] | None:
    """``(column, json path)`` when ``path`` leads into a VARIANT column."""
    head, _, rest = path.partition(".")
    if rest and head in schema.names and isinstance(schema[head].dataType, T.VariantType):
        return head, "$." + rest
    return None


def _value_type(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    return "double" if isinstance(value, float) else "string"


def _read(schema: T.StructType, path: str, sample: Any) -> Column:
    inside = variant_root(schema, path)
    if inside:
        return F.try_variant_get(F.col(inside[0]), inside[1], _value_type(sample))
    return F.col(path)


def no(predicate: Column) -> Column:
    """Negation that treats an unknown answer (missing field) as false."""
    return ~F.coalesce(predicate, F.lit(False))


_COMPARE = {
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
}


def _mask(value: Any) -> int:
    return value if isinstance(value, int) else sum(1 << p for p in value)


def _regex(pattern: Any, options: str) -> str:
    flags = "".join(f for f in options if f in "imsx")
    return f"(?{flags}){pattern}" if flags else str(pattern)


def _test(c: Column, op: str, value: Any, options: str) -> Column:
    """One operator against one scalar value."""
    if op == "$eq":
        return c.isNull() if value is None else c == literal(value)
    if op in _COMPARE:
        return _COMPARE[op](c, literal(value))
    if op == "$in":
        real = [v for v in value if v is not None]
        out = c.isin(real) if real else F.lit(False)
        return out | c.isNull() if len(real) < len(value) else out
    if op == "$regex":
        return c.rlike(_regex(value, options))
    if op == "$mod":
        return F.try_mod(c, F.lit(value[0])) == F.lit(value[1])
    bits = F.lit(_mask(value)) if op.startswith("$bits") else None
    if op == "$bitsAllSet":
        return c.bitwiseAND(bits) == bits
    if op == "$bitsAnySet":
        return c.bitwiseAND(bits) != 0
    if op == "$bitsAllClear":
        return c.bitwiseAND(bits) == 0
    if op == "$bitsAnyClear":
        return c.bitwiseAND(bits) != bits
    raise ValueError(f"unknown filter operator {op}")


# Type names and the type names Spark reports.
TYPE_PREFIXES = {
    "string": ("string",), "int": ("int", "smallint", "tinyint"), "long": ("bigint",),
    "double": ("double", "float"), "decimal": ("decimal",), "bool": ("boolean",),
    "date": ("timestamp", "date"), "array": ("array",), "object": ("struct", "map"),
    "number": ("int", "smallint", "tinyint", "bigint", "double", "float", "decimal"),
}
VARIANT_TYPES = {
    "string": ("STRING",), "int": ("BIGINT",), "long": ("BIGINT",),
    "double": ("DOUBLE", "DECIMAL"), "decimal": ("DECIMAL",), "bool": ("BOOLEAN",),
    "array": ("ARRAY",), "object": ("OBJECT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "null": ("VOID",),
}


def _type_test(schema: T.StructType, path: str, name: str) -> Column:
    inside = variant_root(schema, path)
    if inside:
        found = F.schema_of_variant(F.try_variant_get(F.col(inside[0]), inside[1], "variant"))
        return reduce(lambda a, b: a | b, [found.startswith(p) for p in VARIANT_TYPES[name]])
    if name == "null":
        return F.col(path).isNull()
    kind = field_type(schema, path)
    fits = kind is not None and kind.simpleString().startswith(TYPE_PREFIXES[name])
    return F.col(path).isNotNull() & F.lit(fits)


def _exists(schema: T.StructType, path: str) -> Column:
    """A VARIANT keeps a JSON null apart from a missing field; columns cannot."""
    inside = variant_root(schema, path)
    if inside:
        return F.try_variant_get(F.col(inside[0]), inside[1], "variant").isNotNull()
    return F.col(path).isNotNull()


def _sample(op: str, value: Any) -> Any:
    if op in ("$in", "$nin", "$all", "$mod"):
        return next((v for v in value if v is not None), "")
    return 0 if op.startswith("$bits") else value


def _field_op(schema: T.StructType, path: str, op: str, value: Any, options: str) -> Column:
    if op == "$not":
        body = value if isinstance(value, dict) else {"$regex": value}
        return no(_field(schema, path, body))
    if op == "$ne":
        return no(_field_op(schema, path, "$eq", value, options))
    if op == "$nin":
        return no(_field_op(schema, path, "$in", value, options))
    if op == "$exists":
        return _exists(schema, path) if value else ~_exists(schema, path)
    if op == "$type":
        names = value if isinstance(value, list) else [value]
        return reduce(lambda a, b: a | b, [_type_test(schema, path, n) for n in names])
    c = _read(schema, path, _sample(op, value))
    kind = None if variant_root(schema, path) else field_type(schema, path)
    if isinstance(kind, T.ArrayType):
        if op == "$size":
            return F.size(c) == value
        if op == "$all":
            return reduce(lambda a, b: a & b, [F.array_contains(c, literal(v)) for v in value])
        if op == "$elemMatch":
            return F.exists(c, lambda x: _element(kind.elementType, x, value))
        if op == "$eq" and isinstance(value, list):
            return c == literal(value)
        return F.exists(c, lambda x: _test(x, op, value, options))
    if op == "$all":
        return reduce(lambda a, b: a & b, [c == literal(v) for v in value])
    return _test(c, op, value, options)


def _element(kind: T.DataType, x: Column, body: dict[str, Any]) -> Column:
    """``$elemMatch``: operators on the element, or a filter on its fields."""
    parts = []
    for key, value in body.items():
        if key == "$and":
            parts.extend(_element(kind, x, one) for one in value)
        elif key in ("$or", "$nor"):
            either = reduce(lambda a, b: a | b, [_element(kind, x, one) for one in value])
            parts.append(no(either) if key == "$nor" else either)
        elif key.startswith("$"):
            parts.append(no(_test(x, "$eq", value, "")) if key == "$ne" else _test(x, key, value, ""))
        else:
            field = x.getField(key)
            ops = value if isinstance(value, dict) else {"$eq": value}
            for op, v in ops.items():
                parts.append(no(_test(field, "$eq", v, "")) if op == "$ne" else _test(field, op, v, ""))
    return reduce(lambda a, b: a & b, parts)


def _field(schema: T.StructType, path: str, body: Any) -> Column:
    if isinstance(body, dict) and body and all(k.startswith("$") for k in body):
        options = body.get("$options", "")
        parts = [_field_op(schema, path, op, v, options) for op, v in body.items() if op != "$options"]
        return reduce(lambda a, b: a & b, parts)
    return _field_op(schema, path, "$eq", body, "")


def filter_document(schema: T.StructType, body: dict[str, Any]) -> Column:
    out = F.lit(True)
    for key, value in body.items():
        if key in ("$and", "$or", "$nor"):
            parts = [filter_document(schema, v) for v in value]
            if key == "$and":
                out = out & reduce(lambda a, b: a & b, parts)
            else:
                either = reduce(lambda a, b: a | b, parts)
                out = out & (no(either) if key == "$nor" else either)
        elif key == "$expr":
            out = out & expr(value)
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key}")
        else:
            out = out & _field(schema, key, value)
    return out


def match(df: DataFrame, body: dict[str, Any]) -> DataFrame:
    return df.where(filter_document(df.schema, body)) if body else df


# --- filter rules of a document browser ------------------------------------

RULE_MODES = {
    "equals": "$eq", "not-equals": "$ne", "greater-than": "$gt", "less-than": "$lt",
    "greater-or-equal": "$gte", "less-or-equal": "$lte", "exists": "$exists",
}


def rule_filter(rule: dict[str, Any]) -> dict[str, Any]:
    """One rule as a filter; ``contains`` is an escaped regex ignoring case."""
    if rule["mode"] == "contains":
        return {rule["field"]: {"$regex": re.escape(str(rule["value"])), "$options": "i"}}
    return {rule["field"]: {RULE_MODES[rule["mode"]]: rule.get("value", True)}}


def document_filter_rule(schema: T.StructType, rules: list[dict[str, Any]]) -> dict[str, Any]:
    """Left-associated AND/OR over the rules. Leading AND-ed rules on fields of
    the same array of objects must hold for one element, so they become one
    ``$elemMatch``."""
    rules = [r for r in rules if r.get("field") and (r["mode"] == "exists" or r.get("value") is not None)]
    if not rules:
        return {}
    head, rest = rules[0]["field"].partition(".")[0], rules[1:]
    kind = schema[head].dataType if head in schema.names else None
    of_objects = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    if of_objects and "." in rules[0]["field"]:
        group = [rules[0]]
        while rest and rest[0]["field"].startswith(head + ".") and rest[0].get("joiner", "and") == "and":
            group.append(rest.pop(0))
        tests = [
            {path.partition(".")[2]: test} for r in group for path, test in rule_filter(r).items()
        ]
        out: dict[str, Any] = {head: {"$elemMatch": {"$and": tests}}}
    else:
        out = rule_filter(rules[0])
    for r in rest:
        joiner = "$or" if r.get("joiner", "and") == "or" else "$and"
        out = {joiner: [out, rule_filter(r)]}
    return out
