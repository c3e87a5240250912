"""Grid filters: one rule, a list of rules, typed text values and IN lists."""

from __future__ import annotations

import decimal
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = (
    "equals", "not-equals", "is-null", "is-not-null", "like", "not-like",
    "less-than", "greater-than", "in", "not-in", "between", "not-between",
)


def filter_rule(column: str, mode: str, value: Any = None, other: Any = None) -> Column | None:
    """The predicate of one rule; None when the rule is incomplete."""
    c = F.col(column)
    if mode not in MODES:
        raise ValueError(f"unknown filter mode {mode}")
    if mode == "is-null" or (mode == "equals" and value is None):
        return c.isNull()
    if mode == "is-not-null" or (mode == "not-equals" and value is None):
        return c.isNotNull()
    if mode in ("in", "not-in"):
        return filter_in(column, value or [], negate=mode == "not-in")
    if mode in ("between", "not-between"):
        if value is None or other is None:
            return None
        inside = c.between(value, other)
        return ~inside if mode == "not-between" else inside
    if mode == "equals":
        return c == F.lit(value)
    if mode == "not-equals":
        return c != F.lit(value)
    if mode in ("like", "not-like"):
        match = c.cast("string").like(f"%{'NULL' if value is None else value}%")
        return ~match if mode == "not-like" else match
    return c < F.lit(value) if mode == "less-than" else c > F.lit(value)


def filter_in(column: str, values: list[Any], negate: bool = False) -> Column | None:
    """IN with explicit NULL handling; an empty list is no predicate."""
    c = F.col(column)
    real = list(dict.fromkeys(v for v in values if v is not None))
    null = any(v is None for v in values)
    if not real:
        return (c.isNotNull() if negate else c.isNull()) if null else None
    if negate:
        return c.isNotNull() & ~c.isin(real)
    return (c.isNull() | c.isin(real)) if null else c.isin(real)


def filter_builder(rules: list[dict[str, Any]]) -> Column | None:
    """Left-associated ``((a) AND (b)) OR (c)``; disabled and incomplete rules
    are skipped. A rule is ``{column, mode, value, other, joiner, enabled}``; a value
    of None is NULL, a rule without its value is incomplete."""
    out = None
    for rule in rules:
        if not rule.get("enabled", True) or not rule.get("column"):
            continue
        if rule["mode"] not in ("is-null", "is-not-null") and "value" not in rule:
            continue
        one = filter_rule(rule["column"], rule["mode"], rule.get("value"), rule.get("other"))
        if one is None:
            continue
        if out is None:
            out = one
        else:
            out = out | one if str(rule.get("joiner", "and")).lower() == "or" else out & one
    return out


def apply_filter(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def unquote(text: str) -> tuple[str, bool]:
    """Text without matching quotes around it, and whether it had them."""
    raw = text.strip()
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "'\"":
        return raw[1:-1].replace(raw[0] * 2, raw[0]), True
    return raw, False


def parse_value(text: str, kind: T.DataType) -> Any:
    """Typed value of filter text; bare ``null`` is NULL, text that does not fit the
    type stays text."""
    raw, quoted = unquote(text)
    if not quoted and raw.lower() == "null":
        return None
    if isinstance(kind, T.BooleanType) and raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    if isinstance(kind, T.NumericType) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", raw):
        if re.fullmatch(r"[+-]?\d+", raw):
            return int(raw)
        # A decimal column keeps the exact spelling.
        return decimal.Decimal(raw) if isinstance(kind, T.DecimalType) else float(raw)
    return raw


def parse_list(text: str, kind: T.DataType) -> list[Any]:
    """Comma or line separated values; quotes protect separators."""
    items = re.findall(r"\s*(?:'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")[^,\r\n]*|[^,\r\n]+", text)
    return [parse_value(i, kind) for i in items if i.strip()]


def filter_parse_value(df: DataFrame, column: str, mode: str, text: str = "", other: str = ""):
    kind = df.schema[column].dataType
    if mode in ("in", "not-in"):
        return filter_rule(column, mode, parse_list(text, kind))
    value = parse_value(text, kind) if text != "" else None
    upper = parse_value(other, kind) if other != "" else None
    return filter_rule(column, mode, value, upper)


# Lists up to this length stay in the plan as a hash-set predicate; longer ones give the
# same rows by a join.
INLINE_LIST = 1000


def filter_in_list(df: DataFrame, column: str, values: list[Any] | DataFrame) -> DataFrame:
    """Rows whose value is in a pasted list; a NULL in the list stands for missing
    values, and a list without values, given either way, is no filter. Short lists push
    down to the scan; a longer list or a DataFrame becomes a null-safe semi join, with the
    same result, and Spark picks the side."""
    if isinstance(values, list) and len(values) <= INLINE_LIST:
        return apply_filter(df, filter_in(column, values))
    if isinstance(values, list):
        kind = df.schema[column].dataType
        wanted = list(dict.fromkeys(values))
        values = df.sparkSession.createDataFrame([(v,) for v in wanted], T.StructType([T.StructField("v", kind)]))
    elif values.isEmpty():
        return df
    wanted = values.select(F.col(values.columns[0]).alias("_v"))
    return df.join(wanted, F.col(column).eqNullSafe(F.col("_v")), "left_semi")


# --- search-server style predicates ---------------------------------------

def wildcard(column: Column, pattern: str) -> Column:
    """LIKE: ``p%`` is a case-sensitive prefix, anything else ignores case."""
    body = pattern[:-1]
    if pattern.endswith("%") and body and "%" not in body and "_" not in body:
        return column.startswith(body)
    return column.ilike(pattern)


def filter_search_bool(spec: Any) -> Column:
    """Compile ``["and", a, b] | ["or", ...] | ["not", a] | [op, column, value]``
    with op ``= != < <= > >= like not-like in not-in between null not-null``."""
    op, *args = spec
    if op in ("and", "or"):
        parts = [filter_search_bool(a) for a in args]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":
        return ~F.coalesce(filter_search_bool(args[0]), F.lit(False))
    c = F.col(args[0])
    if op == "null":
        return c.isNull()
    if op == "not-null":
        return c.isNotNull()
    value = args[1]
    table = {
        "=": lambda: c == value, "<": lambda: c < value, "<=": lambda: c <= value,
        ">": lambda: c > value, ">=": lambda: c >= value,
        "like": lambda: wildcard(c, value), "in": lambda: c.isin(list(value)),
        "between": lambda: c.between(value, args[2]),
        # must_not clauses also keep rows without the field
        "!=": lambda: ~F.coalesce(c == value, F.lit(False)),
        "not-like": lambda: ~F.coalesce(wildcard(c, value), F.lit(False)),
        "not-in": lambda: ~F.coalesce(c.isin(list(value)), F.lit(False)),
    }
    return table[op]()


def tokens(column: Column) -> Column:
    return F.split(F.lower(column), r"[^\p{L}\p{N}]+")


def search_clause(clause: dict[str, Any]) -> Column:
    """One clause: match, match_phrase, term, terms, wildcard, exists or range."""
    kind, body = next(iter(clause.items()))
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    field, value = next(iter(body.items()))
    c = F.col(field)
    if kind == "match":
        words = [w for w in re.split(r"[^\w]+|_", str(value).lower()) if w]
        return F.arrays_overlap(tokens(c), F.array(*[F.lit(w) for w in words]))
    if kind == "match_phrase":
        words = [w for w in re.split(r"[^\w]+|_", str(value).lower()) if w]
        gap = r"[^\p{L}\p{N}]+"
        edge = r"(^|[^\p{L}\p{N}])", r"($|[^\p{L}\p{N}])"
        return F.lower(c).rlike(edge[0] + gap.join(re.escape(w) for w in words) + edge[1])
    if kind == "term":
        return c == F.lit(value)
    if kind == "terms":
        return c.isin(list(value))
    if kind == "wildcard":
        like = str(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return c.ilike(like.replace("*", "%").replace("?", "_"))
    if kind == "range":
        ops = {"gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
        return reduce(lambda a, b: a & b, [ops[k](F.lit(v)) for k, v in value.items()])
    raise ValueError(f"unknown search clause {kind}")


def filter_search_clauses(query: dict[str, list[dict[str, Any]]]) -> Column:
    """must and filter all hold, one should holds if any is given, no must_not."""
    out = F.lit(True)
    for clause in [*query.get("must", []), *query.get("filter", [])]:
        out = out & search_clause(clause)
    if query.get("should"):
        out = out & reduce(lambda a, b: a | b, [search_clause(c) for c in query["should"]])
    for clause in query.get("must_not", []):
        out = out & ~F.coalesce(search_clause(clause), F.lit(False))
    return out


def filter_null_equality(column: str, missing: bool) -> Column:
    """``field: null`` finds rows without it, ``$ne null`` rows with it."""
    return F.col(column).isNull() if missing else F.col(column).isNotNull()

