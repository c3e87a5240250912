"""Document expressions as Columns.

``expr({"$add": ["$a", 1]})`` gives ``a + 1``. ``"$a.b"`` names a field,
``"$$x"`` a variable bound by ``$let``, ``$map``, ``$filter`` or ``$reduce``.
Everything stays a built-in Column expression.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date format letters and their Spark pattern.
DATE_LETTERS = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%L": "SSS", "%j": "DDD", "%%": "'%'",
}
DATE_PARTS = (
    "$year", "$month", "$dayOfMonth", "$dayOfYear", "$dayOfWeek", "$hour", "$minute", "$second", "$millisecond",
    "$week", "$isoWeek", "$isoWeekYear", "$isoDayOfWeek",
)
UNITS = {
    "year": "YEAR", "quarter": "QUARTER", "month": "MONTH", "week": "WEEK", "day": "DAY",
    "hour": "HOUR", "minute": "MINUTE", "second": "SECOND", "millisecond": "MILLISECOND",
}
CAST_NAMES = {
    "string": "string", "int": "int", "long": "bigint", "double": "double",
    "decimal": "decimal(38,10)", "bool": "boolean", "date": "timestamp",
}


def date_pattern(fmt: str) -> str:
    parts = re.split(r"(%[A-Za-z%])", fmt)
    return "".join(
        DATE_LETTERS[p] if p in DATE_LETTERS else re.sub(r"([A-Za-z]+)", r"'\1'", p) for p in parts
    )


def literal(value: Any) -> Column:
    if isinstance(value, list):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def expr(value: Any, env: dict[str, Column] | None = None) -> Column:
    env = env or {}
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and value.startswith("$$"):
        name, _, rest = value[2:].partition(".")
        out = env[name]
        for part in rest.split(".") if rest else []:
            out = out.getField(part)
        return out
    if isinstance(value, str) and value.startswith("$"):
        return F.col(value[1:])
    if isinstance(value, list):
        return F.array(*[expr(v, env) for v in value])
    if isinstance(value, dict):
        if len(value) == 1 and next(iter(value)).startswith("$"):
            op, arg = next(iter(value.items()))
            return _apply(op, arg, env)
        return F.struct(*[expr(v, env).alias(k) for k, v in value.items()])
    return literal(value)


def _apply(op: str, arg: Any, env: dict[str, Column]) -> Column:
    if op in FORMS:
        return FORMS[op](arg, env)
    if op not in CALLS:
        raise ValueError(f"unknown expression operator {op}")
    if op in DATE_PARTS and isinstance(arg, dict) and "date" in arg:
        _only(op, arg, "date", "timezone")
        return CALLS[op](_local(arg, env))
    args = arg if isinstance(arg, list) else [arg]
    return CALLS[op](*[expr(a, env) for a in args])


def _fold(fn: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *args: reduce(fn, args)


# --- numbers -------------------------------------------------------------

def trunc(x: Column, places: Column | None = None) -> Column:
    scale = F.lit(1.0) if places is None else F.pow(F.lit(10.0), places)
    scaled = x * scale
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / scale


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


# --- text ----------------------------------------------------------------

def find_text(text: Column, part: Column) -> Column:
    """0-based code point position, -1 when absent."""
    return F.instr(text, part) - 1


def find_bytes(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at == 0, -1).otherwise(F.octet_length(F.substring(text, F.lit(1), at - 1)))


def substr(text: Column, start: Column, count: Column) -> Column:
    return F.substring(text, start + 1, F.when(count < 0, F.lit(2**31 - 1)).otherwise(count))


def substr_bytes(text: Column, start: Column, count: Column) -> Column:
    """0-based bytes of the UTF-8 text; a negative count takes the rest."""
    return substr(text.cast("binary"), start, count).cast("string")


def replace_one(text: Column, find: Column, new: Column) -> Column:
    at = F.instr(text, find)
    tail = F.substring(text, at + F.char_length(find), F.lit(2**31 - 1))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, tail)).otherwise(text)


def literal_split(text: Column, mark: Column) -> Column:
    return F.split(text, F.concat(F.lit("\\Q"), mark, F.lit("\\E")))


def _trim(side: str):
    def form(arg, env):
        text = expr(arg["input"], env)
        chars = arg.get("chars")
        fn = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]
        return fn(text) if chars is None else fn(text, F.lit(chars))
    return form


def _regex(kind: str):
    def form(arg, env):
        text, pattern = expr(arg["input"], env), arg["regex"]
        if "i" in arg.get("options", ""):
            pattern = f"(?i){pattern}"
        pattern = F.lit(pattern)
        if kind == "match":
            return F.regexp_like(text, pattern)
        if kind == "all":
            return F.regexp_extract_all(text, pattern, F.lit(0))
        found = F.regexp_substr(text, pattern)
        return F.when(
            found.isNotNull(),
            F.struct(found.alias("match"), (F.instr(text, found) - 1).alias("idx")),
        )
    return form


def _replace(fn):
    return lambda arg, env: fn(
        expr(arg["input"], env), expr(arg["find"], env), expr(arg["replacement"], env)
    )


# --- arrays --------------------------------------------------------------

def element(array: Column, index: Column) -> Column:
    """0-based, negative from the end, NULL outside."""
    return F.try_element_at(array, F.when(index < 0, index).otherwise(index + 1).cast("int"))


def slice_of(array: Column, *args: Column) -> Column:
    if len(args) == 1:
        n = args[0]
        return F.when(n >= 0, F.slice(array, F.lit(1), F.abs(n))).otherwise(
            F.slice(array, F.greatest(F.size(array) + n + 1, F.lit(1)), F.abs(n))
        )
    start, n = args
    first = F.when(start < 0, F.greatest(F.size(array) + start + 1, F.lit(1))).otherwise(start + 1)
    return F.slice(array, first, n)


def index_of(array: Column, value: Column) -> Column:
    return (F.array_position(array, value) - 1).cast("int")


def number_range(start: Column, end: Column, step: Column | None = None) -> Column:
    step = F.lit(1) if step is None else step
    last = F.when(step > 0, end - 1).otherwise(end + 1)
    empty = F.when(step > 0, start >= end).otherwise(start <= end)
    safe = F.when(empty, start).otherwise(last)
    return F.when(empty, F.slice(F.array(start), F.lit(1), F.lit(0))).otherwise(
        F.sequence(start, safe, F.when(empty, F.lit(1)).otherwise(step))
    )


def _map(arg, env):
    name = arg.get("as", "this")
    return F.transform(expr(arg["input"], env), lambda x: expr(arg["in"], {**env, name: x}))


def _filter(arg, env):
    name = arg.get("as", "this")
    return F.filter(expr(arg["input"], env), lambda x: expr(arg["cond"], {**env, name: x}))


def _reduce(arg, env):
    return F.aggregate(
        expr(arg["input"], env), expr(arg["initialValue"], env),
        lambda acc, x: expr(arg["in"], {**env, "value": acc, "this": x}),
    )


def _sort_array(arg, env):
    array, by = expr(arg["input"], env), arg["sortBy"]
    if by in (1, -1):
        return F.sort_array(array, asc=by == 1)
    fields = list(by.items())

    def order(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, way in reversed(fields):
            x, y = a.getField(name), b.getField(name)
            out = F.when(x < y, -way).when(x > y, way).otherwise(out)
        return out

    return F.array_sort(array, order)


def _zip(arg, env):
    arrays = [expr(a, env) for a in arg["inputs"]]
    n = (F.greatest if arg.get("useLongestLength") else F.least)(*[F.size(a) for a in arrays])
    last = F.greatest(n, F.lit(1)) - 1
    rows = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.array(*[F.get(a, i) for a in arrays])
    )
    return F.slice(rows, F.lit(1), n)


# --- sets ----------------------------------------------------------------

def set_equals(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


# --- dates ---------------------------------------------------------------

def _only(op: str, arg: dict, *known: str) -> None:
    """Refuse options that are not handled, instead of ignoring them."""
    if unknown := set(arg) - set(known):
        raise ValueError(f"{op}: unknown option {', '.join(sorted(unknown))}")


def _local(arg, env, name: str = "date") -> Column:
    """The wall-clock time of a date in the wanted zone (times are kept in UTC)."""
    at = expr(arg[name], env)
    if arg.get("timezone") is None:
        return at
    return F.convert_timezone(F.lit("UTC"), expr(arg["timezone"], env), at)


def _utc(arg, env, at: Column) -> Column:
    if arg.get("timezone") is None:
        return at
    return F.convert_timezone(expr(arg["timezone"], env), F.lit("UTC"), at)


def _unit(arg, env, sign=1):
    _only("$dateSubtract" if sign < 0 else "$dateAdd", arg, "startDate", "unit", "amount", "timezone")
    unit, n = UNITS[arg["unit"]], expr(arg["amount"], env)
    return _utc(arg, env, F.timestamp_add(unit, (n * sign).cast("int"), _local(arg, env, "startDate")))


WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
_FIXED = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _weekday(name: str) -> int:
    """0 for Sunday; full names or their first three letters."""
    return next(i for i, d in enumerate(WEEKDAYS) if d.startswith(name.lower()) and len(name) >= 3)


def date_bin(at: Column, unit: str, size: int, first: int = 0) -> Column:
    """Start of the bin of ``size`` units, counted from 2000-01-01 (weeks from the first
    such weekday after it)."""
    if unit in _MONTHS:
        step = size * _MONTHS[unit]
        months = (F.year(at) - 2000) * 12 + F.month(at) - 1
        start = F.lit("2000-01-01").cast("timestamp_ntz")
        return F.timestamp_add("MONTH", (F.floor(months / step) * step).cast("int"), start)
    # 2000-01-01 was a Saturday.
    day = 1 + (first - 6) % 7 if unit == "week" else 1
    start = F.lit(f"2000-01-{day:02d}").cast("timestamp_ntz")
    step = size * _FIXED[unit]
    passed = F.timestamp_diff("MILLISECOND", start, at)
    # The difference is cut towards zero, so a time before the start may lie in the bin before.
    whole = F.when(F.timestamp_add("MILLISECOND", passed, start) > at, passed - 1).otherwise(passed)
    return F.timestamp_add("MILLISECOND", F.floor(whole / step) * step, start)


def _trunc(arg, env):
    _only("$dateTrunc", arg, "date", "unit", "binSize", "timezone", "startOfWeek")
    at, unit, size = _local(arg, env), arg["unit"], int(arg.get("binSize", 1))
    first = _weekday(arg.get("startOfWeek", "sunday"))
    plain = size == 1 and (unit != "week" or first == 0)
    return _utc(arg, env, date_trunc(unit, at) if plain else date_bin(at, unit, size, first))


def _diff(arg, env):
    _only("$dateDiff", arg, "startDate", "endDate", "unit", "timezone", "startOfWeek")
    start, end, unit = _local(arg, env, "startDate"), _local(arg, env, "endDate"), arg["unit"]
    first = _weekday(arg.get("startOfWeek", "sunday"))
    if unit != "week" or first == 0:
        return date_diff(unit, start, end)
    return F.timestamp_diff("WEEK", date_bin(start, unit, 1, first), date_bin(end, unit, 1, first))


def _date_text(arg, env):
    _only("$dateToString", arg, "date", "format", "timezone", "onNull")
    at, utc = _local(arg, env), expr(arg["date"], env)
    minutes = F.timestamp_diff("MINUTE", utc.cast("timestamp_ntz"), at.cast("timestamp_ntz"))
    sign, far = F.when(minutes < 0, "-").otherwise("+"), F.abs(minutes)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    computed = {
        "%G": lambda: F.lpad(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), 4, "0"),
        "%V": lambda: two(F.weekofyear(at)), "%u": lambda: F.extract(F.lit("DAYOFWEEK_ISO"), at).cast("string"),
        "%w": lambda: F.dayofweek(at).cast("string"), "%U": lambda: two(sunday_week(at)),
        "%z": lambda: F.concat(sign, two(F.floor(far / 60)), two(far % 60)), "%Z": lambda: minutes.cast("string"),
        "%%": lambda: F.lit("%"),
    }
    parts = []
    for part in re.split(r"(%.)", arg.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")):
        if part in computed:
            parts.append(computed[part]())
        elif part in DATE_LETTERS:
            parts.append(F.date_format(at, DATE_LETTERS[part]))
        elif part.startswith("%"):
            raise ValueError(f"$dateToString: unknown format letter {part}")
        elif part:
            parts.append(F.lit(part))
    text = F.when(at.isNotNull(), F.concat(*parts)) if parts else F.lit("")
    return F.coalesce(text, expr(arg["onNull"], env)) if "onNull" in arg else text


def _date_of_text(arg, env):
    _only("$dateFromString", arg, "dateString", "format", "timezone", "onError", "onNull")
    raw = expr(arg["dateString"], env)
    out = raw.try_cast("timestamp")
    if "format" in arg:
        out = F.coalesce(F.try_to_timestamp(raw, F.lit(date_pattern(arg["format"]))), out)
    out = _utc(arg, env, out) if arg.get("timezone") is not None else out
    if "onError" in arg:
        out = F.coalesce(out, expr(arg["onError"], env))
    return F.when(raw.isNull(), expr(arg["onNull"], env)).otherwise(out) if "onNull" in arg else F.when(raw.isNotNull(), out)


def date_trunc(unit: str, at: Column) -> Column:
    """Truncate; weeks start on Sunday."""
    if unit == "week":
        day = F.date_trunc("DAY", at)
        return F.timestamp_add("DAY", -(F.dayofweek(at) - 1), day)
    return F.date_trunc(UNITS[unit], at)


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of unit borders crossed between the two times."""
    return F.timestamp_diff(UNITS[unit], date_trunc(unit, start), date_trunc(unit, end))


def sunday_week(at: Column) -> Column:
    """Week 0-53; week 1 starts at the first Sunday."""
    return F.floor((F.dayofyear(at) + 7 - F.dayofweek(at)) / 7).cast("int")


def _date_parts(arg, env):
    _only("$dateToParts", arg, "date", "timezone")
    at = _local(arg, env)
    parts = {
        "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at),
        "minute": F.minute(at), "second": F.second(at), "millisecond": millisecond(at),
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def millisecond(at: Column) -> Column:
    return F.date_format(at, "SSS").cast("int")


def _from_parts(arg, env):
    _only("$dateFromParts", arg, "year", "month", "day", "hour", "minute", "second", "millisecond", "timezone")
    part = lambda name, start: expr(arg.get(name, start), env)
    seconds = part("second", 0) + part("millisecond", 0) / 1000
    return _utc(arg, env, F.make_timestamp_ntz(
        part("year", 1970), part("month", 1), part("day", 1), part("hour", 0),
        part("minute", 0), seconds,
    ))


# --- conversion ----------------------------------------------------------

def _convert(arg, env):
    value = expr(arg["input"], env)
    out = value.try_cast(CAST_NAMES[arg["to"]])
    if "onError" in arg:
        out = F.coalesce(out, expr(arg["onError"], env))
    if "onNull" in arg:
        return F.when(value.isNull(), expr(arg["onNull"], env)).otherwise(out)
    return F.when(value.isNotNull(), out)


def _cast(name: str):
    return lambda x: x.try_cast(CAST_NAMES[name])


def type_name(x: Column) -> Column:
    kind = F.typeof(x)
    return (
        F.when(x.isNull(), "null")
        .when(kind == "bigint", "long")
        .when(kind.isin("int", "smallint", "tinyint"), "int")
        .when(kind.isin("double", "float"), "double")
        .when(kind.startswith("decimal"), "decimal")
        .when(kind == "boolean", "bool")
        .when(kind.startswith("timestamp") | (kind == "date"), "date")
        .when(kind.startswith("array"), "array")
        .when(kind.startswith("struct") | kind.startswith("map"), "object")
        .otherwise(kind)
    )


def is_number(x: Column) -> Column:
    return type_name(x).isin("int", "long", "double", "decimal")


# --- control -------------------------------------------------------------

def _cond(arg, env):
    if isinstance(arg, list):
        arg = {"if": arg[0], "then": arg[1], "else": arg[2]}
    return F.when(expr(arg["if"], env), expr(arg["then"], env)).otherwise(expr(arg["else"], env))


def _switch(arg, env):
    out = None
    for branch in arg["branches"]:
        test, then = expr(branch["case"], env), expr(branch["then"], env)
        out = F.when(test, then) if out is None else out.when(test, then)
    return out.otherwise(expr(arg["default"], env)) if "default" in arg else out


def _let(arg, env):
    bound = {k: expr(v, env) for k, v in arg["vars"].items()}
    return expr(arg["in"], {**env, **bound})


def merge_objects(*maps: Column) -> Column:
    """Later maps win on equal keys."""
    def two(a, b):
        kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
        return F.map_concat(kept, b)
    return reduce(two, maps)


def _set_field(arg, env):
    return expr(arg["input"], env).withField(arg["field"], expr(arg["value"], env))


def _get_field(arg, env):
    if isinstance(arg, str):
        return F.col(arg)
    return expr(arg["input"], env).getField(arg["field"])


CALLS: dict[str, Callable[..., Column]] = {
    # comparison and logic
    "$eq": lambda a, b: a.eqNullSafe(b),
    "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
    "$cmp": compare,
    "$and": _fold(lambda a, b: a & b),
    "$or": _fold(lambda a, b: a | b),
    "$not": lambda a: ~a,
    "$ifNull": F.coalesce,
    # numbers
    "$add": _fold(lambda a, b: a + b),
    "$subtract": lambda a, b: a - b,
    "$multiply": _fold(lambda a, b: a * b),
    "$divide": lambda a, b: a / b,
    "$mod": lambda a, b: a % b,
    "$abs": F.abs,
    "$ceil": F.ceil,
    "$floor": F.floor,
    "$trunc": trunc,
    "$pow": F.pow,
    "$sqrt": F.sqrt,
    "$ln": F.ln,
    "$log": lambda x, base: F.ln(x) / F.ln(base),
    "$log10": F.log10,
    "$exp": F.exp,
    # text
    "$concat": F.concat,
    "$split": literal_split,
    "$substr": substr,
    "$substrCP": substr,
    "$substrBytes": substr_bytes,
    "$strLenCP": F.char_length,
    "$strLenBytes": F.octet_length,
    "$strcasecmp": lambda a, b: compare(F.upper(a), F.upper(b)),
    "$toLower": F.lower,
    "$toUpper": F.upper,
    "$indexOfCP": find_text,
    "$indexOfBytes": find_bytes,
    # arrays
    "$size": F.size,
    "$arrayElemAt": element,
    "$first": lambda a: F.try_element_at(a, F.lit(1)),
    "$last": lambda a: F.try_element_at(a, F.lit(-1)),
    "$slice": slice_of,
    "$in": lambda v, a: F.array_contains(a, v),
    "$indexOfArray": index_of,
    "$concatArrays": F.concat,
    "$reverseArray": F.reverse,
    "$range": number_range,
    "$isArray": lambda a: F.typeof(a).startswith("array"),
    "$arrayToObject": F.map_from_entries,
    "$objectToArray": F.map_entries,
    "$mergeObjects": merge_objects,
    # sets
    "$setUnion": F.array_union,
    "$setIntersection": F.array_intersect,
    "$setDifference": F.array_except,
    "$setEquals": set_equals,
    "$setIsSubset": lambda a, b: F.size(F.array_except(a, b)) == 0,
    "$allElementsTrue": lambda a: F.forall(a, lambda x: F.coalesce(x, F.lit(False))),
    "$anyElementTrue": lambda a: F.exists(a, lambda x: F.coalesce(x, F.lit(False))),
    # dates
    "$year": F.year,
    "$month": F.month,
    "$dayOfMonth": F.dayofmonth,
    "$dayOfYear": F.dayofyear,
    "$dayOfWeek": F.dayofweek,
    "$hour": F.hour,
    "$minute": F.minute,
    "$second": F.second,
    "$millisecond": millisecond,
    "$week": sunday_week,
    "$isoWeek": F.weekofyear,
    "$isoWeekYear": lambda x: F.extract(F.lit("YEAROFWEEK"), x),
    "$isoDayOfWeek": lambda x: F.extract(F.lit("DAYOFWEEK_ISO"), x),
    # conversion
    "$type": type_name,
    "$isNumber": is_number,
    "$toString": _cast("string"),
    "$toInt": _cast("int"),
    "$toLong": _cast("long"),
    "$toDouble": _cast("double"),
    "$toDecimal": _cast("decimal"),
    "$toBool": _cast("bool"),
    "$toDate": _cast("date"),
}

FORMS: dict[str, Callable[[Any, dict[str, Column]], Column]] = {
    "$literal": lambda arg, env: literal(arg),
    "$cond": _cond,
    "$switch": _switch,
    "$let": _let,
    "$rand": lambda arg, env: F.rand((arg or {}).get("seed", 0)),
    "$round": lambda arg, env: (
        F.bround(expr(arg[0], env), arg[1] if len(arg) > 1 else 0)
        if isinstance(arg, list) else F.bround(expr(arg, env), 0)
    ),
    "$trim": _trim("both"),
    "$ltrim": _trim("left"),
    "$rtrim": _trim("right"),
    "$replaceOne": _replace(replace_one),
    "$replaceAll": _replace(F.replace),
    "$regexMatch": _regex("match"),
    "$regexFind": _regex("find"),
    "$regexFindAll": _regex("all"),
    "$map": _map,
    "$filter": _filter,
    "$reduce": _reduce,
    "$sortArray": _sort_array,
    "$zip": _zip,
    "$getField": _get_field,
    "$setField": _set_field,
    "$convert": _convert,
    "$dateToString": _date_text,
    "$dateFromString": _date_of_text,
    "$dateToParts": _date_parts,
    "$dateFromParts": _from_parts,
    "$dateAdd": _unit,
    "$dateSubtract": lambda arg, env: _unit(arg, env, -1),
    "$dateDiff": _diff,
    "$dateTrunc": _trunc,
}
