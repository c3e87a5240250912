"""Window stages that cope with keys of any size (see segments)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import expr
from tablewright.operators.aggregates import join_null_safe, top_per_group
from tablewright.operators.segments import (
    _fits_one_task,
    nearest,
    position,
    previous_row,
    running,
    sliding,
    with_running_index,
)

MICROS = {
    "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
    "week": 604_800_000_000, "millisecond": 1000,
}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
_FRAME = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$count": F.count}
_FRAME_MORE = {
    "$first": F.first, "$last": F.last, "$push": F.collect_list, "$addToSet": F.collect_set,
    "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp,
}
_PLACES = {"$documentNumber": F.row_number, "$rank": F.rank, "$denseRank": F.dense_rank}


def _keys(df: DataFrame, by: Any) -> tuple[DataFrame, list[str], list[str]]:
    if by is None:
        return df.withColumn("_all", F.lit(0)), ["_all"], ["_all"]
    if isinstance(by, str):
        return df, [by.lstrip("$")], []
    names = []
    for name, value in by.items():
        df = df.withColumn(f"_by_{name}", expr(value))
        names.append(f"_by_{name}")
    return df, names, names


def set_window_fields(
    df: DataFrame, by: Any, sort_by: dict[str, int], output: dict[str, dict[str, Any]],
    segments: int | None = None,
) -> DataFrame:
    """Add fields over a window. ``output`` maps a name to
    ``{"$sum": expr, "window": {"documents": [lo, hi]} | {"range": [lo, hi], "unit": u}}``
    with ``$sum $avg $min $max $count $first $last $push $addToSet $stdDevPop $stdDevSamp``
    over any frame (bounds are numbers, ``current`` or ``unbounded``; without a window
    the whole key), ``$documentNumber $rank $denseRank`` and ``$shift`` with a default.
    ``sort_by`` takes both directions.

    Keys that fit a task use plain windows, which share one shuffle. Greater keys are
    cut into segments if all outputs can be (ranks, shifts, sums, averages, extremes and
    counts over the whole key, up to or from the current row, or a bounded frame); the
    result is the same."""
    rows, keys, scratch = _keys(df, by)
    for name, spec in output.items():
        op = next(k for k in spec if k != "window")
        if op not in _FRAME | _FRAME_MORE | _PLACES and op != "$shift":
            raise ValueError(f"unknown window operator {op}")
    if all(map(_can_be_cut, output.values())) and not _fits_one_task(rows, keys, segments):
        return _cut_window_fields(rows, keys, scratch, sort_by, output, segments)
    order = [F.col(c).asc_nulls_first() if way > 0 else F.col(c).desc_nulls_last() for c, way in sort_by.items()]
    whole = Window.partitionBy(*keys)
    inside = whole.orderBy(*order) if order else whole
    out = {}
    for name, spec in output.items():
        window = spec.get("window") or {}
        op, arg = next((k, v) for k, v in spec.items() if k != "window")
        if op in _PLACES:
            out[name] = _PLACES[op]().over(inside)
        elif op == "$shift":
            default = None if arg.get("default") is None else expr(arg["default"])
            moved = F.struct(expr(arg["output"]).alias("v"))
            near = F.lag(moved, -arg["by"]).over(inside) if arg["by"] < 0 else F.lead(moved, arg["by"]).over(inside)
            # A struct tells a missing row from a NULL value.
            out[name] = near["v"] if default is None else F.when(near.isNull(), default).otherwise(near["v"])
        else:
            value = (_FRAME | _FRAME_MORE)[op](_value(op, arg))
            out[name] = value.over(_frame(rows, whole, inside, sort_by, window))
    return rows.withColumns(out).drop(*scratch)


def _can_be_cut(spec: dict[str, Any]) -> bool:
    window = spec.get("window") or {}
    op, arg = next((k, v) for k, v in spec.items() if k != "window")
    docs = window.get("documents")
    if op in _PLACES:
        return True
    if op == "$shift":
        return arg.get("default") is None
    whole = (["unbounded", "unbounded"], ["unbounded", "current"], ["current", "unbounded"])
    open_ended = bool(docs) and "unbounded" in docs and docs not in whole
    return op in _FRAME and not open_ended and "unbounded" not in (window.get("range") or [])


def _frame(rows: DataFrame, whole: Any, inside: Any, sort_by: dict[str, int], window: dict[str, Any]) -> Any:
    docs, reach = window.get("documents"), window.get("range")
    if not docs and not reach:
        return whole

    def bound(x: Any, low: bool, unit: int = 1) -> int:
        if x == "unbounded":
            return Window.unboundedPreceding if low else Window.unboundedFollowing
        return 0 if x == "current" else x * unit

    if docs:
        return inside.rowsBetween(bound(docs[0], True), bound(docs[1], False))
    name, way = next(iter(sort_by.items()))
    unit = MICROS[window["unit"]] if "unit" in window else 1
    place = position(rows, name) * way
    return whole.orderBy(place.asc_nulls_first()).rangeBetween(bound(reach[0], True, unit), bound(reach[1], False, unit))


def _ascending(rows: DataFrame, sort_by: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """Columns whose rising order is the wanted one."""
    if all(way > 0 for way in sort_by.values()):
        return rows, list(sort_by)
    if all(isinstance(rows.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) for c in sort_by):
        turned = {}
        for i, (c, way) in enumerate(sort_by.items()):
            place = position(rows, c)
            turned[f"_o{i}"] = place if way > 0 else F.coalesce(-place, F.lit(float("inf")))
        return rows.withColumns(turned), list(turned)
    order = [F.col(c).asc_nulls_first() if way > 0 else F.col(c).desc_nulls_last() for c, way in sort_by.items()]
    return with_running_index(rows, order, "_o0"), ["_o0"]


def _cut_window_fields(
    rows: DataFrame, keys: list[str], scratch: list[str], sort_by: dict[str, int], output: dict[str, dict[str, Any]],
    segments: int | None,
) -> DataFrame:
    onward = [n for n, s in output.items() if (s.get("window") or {}).get("documents") == ["current", "unbounded"]]
    if onward:
        # From the current row on is up to the current row, seen from the end.
        back = {n: {**output[n], "window": {"documents": ["unbounded", "current"]}} for n in onward}
        turned = {c: -way for c, way in sort_by.items()}
        rows = _cut_window_fields(rows, keys, [], turned, back, segments)
        output = {n: s for n, s in output.items() if n not in onward}
    names = rows.columns
    rows, order = _ascending(rows, sort_by)
    ranks = {n: next(op for op in s if op != "window") for n, s in output.items()}
    ranks = {n: op for n, op in ranks.items() if op in ("$rank", "$denseRank")}
    output = {n: s for n, s in output.items() if n not in ranks}
    made = [c for c in rows.columns if c not in names]
    passes: dict[str, tuple[str, Column]] = {}
    averages: dict[str, str] = {}
    frames: list[tuple[str, str, Any, tuple]] = []
    for name, spec in output.items():
        window = spec.get("window") or {}
        op, arg = next((k, v) for k, v in spec.items() if k != "window")
        docs, reach = window.get("documents"), window.get("range")
        if op == "$documentNumber":
            passes[name] = ("count", F.lit(1))
        elif op == "$shift" and arg["by"] == -1:
            passes[name] = ("lag", expr(arg["output"]))
        elif op == "$shift":
            frames.append((name, "$max", arg["output"], ("rows", arg["by"], arg["by"])))
        elif reach:
            unit = MICROS[window["unit"]] if "unit" in window else 1
            low, high = [0 if x == "current" else x * unit for x in reach]
            frames.append((name, op, arg, ("range", low, high)))
        elif not docs or docs in (["unbounded", "unbounded"], ["unbounded", "current"]):
            prefix = "" if docs == ["unbounded", "current"] else "total_"
            if op == "$avg":
                passes[f"_sum_{name}"] = (f"{prefix}sum", expr(arg))
                passes[f"_n_{name}"] = (f"{prefix}count", expr(arg))
                averages[name] = name
            else:
                passes[name] = (prefix + op[1:], _value(op, arg))
        else:
            low, high = [0 if x == "current" else x for x in docs]
            frames.append((name, op, arg, ("rows", low, high)))
    if any(f[3][0] == "rows" for f in frames) or "$rank" in ranks.values():
        passes["_place"] = ("count", F.lit(1))
    if passes:
        rows = running(rows, keys, order, passes, segments)
    for name in averages:
        rows = rows.withColumn(name, F.col(f"_sum_{name}") / F.col(f"_n_{name}"))
    first, way = next(iter(sort_by.items())) if sort_by else (None, 1)
    # Frames on the same place share one blocked pass.
    for kind in ("rows", "range"):
        mine = [f for f in frames if f[3][0] == kind]
        spans = sorted({f[3][1:] for f in mine})
        for low, high in spans:
            place = F.col("_place") if kind == "rows" else position(rows, first) * way
            width = None if kind == "rows" else max(high - low, 1)
            aggs = {name: _FRAME[op](_value(op, arg)) for name, op, arg, f in mine if f[1:] == (low, high)}
            rows = sliding(rows, keys, place, low, high, aggs, width)
    peers = [*keys, *sort_by]
    for name, op in ranks.items():
        if op == "$rank":  # the place of the first row of the same order values
            number = rows.groupBy(*peers).agg(F.min("_place").cast("int").alias(name))
        else:
            distinct, rising = _ascending(rows.select(*peers).distinct(), sort_by)
            number = running(distinct, keys, rising, {name: ("count", F.lit(1))}, segments).select(*peers, F.col(name).cast("int").alias(name))
        rows = join_null_safe(rows, number, peers, "inner")
    helpers = [f"_{x}_{name}" for x in ("sum", "n") for name in averages]
    return rows.drop("_place", *helpers, *scratch, *made)


def _value(op: str, arg: Any) -> Column:
    return F.lit(1) if op == "$count" else expr(arg)


def densify(
    df: DataFrame, field: str, step: float, by: list[str] | None = None, bounds: Any = "full",
    unit: str | None = None, block: int = 10_000,
) -> DataFrame:
    """Add rows for missing steps of ``field`` per key. ``bounds`` is ``full`` (range of
    the whole table), ``partition`` or ``[low, high)``; ``unit`` goes from millisecond to
    year for times, from day for dates. The points of one key are
    made in blocks, so a long key is spread over tasks."""
    keys = by or []
    kind = df.schema[field].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    months = int(step) * MONTHS[unit] if unit in MONTHS else 0
    # A day is the unit of a date's position, a microsecond that of a time.
    width = months or (int(step * MICROS[unit]) if timed else int(step * MICROS[unit] // MICROS["day"]) if unit else step)
    if width <= 0:
        raise ValueError("a step must be positive and no finer than the field")
    groups = df.groupBy(*keys).agg(F.min(field).alias("lo"), F.max(field).alias("hi"))
    if isinstance(bounds, (list, tuple)):
        low, high = (F.lit(x).cast(kind) for x in bounds)
        groups = groups.select(*keys, low.alias("lo"), high.alias("hi"))
    elif bounds == "full":
        if keys:  # the range of the whole table, as a scalar
            whole = df.agg(F.struct(F.min(field).alias("lo"), F.max(field).alias("hi"))).scalar()
            groups = groups.drop("lo", "hi").withColumn("_whole", whole).select(*keys, "_whole.lo", "_whole.hi")
    open_end = isinstance(bounds, (list, tuple))
    if months:
        span = F.floor(F.months_between(F.col("hi"), F.col("lo"), False) / months) + 1
    else:
        at = groups.select(*keys, "lo", "hi", position(groups, "lo").alias("_lo"), position(groups, "hi").alias("_hi"))
        groups, span = at, F.floor((F.col("_hi") - F.col("_lo")) / F.lit(width))
    blocks = groups.where("lo IS NOT NULL AND hi IS NOT NULL").withColumn("_last", span.cast("bigint")).where("_last >= 0").withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / block).cast("bigint")))
    ).repartition(*keys, "_b")
    stop = F.least(F.col("_last"), (F.col("_b") + 1) * block - 1)
    steps = blocks.select("*", F.explode(F.sequence(F.col("_b") * block, stop)).alias("_i"))
    if months:
        value = (F.col("lo") + F.make_ym_interval(F.lit(0), (F.col("_i") * months).cast("int"))).cast(kind)
    else:
        point = F.col("_lo") + F.col("_i") * F.lit(width)
        if isinstance(kind, T.TimestampNTZType):
            value = F.timestamp_add("MICROSECOND", point.cast("bigint"), F.lit("1970-01-01").cast("timestamp_ntz"))
        elif timed:
            value = F.timestamp_micros(point.cast("bigint"))
        elif isinstance(kind, T.DateType):
            value = F.date_from_unix_date(point.cast("int"))
        else:
            value = point.cast(kind)
    value = value.alias(field)
    inside = F.col(field) < F.col("hi") if open_end else F.col(field) <= F.col("hi")
    points = steps.select(*keys, "hi", value).where(inside).drop("hi")
    have = df.select(*keys, field)
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*keys, field]]
    missing = points.alias("p").join(have.alias("h"), on, "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)


def fill(
    df: DataFrame, output: dict[str, dict[str, Any]], by: list[str] | None = None,
    sort_by: list[str] | None = None, segments: int | None = None,
) -> DataFrame:
    """Fill NULLs: ``{"value": v}``, ``{"method": "locf"}`` or ``{"method": "linear"}``."""
    rows = df
    keys = by or []
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    wants: dict[str, tuple[list[str], Column, bool]] = {}
    for name, spec in output.items():
        if "value" in spec:
            continue
        present = F.col(name).isNotNull()
        wants[f"_before_{name}"] = (["_x", name], present, False)
        if spec["method"] == "linear":
            wants[f"_after_{name}"] = (["_x", name], present, True)
    if wants:
        rows = rows.withColumn("_x", position(rows, sort_by[0]))
        rows = nearest(rows, keys, sort_by, wants, segments)
    filled = {}
    for name, spec in output.items():
        if "value" in spec:
            filled[name] = F.coalesce(F.col(name), F.lit(spec["value"]))
            continue
        x0, y0 = F.col(f"_before_{name}._x"), F.col(f"_before_{name}.{name}")
        if spec["method"] == "locf":
            filled[name] = y0
            continue
        x1, y1 = F.col(f"_after_{name}._x"), F.col(f"_after_{name}.{name}")
        between = y0 + (y1 - y0) * (F.col("_x") - x0) / (x1 - x0)
        filled[name] = F.coalesce(F.col(name), between)
    return rows.withColumns(filled).drop("_all", "_x", *wants)


def rate_counters(
    df: DataFrame, series: list[str], at: str, value: str, order: list[str] | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Per-second rate since the previous sample of the series. No earlier
    sample gives NULL; no elapsed time or a counter that fell gives 0."""
    by = order or [at]
    rows = previous_row(df.withColumn("_x", position(df, at)), series, by, ["_x", value], "_was_", segments)
    seconds = (F.col("_x") - F.col("_was__x")) / 1_000_000
    grown = F.col(value) - F.col(f"_was_{value}")
    rate = (
        F.when(F.col("_was__x").isNull(), None)
        .when((seconds <= 0) | (grown < 0), 0.0)
        .otherwise(grown / seconds)
    )
    return rows.withColumn("rate", rate).drop("_x", "_was__x", f"_was_{value}")


def last_n_samples(df: DataFrame, series: list[str], order: list[str], n: int = 60) -> DataFrame:
    """The newest ``n`` rows of each series."""
    newest = [F.col(c).desc() for c in order]
    return top_per_group(df, series, newest, n).drop("_rank")

