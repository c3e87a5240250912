"""Counts, facets, summaries and document-style grouping."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import expr
from tablewright.operators.segments import largest_group, running, with_running_index

CHUNK = 10_000
SPARK_CUTS = 1000  # Spark's own bound for cutting ranked rows before a shuffle
SPREAD = 32


def count_rows(df: DataFrame, where: Column | str | None = None, name: str = "count") -> DataFrame:
    return (df if where is None else df.where(where)).agg(F.count("*").alias(name))


def facet_distinct(
    df: DataFrame, column: str, where: Column | str | None = None, search: str | None = None,
    limit: int | None = None, by_value: bool = False,
) -> DataFrame:
    """Distinct values with counts, most frequent first; NULL is a value. The
    search text is LIKE on text columns and equality on others."""
    if where is not None:
        df = df.where(where)
    c = F.col(column)
    if search:
        text = isinstance(df.schema[column].dataType, T.StringType)
        df = df.where(c.contains(search) if text else c.cast("string") == search)
    out = df.groupBy(c.alias("value")).agg(F.count("*").alias("count"))
    order = [F.asc_nulls_last("value")]
    out = out.orderBy(*(order if by_value else [F.desc("count"), *order]))
    return out if limit is None else out.limit(max(1, limit))


def distinct_field(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; an array contributes its elements."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        c = F.explode(c)
    return df.select(c.alias("value")).distinct()


def finite_number(df: DataFrame, name: str) -> Column:
    """The cell as a finite double, else NULL; booleans and blanks are no numbers."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        x = F.col(name).cast("double")
    elif isinstance(kind, T.StringType):
        x = F.trim(F.col(name)).try_cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def selection_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """cell, row and numeric counts and the sum of all numeric cells, in one
    aggregation without unpivoting."""
    names = columns or df.columns
    numbers = [finite_number(df, c) for c in names]
    n = reduce(lambda a, b: a + b, [F.count(x) for x in numbers])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(x), F.lit(0.0)) for x in numbers])
    return df.agg(
        (F.count("*") * len(names)).alias("cell_count"), F.count("*").alias("row_count"),
        n.alias("numeric_count"), total.alias("sum"),
    )


def profile_columns(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Per column: rows, nulls, numeric cells, distinct values, chartable. One
    pass with sketches; ``exact`` counts distinct values instead."""
    names = columns or df.columns
    count = F.countDistinct if exact else F.approx_count_distinct
    aggs = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count(finite_number(df, c)).alias("numeric"),
            count(F.col(c)).alias("distinct_values"),
        ).alias(f"p{i}")
        for i, c in enumerate(names)
    ]
    one = df.agg(*aggs)
    rows = one.select(F.inline(F.array(*[f"p{i}" for i in range(len(names))])))
    return rows.withColumn("chartable", F.col("numeric") > 0)


def chart_series(df: DataFrame, x: str, ys: list[str], limit: int | None = None) -> DataFrame:
    """x as text and y as numbers, non-numeric cells counting 0."""
    if limit is not None:
        df = df.limit(limit)
    return df.select(
        F.col(x).cast("string").alias("x"),
        *[F.coalesce(finite_number(df, y), F.lit(0.0)).alias(y) for y in ys],
    )


# --- grouping -------------------------------------------------------------

_PLAIN = {
    "$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max,
    "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp,
}
_ORDERED = ("$first", "$last", "$top", "$bottom")
_LISTS = ("$firstN", "$lastN", "$topN", "$bottomN", "$maxN", "$minN")
_WHOLE = ("$push", "$addToSet")
PERCENTILE_ACCURACY = 10_000


def _by(order: dict[str, int], flip: bool = False) -> list[Column]:
    return [
        (F.col(c).asc_nulls_first() if (way > 0) != flip else F.col(c).desc_nulls_last())
        for c, way in order.items()
    ]


def _input(arg: Any) -> Column:
    if isinstance(arg, dict) and ("input" in arg or "output" in arg):
        return expr(arg.get("input", arg.get("output")))
    return expr(arg)


def _plain(op: str, arg: Any) -> Column | None:
    if op in _PLAIN:
        return _PLAIN[op](expr(arg))
    if op == "$count":
        return F.count("*")
    if op == "$median":
        return F.percentile_approx(_input(arg), F.lit(0.5), PERCENTILE_ACCURACY)
    if op == "$percentile":
        return F.percentile_approx(
            _input(arg), F.array(*[F.lit(float(p)) for p in arg["p"]]), PERCENTILE_ACCURACY
        )
    if op in _ORDERED:
        ways = set(arg["sortBy"].values())
        if len(ways) == 1:
            key = F.struct(*arg["sortBy"])
            low = (ways == {1}) == (op in ("$first", "$top"))
            return (F.min_by if low else F.max_by)(_input(arg), key)
    return None


def join_null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    other = right.select(
        *[F.col(c).alias(f"_r_{c}") for c in names], *[c for c in right.columns if c not in names]
    )
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])
    joined = left.join(other, on, how)
    if how == "full_outer":
        joined = joined.withColumns({c: F.coalesce(c, f"_r_{c}") for c in names})
    return joined.drop(*[f"_r_{c}" for c in names])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key. Spark cuts each map task's rows to ``n`` per key
    before the shuffle, up to ``SPARK_CUTS`` rows; for a greater ``n`` a key is first cut
    in ``SPREAD`` parts, so that a hot one is never whole in a task."""
    if n > SPARK_CUTS:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", F.spark_partition_id() % SPREAD)
        df = df.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n).drop("_part", "_rank")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n)


def _list(rows: DataFrame, name: str, op: str, arg: Any) -> DataFrame:
    """Bounded list accumulators: at most ``n`` values per group."""
    value, n = _input(arg), arg.get("n", 1)
    if op in ("$maxN", "$minN"):
        rows = rows.withColumn("_v", value).where("_v IS NOT NULL")
        order = [F.col("_v").desc() if op == "$maxN" else F.col("_v").asc()]
    else:
        rows = rows.withColumn("_v", value)
        order = _by(arg["sortBy"], flip=op in ("$bottomN", "$lastN"))
    kept = top_per_group(rows, ["_id"], order, n)
    items = F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_v"))), lambda x: x["_v"])
    if op in ("$bottomN", "$lastN"):
        items = F.reverse(items)
    return kept.groupBy("_id").agg(items.alias(name))


def rank_in_group(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """0-based place of each row in its key, for keys of any size."""
    kind = df.schema[order[0]].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = running(df, keys, order, {name: ("count", F.lit(1))})
        return out.withColumn(name, F.col(name) - 1)
    indexed = with_running_index(df, [*keys, *order], "_at")
    first = indexed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return join_null_safe(indexed, first, keys, "inner").withColumn(
        name, F.col("_at") - F.col("_first")
    ).drop("_at", "_first")


def push_chunks(
    df: DataFrame, keys: list[str], value: Column, order: list[str], name: str, size: int | None = CHUNK
) -> DataFrame:
    """All values of each key in ``order``, as arrays of at most ``size`` values (whole
    without one), one row ``(keys, chunk, name)`` each. Nothing is dropped and no task holds
    more than a chunk; a key with up to ``size`` values has one row. If every key
    fits its chunk, one grouping does it."""
    rows = df.withColumn("_v", value)
    if size is None or largest_group(df, keys) <= size:
        kept = F.transform(F.sort_array(F.collect_list(F.struct(*order, "_v"))), lambda x: x["_v"])
        return rows.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("chunk"), kept.alias(name))
    ranked = rank_in_group(rows, keys, order, "_place")
    chunk = F.floor(F.col("_place") / size).cast("bigint")
    items = F.transform(F.sort_array(F.collect_list(F.struct("_place", "_v"))), lambda x: x["_v"])
    return ranked.groupBy(*keys, chunk.alias("chunk")).agg(items.alias(name))


def gather_chunks(
    df: DataFrame, keys: list[str], value: Column, name: str, size: int = CHUNK
) -> DataFrame:
    """All values of each key in no given order, in arrays of at most ``2 * size``.

    Equal values are counted first, so a key made of copies of one value shrinks
    on the map side; large counts are cut into pieces of ``size`` copies.
    """
    if largest_group(df, keys) <= size:
        return df.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("chunk"), F.collect_list(value).alias(name))
    counted = df.groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))
    last = F.ceil(F.col("_n") / size).cast("bigint") - 1
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumns({
        "_copies": F.least(F.lit(size).cast("bigint"), F.col("_n") - F.col("_piece") * size),
        "_order": F.xxhash64("_v"),
    })
    placed = running(pieces, keys, ["_order", "_piece"], {"_to": ("sum", F.col("_copies"))})
    chunk = F.floor((F.col("_to") - F.col("_copies")) / size).cast("bigint")
    copies = F.array_repeat(F.col("_v"), F.col("_copies").cast("int"))
    return placed.groupBy(*keys, chunk.alias("chunk")).agg(F.flatten(F.collect_list(copies)).alias(name))


def merge_maps(df: DataFrame, keys: list[str], column: Column, order: list[str], name: str) -> DataFrame:
    """Maps merged per key, the last in ``order`` winning for each field."""
    entries = df.select(*keys, F.struct(*order).alias("_at"), F.explode(column).alias("_k", "_v"))
    last = entries.groupBy(*keys, "_k").agg(F.max_by("_v", "_at").alias("_v"))
    return last.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(name)
    )


def group(df: DataFrame, by: Any, accumulators: dict[str, dict[str, Any]], size: int | None = CHUNK) -> DataFrame:
    """Group by an expression (field ``_id``; None is one group).

    Plain accumulators run in one aggregation with map-side combine. ``$topN``
    and its kin keep at most n rows per group. ``$push`` and ``$addToSet`` come in
    chunks: the result has a ``chunk`` column, and a group with more than ``size``
    values has several rows that repeat its plain values. Without a ``size`` a group is one
    row, its arrays are whole and there is no ``chunk``.
    """
    rows = df.withColumn("_id", F.lit(None).cast("string") if by is None else expr(by))
    plain, others = {}, []
    for name, spec in accumulators.items():
        op, arg = next(iter(spec.items()))
        column = _plain(op, arg)
        if column is not None:
            plain[name] = column
        else:
            others.append((name, op, arg))
    base = rows.groupBy("_id")
    once = base.agg(*[c.alias(n) for n, c in plain.items()]) if plain else rows.select("_id").distinct()
    chunks = None
    for name, op, arg in others:
        if op in _LISTS:
            once = join_null_safe(once, _list(rows, name, op, arg), ["_id"], "left")
        elif op in _ORDERED:
            picked = _list(rows, name, op + "N", {**arg, "n": 1})
            once = join_null_safe(once, picked.withColumn(name, F.col(name)[0]), ["_id"], "left")
        elif op == "$mergeObjects":
            merged = merge_maps(rows, ["_id"], _input(arg), list(arg["sortBy"]), name)
            once = join_null_safe(once, merged, ["_id"], "left")
        elif op in _WHOLE:
            if op == "$push":
                part = push_chunks(rows, ["_id"], _input(arg), list(arg["sortBy"]), name, size)
            else:
                values = rows.select("_id", _input(arg).alias("_set")).where("_set IS NOT NULL").distinct()
                part = push_chunks(values, ["_id"], F.col("_set"), ["_set"], name, size)
            chunks = part if chunks is None else join_null_safe(chunks, part, ["_id", "chunk"], "full_outer")
        else:
            raise ValueError(f"unknown accumulator {op}")
    if chunks is None:
        return once
    # Last, so that every chunk of a group has the group's plain values.
    out = join_null_safe(once, chunks, ["_id"], "left")
    arrays = [n for n, op, _ in others if op in _WHOLE]
    out = out.withColumns({n: F.coalesce(n, F.array().cast(out.schema[n].dataType)) for n in arrays})
    return out.drop("chunk") if size is None else out.withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("bigint")))


def group_unwound(df: DataFrame, by: Any, accumulators: dict[str, dict[str, Any]], name: str) -> DataFrame:
    """``group`` with the ``$push`` called ``name`` unwound: each row's value beside its group's
    other accumulators. No array is built, so a group may hold any share of the rows."""
    rows = df.withColumn("_id", F.lit(None).cast("string") if by is None else expr(by))
    rest = {n: a for n, a in accumulators.items() if n != name}
    values = rows.select("_id", _input(accumulators[name]["$push"]).alias(name))
    if not rest:
        return values
    return join_null_safe(values, group(df, by, rest, None), ["_id"], "inner").select("_id", *rest, name)


def facets(df: DataFrame, parts: dict[str, Any]) -> dict[str, DataFrame]:
    """One DataFrame per named sub-list of stages over the same input."""
    from tablewright.operators.stages import apply_stages

    return {name: apply_stages(df, stages) for name, stages in parts.items()}


def search_agg_flatten(df: DataFrame, buckets: dict[str, Any], metrics: dict[str, Column]) -> DataFrame:
    """Bucket aggregation as rows: bucket keys, ``doc_count`` and one plain column
    per metric; without buckets one row of metrics."""
    aggs = [m.alias(n) for n, m in metrics.items()]
    if not buckets:
        return df.agg(*aggs)
    keys = [expr(v).alias(k) for k, v in buckets.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("doc_count"), *aggs)


def key_prefix_rollup(df: DataFrame, key: str, size: Column, separator: str = ":") -> DataFrame:
    """Every group of a key tree: ``(prefix, depth, keys, total_size)`` over all keys
    beneath it. The last segment is the leaf and forms no group."""
    parts = F.split(F.col(key), f"\\Q{separator}\\E")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    rows = df.select(parts.alias("_p"), size.alias("_s"), F.explode(depths).alias("depth"))
    prefix = F.array_join(F.slice("_p", F.lit(1), F.col("depth")), separator)
    return rows.groupBy(prefix.alias("prefix"), "depth").agg(
        F.count("*").alias("keys"), F.sum("_s").alias("total_size")
    )
