"""Ordered work on groups too big for one task.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. Here each key
is cut into segments along the order column; the window runs inside
``(key, segment)``, and what must cross a segment border is carried by a
one-row-per-segment summary. The big side is shuffled once, on
``(key, segment)``, and the join with the summary reuses that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.storage import materialize

ROWS_PER_SEGMENT = 500_000
# A key up to this size is sorted by one task, with spilling, faster than it is cut.
ONE_TASK_ROWS = 2_000_000
_NUMBERS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
SEG = "_segment"


def position(df: DataFrame, name: str) -> Column:
    """A numeric position for an order column (microseconds for times)."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        # From the parts: a cast to an instant would depend on the session's zone.
        minutes = (F.unix_date(c.cast("date")).cast("bigint") * 24 + F.hour(c)) * 60 + F.minute(c)
        micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return minutes * 60_000_000 + micros
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("bigint")
    return F.col(name)


POS, TIE = "_pos", "_tie"
MOST_CUTS = 64
# Outer quantiles keep far-off values, such as a stray year 1970, from stretching
# the segments of all other rows.
OUTER = (0.0001, 0.001, 0.999, 0.9999)


def _edges(df: DataFrame, name: str, bins: int) -> tuple[list[float], list[float]]:
    """Distinct quantiles of a numeric column, and those that repeat: values that
    hold more than one bin's share of the rows."""
    shares = sorted({i / bins for i in range(1, bins)} | set(OUTER if bins == MOST_CUTS else ()))
    low, high, marks = df.agg(
        F.min(name), F.max(name),
        F.percentile_approx(name, F.array(*[F.lit(q) for q in shares]), 100_000),
    ).first()
    listed = sorted([float(low), *map(float, marks), float(high)])
    heavy = sorted({a for a, b in zip(listed, listed[1:]) if a == b and low != high})
    return sorted(set(listed)), heavy


def _numbered(name: str, edges: list[float], cuts: int) -> Column:
    """0-based piece of a value: its range between two edges, found by halving, cut
    into ``cuts`` even pieces. NULL, which sorts first, is in the first piece."""

    def find(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(name) < F.lit(edges[mid]), find(lo, mid)).otherwise(find(mid, hi))

    if len(edges) < 2:
        return F.lit(0).cast("bigint")
    at = F.when(F.col(name).isNull(), F.lit(0)).otherwise(find(0, len(edges) - 1))
    if cuts == 1:
        return at.cast("bigint")
    starts = F.array(*[F.lit(e) for e in edges[:-1]])
    widths = F.array(*[F.lit((b - a) / cuts) for a, b in zip(edges, edges[1:])])
    inside = F.floor((F.col(name) - F.get(starts, at)) / F.get(widths, at)).cast("bigint")
    return at * cuts + F.coalesce(F.least(inside, F.lit(cuts - 1)), F.lit(0))


def segment_of(
    df: DataFrame, order: list[str], segments: int | None = None, rows: int | None = None
) -> Column:
    """Segment number, rising in ``order``, with about ``rows`` rows per segment; an
    expression over the columns ``_pos`` and ``_tie`` (first and second order column).

    One pass takes count and range. Only if there is more than one segment, a
    second takes quantiles; the range between two of them is cut evenly. A single
    position that holds a large share of the rows shows as repeated quantiles;
    its rows are then cut along the second order column.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    split = len(order) > 1 and isinstance(kinds[order[1]], _NUMBERS)
    tie = position(df, order[1]) if split else F.lit(0)
    placed = df.select(position(df, order[0]).alias(POS), tie.alias(TIE))
    low, high, n = placed.agg(F.min(POS), F.max(POS), F.count(POS)).first()
    count = segments or max(1, math.ceil((n or 0) / (rows or ROWS_PER_SEGMENT)))
    if low is None or count == 1:
        return F.lit(0).cast("bigint")
    bins = min(count, MOST_CUTS)
    edges, heavy = _edges(placed, POS, bins) if low != high else ([float(low)], [float(low)])
    cuts = max(1, math.ceil(count / max(1, len(edges) - 1)))
    number = _numbered(POS, edges, cuts) if low != high else F.lit(0).cast("bigint")
    if heavy and split:
        held = F.col(POS).isin(heavy)
        tie_edges, _ = _edges(placed.where(held), TIE, bins)
        tie_cuts = max(1, math.ceil(count / max(1, len(tie_edges) - 1)))
        parts = max(1, len(tie_edges) - 1) * tie_cuts
        # A heavy position opens its range: its own pieces come before the rest's.
        inner = F.when(held, _numbered(TIE, tie_edges, tie_cuts)).otherwise(F.lit(parts))
        number = number * (parts + 1) + inner
    return F.coalesce(number, F.lit(-1)).cast("bigint")


# Group columns: a hash (fast to sort), the keys as one struct (whose NULL fields
# are equal, unlike NULL columns) and the segment. Being never NULL, they let
# the join with the summary run on the window's own partitioning.
HASH, KEY = "_hash", "_key"
WHOLE, PIECE = [HASH, KEY], [HASH, KEY, SEG]


def _cut(df: DataFrame, keys: list[str], order: list[str], segments: int | None) -> DataFrame:
    fields = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    kinds = {f.name: f.dataType for f in df.schema}
    split = len(order) > 1 and isinstance(kinds[order[1]], _NUMBERS)
    tie = position(df, order[1]) if split else F.lit(0)
    placed = df.withColumns({POS: position(df, order[0]), TIE: tie})
    number = segment_of(df, order, segments)
    return placed.withColumns({HASH: F.xxhash64(*keys), KEY: fields, SEG: number}).drop(POS, TIE)


def _attach(rows: DataFrame, carry: DataFrame, extra: list[str]) -> DataFrame:
    return rows.join(carry.select(*PIECE, *extra), PIECE, "left")


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key; counted on the map side first."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def _numeric_order(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """An order that can be cut: text and the like get their place in the whole table."""
    if isinstance(df.schema[order[0]].dataType, _NUMBERS):
        return df, order
    return with_running_index(df, order, "_place_in_order"), ["_place_in_order"]


def _fits_one_task(df: DataFrame, keys: list[str], segments: int | None) -> bool:
    return segments is None and largest_group(df, keys) <= ONE_TASK_ROWS


_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_LOCAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _plain_running(
    df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, tuple[str, Column]]
) -> DataFrame:
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for name, (op, value) in aggs.items():
        if op == "lag":
            column = F.lag(value).over(inside)
        elif op.startswith("total_"):
            column = _LOCAL[op.removeprefix("total_")](value).over(Window.partitionBy(*keys))
        else:
            column = _LOCAL[op](value).over(upto)
        out.append(column.alias(name))
    return df.select("*", *out)


def running(
    df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, tuple[str, Column]],
    segments: int | None = None,
) -> DataFrame:
    """Running aggregates, previous values and whole-key totals in one pass.

    ``aggs`` maps an output name to ``(op, value)``: ``sum count min max`` run from the
    start of the key to the current row, ``lag`` is the previous row's value, and
    ``total_sum`` and so on cover the whole key. If every key is
    small enough for one task, a plain window does it with one shuffle.
    """
    if _fits_one_task(df, keys, segments):
        return _plain_running(df, keys, order, aggs)
    names = df.columns
    df, order = _numeric_order(df, order)
    # The value columns are fixed here so that each is computed once.
    rows = _cut(df, keys, order, segments).withColumns(
        {f"_v_{name}": value for name, (_, value) in aggs.items()}
    )
    inside = Window.partitionBy(*PIECE).orderBy(*order)
    local = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*WHOLE).orderBy(SEG)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(*WHOLE)
    edge, reach, here, out = [], [], {}, {}
    for name, (op, _) in aggs.items():
        v, mine, before = F.col(f"_v_{name}"), F.col(f"_l_{name}"), F.col(f"_b_{name}")
        if op == "lag":
            boxed = F.struct(v.alias("v"))
            edge.append(F.max_by(boxed, F.struct(*order)).alias(f"_s_{name}"))
            reach.append(F.lag(f"_s_{name}").over(across).alias(f"_b_{name}"))
            here[f"_l_{name}"] = F.lag(boxed).over(inside)
            out[name] = F.coalesce(mine, before)["v"]
            continue
        kind = op.removeprefix("total_")
        edge.append(_LOCAL[kind](v).alias(f"_s_{name}"))
        if kind != op:
            reach.append(_COMBINE[kind](f"_s_{name}").over(everywhere).alias(f"_b_{name}"))
            out[name] = before
            continue
        reach.append(_COMBINE[kind](f"_s_{name}").over(earlier).alias(f"_b_{name}"))
        here[f"_l_{name}"] = _LOCAL[kind](v).over(local)
        if kind in ("min", "max"):
            out[name] = (F.least if kind == "min" else F.greatest)(mine, before)
        else:
            out[name] = F.coalesce(mine + before, mine, before)
    carry = rows.groupBy(*PIECE).agg(*edge).select(*PIECE, *reach)
    rows = _attach(rows.withColumns(here), carry, [f"_b_{name}" for name in aggs])
    return rows.select(*names, *[value.alias(name) for name, value in out.items()])


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str],
    prefix: str = "prev_", segments: int | None = None,
) -> DataFrame:
    """Add the previous row's ``columns`` (SQL ``lag``) per key."""
    wanted = {f"{prefix}{c}": ("lag", F.col(c)) for c in columns}
    return running(df, keys, order, wanted, segments)


def nearest(
    df: DataFrame, keys: list[str], order: list[str],
    wants: dict[str, tuple[list[str], Column, bool]], segments: int | None = None,
) -> DataFrame:
    """Values of the nearest marked row per key, in one pass.

    ``wants`` maps a struct name to ``(columns, present, backward)``: the ``columns`` of
    the nearest row at or before (``backward``: at or after) this one where
    ``present`` holds.
    """
    if _fits_one_task(df, keys, segments):
        inside = Window.partitionBy(*keys).orderBy(*order)
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        onward = inside.rowsBetween(0, Window.unboundedFollowing)
        return df.select("*", *[
            (F.first(F.when(present, F.struct(*columns)), ignorenulls=True).over(onward) if backward
             else F.last(F.when(present, F.struct(*columns)), ignorenulls=True).over(upto)).alias(name)
            for name, (columns, present, backward) in wants.items()
        ])
    names = df.columns
    df, order = _numeric_order(df, order)
    rows = _cut(df, keys, order, segments)
    local = Window.partitionBy(*PIECE).orderBy(*order)
    across = Window.partitionBy(*WHOLE).orderBy(SEG)
    before = Window.unboundedPreceding
    after = Window.unboundedFollowing
    edge, reach, here = [], [], {}
    for name, (columns, present, backward) in wants.items():
        value, stamp = F.when(present, F.struct(*columns)), F.when(present, F.struct(*order))
        if backward:
            here[f"_l_{name}"] = F.first(value, ignorenulls=True).over(local.rowsBetween(0, after))
            edge.append(F.min_by(value, stamp).alias(f"_s_{name}"))
            far = F.first(f"_s_{name}", ignorenulls=True).over(across.rowsBetween(1, after))
        else:
            here[f"_l_{name}"] = F.last(value, ignorenulls=True).over(local.rowsBetween(before, 0))
            edge.append(F.max_by(value, stamp).alias(f"_s_{name}"))
            far = F.last(f"_s_{name}", ignorenulls=True).over(across.rowsBetween(before, -1))
        reach.append(far.alias(f"_b_{name}"))
    carry = rows.groupBy(*PIECE).agg(*edge).select(*PIECE, *reach)
    rows = _attach(rows.withColumns(here), carry, [f"_b_{name}" for name in wants])
    found = [F.coalesce(f"_l_{name}", f"_b_{name}").alias(name) for name in wants]
    return rows.select(*names, *found)


def sliding(
    df: DataFrame, keys: list[str], place: Column, low: float, high: float,
    aggs: dict[str, Column], width: float | None = None,
) -> DataFrame:
    """Aggregates over the rows whose ``place`` lies in ``[here+low, here+high]``.

    Rows are put in blocks of ``width`` along ``place``; a row near a block
    border is also sent to the neighbour block, so that each block holds every
    row its frames can see. Rows without a place have a block of their own: their
    frames hold them alone. ``aggs`` maps an output name to an aggregate.
    """
    reach = max(abs(low), abs(high))
    width = max(width or 100_000, reach, 1)
    rows = df.withColumn("_spot", place)
    block = F.floor(F.col("_spot") / F.lit(width)).cast("bigint")
    first = F.floor((F.col("_spot") - F.lit(max(high, 0))) / F.lit(width)).cast("bigint")
    last = F.floor((F.col("_spot") + F.lit(max(-low, 0))) / F.lit(width)).cast("bigint")
    rows = rows.withColumn("_home", block).withColumn("_block", F.explode_outer(F.sequence(first, last)))
    frame = Window.partitionBy(*keys, "_block").orderBy("_spot").rangeBetween(low, high)
    rows = rows.withColumns({name: agg.over(frame) for name, agg in aggs.items()})
    return rows.where(F.col("_home").eqNullSafe(F.col("_block"))).drop("_spot", "_home", "_block")


def with_running_index(
    df: DataFrame, order: list[Column | str], name: str = "row_index",
    partitions: int | None = None,
) -> DataFrame:
    """Add a global 0-based index in ``order`` without a one-task window.

    Rows are range partitioned and sorted, numbered inside each partition and
    written; the per-partition counts (one row per partition) give the offsets.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_inside", inside)
    )
    stored = materialize(ranged, "indexed")
    counts = stored.groupBy("_part").agg(F.max("_inside").alias("top")).orderBy("_part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["_part"], total))
        total += row["top"] + 1
    lookup = spark.createDataFrame(offsets, "_part int, _offset bigint")
    return (
        stored.join(F.broadcast(lookup), "_part")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_part", "_inside", "_offset")
    )


def with_running_total(
    df: DataFrame, order: list[str], weight: str, name: str, partitions: int | None = None
) -> DataFrame:
    """Add the total ``weight`` of all rows before this one in ``order``."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()),
        "totals",
    )
    sums = stored.groupBy("_part").agg(F.sum(weight).alias("w")).orderBy("_part").collect()
    offsets, total = [], 0
    for row in sums:
        offsets.append((row["_part"], total))
        total += row["w"] or 0
    lookup = spark.createDataFrame(offsets, "_part int, _offset bigint")
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.withColumn("_ahead", F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .join(F.broadcast(lookup), "_part")
        .withColumn(name, F.col("_ahead") + F.col("_offset"))
        .drop("_part", "_ahead", "_offset")
    )
