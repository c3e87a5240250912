"""Keyed comparison by a tree of checksums over key ranges.

A keyed diff joins both tables whole, though two large tables are mostly equal. Here each
side is first summed up: a row's hash, XORed over a range of keys and counted, for both
sides in one aggregation that combines in the map tasks. Ranges whose sums agree are left
out of everything that follows. The others are cut once more, by a hash of the key, into
leaves of a few rows, and only the rows of leaves that differ reach the join. Key ranges
follow the first key's values where these can be cut (numbers, dates, times), so a scan
of a table in key order skips what lies between the ranges that differ; other keys are
cut by their hash.

Sums are 128 bits and a count; equal ones are taken for equal rows.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import diff
from tablewright.operators.segments import POS, TIE, position, segment_of
from tablewright.storage import materialize

RANGES = 4096  # of the first level at most; one row each reaches the driver
RANGE_ROWS = 100_000
LEAF_ROWS = 16
LEAVES = 500_000  # differing leaves up to this number are broadcast, 16 bytes each
INTERVALS = 32  # of key values that are pushed down to a scan
_CUT = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)
RANGE, LEAF, KEY, ONE, TWO = "_range", "_leaf", "_key_hash", "_sum1", "_sum2"


def _common(source: DataFrame, target: DataFrame, names: list[str]) -> T.StructType:
    return source.select(*names).unionByName(target.select(*names)).schema


def _flat(kind: T.DataType, c: Column) -> Column:
    """A cell as it is hashed, compared as ``diff.clean`` has it. A hash skips NULLs, so
    nested values go as text that shows them."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.MapType):
        c = F.array_sort(F.map_entries(c))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))
    return c


def _hash(seed: int, kinds: T.StructType, names: list[str]) -> Column:
    values = [_flat(kinds[n].dataType, F.col(n).cast(kinds[n].dataType)) for n in names]
    return F.xxhash64(F.lit(seed), *values, *[v.isNull() for v in values])


def _summed(df: DataFrame, keys: list[str], cells: list[str], kinds: T.StructType) -> DataFrame:
    """``df`` with the key's hash, the row's two hashes and the first key's position."""
    first = kinds[keys[0]].dataType
    place = position(df, keys[0]) if isinstance(first, _CUT) else F.lit(0)
    row = [*keys, *cells]
    return df.withColumns({KEY: _hash(1, kinds, keys), ONE: _hash(2, kinds, row), TWO: _hash(3, kinds, row), POS: place, TIE: F.lit(0)})


def _sides(source: DataFrame, target: DataFrame, names: list[str]) -> DataFrame:
    return source.select(*names, F.lit(1).alias("_side")).unionByName(target.select(*names, F.lit(-1).alias("_side")))


def _differ(both: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """The groups whose sums differ, with ``n`` rows of both sides."""
    sums = both.groupBy(*by).agg(
        F.sum("_side").alias("off"), F.bit_xor(ONE).alias("x1"), F.bit_xor(TWO).alias("x2"), F.count("*").alias("n"), *more
    )
    return sums.where("off <> 0 OR x1 <> 0 OR x2 <> 0")


def _intervals(found: list[Any]) -> list[tuple[Any, Any]]:
    """At most INTERVALS intervals that hold the ranges' values; the widest gaps stay."""
    spans = sorted((r["lo"], r["hi"]) for r in found if r["lo"] is not None)
    gaps = sorted(range(1, len(spans)), key=lambda i: spans[i][0] - spans[i - 1][1], reverse=True)
    cuts = sorted(gaps[: INTERVALS - 1])
    return [(spans[a][0], spans[b - 1][1]) for a, b in zip([0, *cuts], [*cuts, len(spans)])] if spans else []


def differing(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, range_rows: int = RANGE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the key ranges in which they are equal.

    Every row that a diff would report is in the result, with its partner on the other
    side; most equal rows are not. A NULL key is a value like any other. Keys should be
    unique: an even number of copies of one row cancels out."""
    cells = [c for c in (columns or diff.common_columns(source, target)) if c not in keys]
    kinds = _common(source, target, [*keys, *cells])
    first = kinds[keys[0]].dataType
    ordered = isinstance(first, _CUT)
    left, right = _summed(source, keys, cells, kinds), _summed(target, keys, cells, kinds)
    total = source.select(F.lit(1)).unionAll(target.select(F.lit(1))).count()
    ranges = max(1, min(RANGES, math.ceil(total / (2 * range_rows))))
    if ordered:
        # Both sides are cut at the same values of the first key.
        number = segment_of(source.select(keys[0]).unionByName(target.select(keys[0])), [keys[0]], ranges)
    else:
        number = F.pmod(F.col(KEY), F.lit(ranges))
    left, right = left.withColumn(RANGE, number), right.withColumn(RANGE, number)
    both = _sides(left, right, [RANGE, ONE, TWO, *([keys[0]] if ordered else [])])
    edge = [F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")] if ordered else []
    found = _differ(both, [RANGE], *edge).collect()  # a row per range
    numbers = [r[RANGE] for r in found]

    def of_ranges(df: DataFrame) -> DataFrame:
        if ordered and numbers:
            c = F.col(keys[0])
            near = [c.between(F.lit(a), F.lit(b)) for a, b in _intervals(found)]
            df = df.where(reduce(lambda a, b: a | b, near, c.isNull()))
        return df.where(F.col(RANGE).isin(numbers) if numbers else F.lit(False))

    fan = max(1, round(sum(r["n"] for r in found) / max(1, len(found)) / (2 * LEAF_ROWS)))
    left, right = (of_ranges(df).withColumn(LEAF, F.pmod(F.col(KEY), F.lit(fan))) for df in (left, right))
    if found and fan > 1:
        leaves = materialize(_differ(_sides(left, right, [RANGE, LEAF, ONE, TWO]), [RANGE, LEAF]).select(RANGE, LEAF), "leaves")
        if leaves.count() <= LEAVES:  # more: the ranges alone narrow the tables
            left, right = (df.join(F.broadcast(leaves), [RANGE, LEAF], "left_semi") for df in (left, right))
    return left.select(*source.columns), right.select(*target.columns)


def _narrowed(source, target, keys, columns, checked, range_rows):
    diff._need_keys(keys)
    if checked:
        diff.check_keys(source, target, keys)
    return differing(source, target, keys, columns, range_rows)


def diff_rows(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, checked: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``diff.diff_rows`` of what differs; same rows. ``checked`` looks for repeated keys, for
    which the keys alone are shuffled; leave it out where they are known to be unique."""
    return diff.diff_rows(*_narrowed(source, target, keys, columns, checked, range_rows), keys, columns, checked=False)


def diff_summary(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, checked: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    return diff.diff_summary(*_narrowed(source, target, keys, columns, checked, range_rows), keys, columns, checked=False)


def table_equal(source: DataFrame, target: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``result``: the tables as bags of rows, by count and two sums of row hashes.
    No row is shuffled, one per task is."""
    names = columns or diff.common_columns(source, target)
    kinds = _common(source, target, names)

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.lit(sign).alias("n"), *[(_hash(s, kinds, names).cast("decimal(38,0)") * sign).alias(f"h{s}") for s in (2, 3)])

    both = signed(source, 1).unionByName(signed(target, -1))
    sums = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "h2", "h3")])
    return sums.select(F.when((F.col("n") == 0) & (F.col("h2") == 0) & (F.col("h3") == 0), "same").otherwise("different").alias("result"))
