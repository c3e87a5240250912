"""Keyed comparison of two tables.

One full-outer join on null-safe keys gives added, removed and modified rows in
a single pass; each side carries a marker because NULL columns cannot tell that
a row is absent. Duplicate keys are refused first by a key-only aggregation with
map-side combine, so the join never meets a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    DateTimeException,
    NumberFormatException,
    SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SRC, TGT = "s_", "t_"


class DuplicateKeyError(ValueError):
    pass


def _need_keys(keys: list[str]) -> None:
    if not keys:
        raise ValueError("a keyed comparison needs at least one key column")


def common_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns both sides have, in source order."""
    have = set(target.columns)
    return [c for c in source.columns if c in have]


def clean(df: DataFrame, name: str) -> Column:
    """A cell as it compares: NaN and infinities count as NULL, a map is its entries in
    key order."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def side(df: DataFrame, keys: list[str], columns: list[str], prefix: str) -> DataFrame:
    return df.select(
        *[F.col(k).alias(f"{prefix}key_{k}") for k in keys],
        *[clean(df, c).alias(prefix + c) for c in columns],
        F.lit(True).alias(f"{prefix}here"),
    )


def diff_duplicate_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``(side, keys..., copies)`` for every key that occurs more than once."""
    _need_keys(keys)
    both = source.select(F.lit("source").alias("side"), *keys).unionByName(
        target.select(F.lit("target").alias("side"), *keys)
    )
    return both.groupBy("side", *keys).agg(F.count("*").alias("copies")).where("copies > 1")


def check_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> None:
    found = diff_duplicate_keys(source, target, keys).take(1)
    if found:
        row = found[0].asDict()
        shown = ", ".join(f"{k}={row[k]}" for k in keys)
        raise DuplicateKeyError(f"Duplicate {row['side']} key: {shown}")


def diff_join(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None,
    checked: bool = True,
) -> DataFrame:
    """Every key of either side with ``status`` (added, removed, modified, same),
    both sides' values (``s_*``, ``t_*``) and ``c_*`` flags of changed cells."""
    _need_keys(keys)
    cells = [c for c in (columns or common_columns(source, target)) if c not in keys]
    if checked:
        check_keys(source, target, keys)
    left, right = side(source, keys, cells, SRC), side(target, keys, cells, TGT)
    on = reduce(
        lambda a, b: a & b,
        [F.col(f"{SRC}key_{k}").eqNullSafe(F.col(f"{TGT}key_{k}")) for k in keys],
    )
    joined = left.join(right, on, "full_outer")
    changed = [~F.col(SRC + c).eqNullSafe(F.col(TGT + c)) for c in cells]
    any_change = reduce(lambda a, b: a | b, changed, F.lit(False))
    status = (
        F.when(F.col(f"{TGT}here").isNull(), "added")
        .when(F.col(f"{SRC}here").isNull(), "removed")
        .when(any_change, "modified")
        .otherwise("same")
    )
    # A present side decides the key: coalesce is right for NULL keys too.
    keyed = [F.coalesce(f"{SRC}key_{k}", f"{TGT}key_{k}").alias(k) for k in keys]
    return joined.select(
        status.alias("status"), *keyed,
        *[SRC + c for c in cells], *[TGT + c for c in cells],
        *[x.alias(f"c_{c}") for x, c in zip(changed, cells)],
    )


def diff_rows(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None,
    checked: bool = True,
) -> DataFrame:
    """Rows that differ: ``status``, keys, ``n_changes``, ``changed_columns``
    (names in column order), values of both sides and ``changes``."""
    joined = diff_join(source, target, keys, columns, checked).where("status <> 'same'")
    cells = [c[2:] for c in joined.columns if c.startswith("c_")]
    modified = F.col("status") == "modified"
    names = [F.when(modified & F.col(f"c_{c}"), F.lit(c)) for c in cells]
    count = reduce(
        lambda a, b: a + b,
        [F.when(modified & F.col(f"c_{c}"), 1).otherwise(0) for c in cells], F.lit(0),
    )
    changes = [
        F.when(
            modified & F.col(f"c_{c}"),
            F.struct(
                F.lit(c).alias("column"), F.col(SRC + c).cast("string").alias("source"),
                F.col(TGT + c).cast("string").alias("target"),
            ),
        )
        for c in cells
    ]
    return joined.select(
        "status", *keys, count.alias("n_changes"),
        F.concat_ws(",", *names).alias("changed_columns"),
        *[SRC + c for c in cells], *[TGT + c for c in cells],
        (F.array_compact(F.array(*changes)) if changes else F.array()).alias("changes"),
    )


def diff_cells(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None,
    checked: bool = True,
) -> DataFrame:
    """One row per changed cell: keys, ``column``, ``source``, ``target``."""
    rows = diff_rows(source, target, keys, columns, checked).where("status = 'modified'")
    return rows.select(*keys, F.inline("changes"))


def diff_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of the two sides in one row."""
    tagged = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(
        target.select(F.lit(0), F.lit(1))
    )
    return tagged.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows"),
    )


def diff_summary(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None,
    checked: bool = True,
) -> DataFrame:
    """added, removed and modified counts plus ``result`` same or different."""
    joined = diff_join(source, target, keys, columns, checked)
    counts = joined.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")]
    )
    differ = F.col("added") + F.col("removed") + F.col("modified") > 0
    return counts.withColumn("result", F.when(differ, "different").otherwise("same"))


def diff_all_tables(
    source: dict[str, DataFrame], target: dict[str, DataFrame],
    keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One summary row per source table, matched by name. A table without a
    target is ``missing target``; one that cannot be compared (no or repeated keys,
    types that do not compare, a cell that cannot be cast) is ``error`` with a
    ``reason`` and does not stop the others; faults of the cluster do. Keys default
    to columns marked ``pk``. The counts of each pair, one row, reach the driver."""
    parts = []
    spark = None
    for name, frame in source.items():
        spark, reason = frame.sparkSession, None
        if name not in target:
            parts.append((name, 0, 0, 0, "missing target", None))
            continue
        marked = [f.name for f in frame.schema if (f.metadata or {}).get("pk")]
        try:
            # Run here: a cell that cannot be read shows only now.
            row = diff_summary(frame, target[name], (keys or {}).get(name) or marked).first()
            parts.append((name, row["added"], row["removed"], row["modified"], row["result"], None))
            continue
        except (ValueError, AnalysisException, ArithmeticException, NumberFormatException, DateTimeException, SparkRuntimeException) as error:
            reason = str(error).split("\n")[0][:300]
        parts.append((name, 0, 0, 0, "error", reason))
    schema = "table_name string, added bigint, removed bigint, modified bigint, result string, reason string"
    return spark.createDataFrame(parts, schema)


def diff_missing_target(source: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """With no target every row is added; without keys a row index is the key."""
    if keys:
        return source.select(F.lit("added").alias("status"), *source.columns)
    return source.select(
        F.lit("added").alias("status"),
        F.monotonically_increasing_id().alias("row_index"), *source.columns,
    )


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks (NULL equals NULL)."""
    _need_keys(keys)
    there = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(there, on, "left_anti")


def table_equal(
    source: DataFrame, target: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """One row ``result``. Without keys the tables are compared as bags by
    summing +1 and -1 per distinct row, which combines on the map side."""
    if keys:
        return diff_summary(source, target, keys).select("result")
    columns = common_columns(source, target)
    signed = source.select(*columns, F.lit(1).alias("_n")).unionAll(
        target.select(*columns, F.lit(-1).alias("_n"))
    )
    off = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return off.agg(
        F.when(F.count("*") > 0, "different").otherwise("same").alias("result")
    )
