"""Rows to cells and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_cells(df: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per cell: ids, ``column``, ``type``, ``value`` (text), ``is_null``."""
    names = columns or [c for c in df.columns if c not in ids]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"),
            F.col(c).cast("string").alias("value"), F.col(c).isNull().alias("is_null"),
        )
        for c in names
    ]
    return df.select(*ids, F.inline(F.array(*cells)))


def transpose(
    df: DataFrame, record: str, records: list[str], columns: list[str] | None = None
) -> DataFrame:
    """One row per column with one value per record. The record names become
    columns, so the caller lists them; any number of rows is folded on the map
    side before the shuffle."""
    cells = unpivot_cells(df, [record], columns)
    value: list[Column] = [
        F.max(F.when(F.col(record).cast("string") == r, F.col("value"))).alias(r) for r in records
    ]
    return cells.groupBy("column").agg(*value)
