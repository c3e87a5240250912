"""Applying and undoing a set of cell edits, row inserts and row deletes.

A changeset is a long DataFrame ``(op, key columns, column, value, seq)`` with op
``update``, ``insert`` or ``delete``; values are text and are cast to the column
type. It is folded to one row per key before it meets the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.sync import generated_columns


class InvalidChangeset(ValueError):
    pass


def check_changeset(changes: DataFrame, keys: list[str]) -> None:
    """Every key column must be present and not NULL, or the save is refused."""
    missing = [k for k in keys if k not in changes.columns]
    if missing:
        raise InvalidChangeset(f"missing key columns: {', '.join(missing)}")
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    if changes.where(null_key).take(1):
        raise InvalidChangeset("a change has a NULL key column")


def _fold(changes: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    aggs = [F.max_by("op", "seq").alias("_op")]
    for c in cells:
        mine = F.col("column") == c
        stamp = F.when(mine, F.col("seq"))
        aggs.append(F.max_by("value", stamp).alias(f"v_{c}"))
        aggs.append(F.coalesce(F.bool_or(mine), F.lit(False)).alias(f"p_{c}"))
    return changes.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*aggs)


def changeset_apply(
    base: DataFrame, changes: DataFrame, keys: list[str],
    defaults: dict[str, str] | None = None, checked: bool = True,
) -> DataFrame:
    """The table after the edits. Edits of generated columns are dropped; a NULL
    cell of an inserted row takes the column's default."""
    if checked:
        check_changeset(changes, keys)
    skip = set(generated_columns(base))
    cells = [c for c in base.columns if c not in keys and c not in skip]
    kind = {f.name: f.dataType for f in base.schema}
    folded = _fold(changes, keys, cells)
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    joined = base.withColumn("_here", F.lit(True)).join(folded, on, "full_outer")
    here, op = F.col("_here").isNotNull(), F.col("_op")
    keep = (here & (op.isNull() | (op != "delete"))) | (~here & (op == "insert"))
    value = {k: F.coalesce(F.col(k), F.col(f"_k_{k}")) for k in keys}
    for c in base.columns:
        if c in keys:
            continue
        if c in skip:
            value[c] = F.col(c)
            continue
        new = F.col(f"v_{c}").cast(kind[c])
        default = F.lit((defaults or {}).get(c)).cast(kind[c])
        value[c] = (
            F.when(~here, F.coalesce(new, default))
            .when(F.col(f"p_{c}") & (op == "update"), new)
            .otherwise(F.col(c))
        )
    return joined.where(keep).select(*[value[c].alias(c) for c in base.columns])


def changeset_rollback(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse changeset against the table as it was before the edits:
    inserted rows are deleted, deleted rows inserted, old cells put back."""
    skip = set(generated_columns(base))
    cells = [c for c in base.columns if c not in keys and c not in skip]
    folded = _fold(changes, keys, cells)
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    old = folded.join(base, on, "left")
    op = F.col("_op")
    pieces = [
        F.when(
            (op == "delete") | ((op == "update") & F.col(f"p_{c}")),
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")),
        )
        for c in cells
    ]
    whole = F.when(
        op == "insert",
        F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value")),
    )
    inverse = F.when(op == "insert", "delete").when(op == "delete", "insert").otherwise("update")
    return old.select(
        inverse.alias("op"), *[F.col(f"_k_{k}").alias(k) for k in keys],
        F.inline(F.array_compact(F.array(whole, *pieces))),
    )
