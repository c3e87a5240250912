"""From a keyed difference to a sync plan, SQL text or a new table version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.literals import ident, key_predicate, literal_of
from tablewright.operators.diff import (
    SRC, TGT, check_keys, common_columns, diff_join, diff_rows, side,
)
from tablewright.operators.segments import with_running_index

# Rows per generated statement.
INSERT_BATCH = 500
CONDITION_BATCH = 200


def generated_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if (f.metadata or {}).get("generated")]


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def sync_plan(
    source: DataFrame, target: DataFrame, keys: list[str],
    columns: list[str] | None = None, generated: list[str] | None = None,
    checked: bool = True,
) -> DataFrame:
    """Counts of inserts, updates, deletes and statements. A modified row whose
    only changes are in generated columns is no update."""
    skip = set(generated or generated_columns(target))
    joined = diff_join(source, target, keys, columns, checked)
    cells = [c[2:] for c in joined.columns if c.startswith("c_")]
    writable = _any([F.col(f"c_{c}") for c in cells if c not in skip])
    counts = joined.agg(
        F.count_if(F.col("status") == "added").alias("inserts"),
        F.count_if((F.col("status") == "modified") & writable).alias("updates"),
        F.count_if(F.col("status") == "removed").alias("deletes"),
    )
    batches = (
        F.ceil(F.col("inserts") / INSERT_BATCH)
        + F.ceil(F.col("updates") / CONDITION_BATCH)
        + F.ceil(F.col("deletes") / CONDITION_BATCH)
    )
    return counts.withColumn("statements", batches.cast("bigint"))


def sync_statements(
    source: DataFrame, target: DataFrame, keys: list[str], table: str,
    columns: list[str] | None = None, generated: list[str] | None = None,
    checked: bool = True,
) -> DataFrame:
    """One statement per differing row: ``(step, keys..., statement)`` with
    step 1 insert, 2 update, 3 delete. The form to use on large differences."""
    skip = set(generated or generated_columns(target))
    order = columns or common_columns(source, target)
    rows = diff_rows(source, target, keys, columns, checked)
    cells = [c for c in order if c not in keys]
    written = [c for c in order if c not in skip]
    value = {c: literal_of(rows, c) if c in keys else literal_of(rows, c, SRC) for c in order}
    if written:
        names = ", ".join(ident(c) for c in written)
        insert = F.concat(
            F.lit(f"INSERT INTO {ident(table)} ({names}) VALUES ("),
            F.concat_ws(", ", *[value[c] for c in written]), F.lit(");"),
        )
    else:
        insert = F.lit(f"INSERT INTO {ident(table)} DEFAULT VALUES;")
    sets = [
        F.when(
            ~F.col(SRC + c).eqNullSafe(F.col(TGT + c)),
            F.concat(F.lit(f"{ident(c)} = "), value[c]),
        )
        for c in cells if c not in skip
    ]
    where = key_predicate(rows, keys)
    update = F.when(
        F.concat_ws("", *sets) != "",
        F.concat(
            F.lit(f"UPDATE {ident(table)} SET "), F.concat_ws(", ", *sets),
            F.lit(" WHERE "), where, F.lit(";"),
        ),
    )
    delete = F.concat(F.lit(f"DELETE FROM {ident(table)} WHERE "), where, F.lit(";"))
    status = F.col("status")
    step = F.when(status == "added", 1).when(status == "modified", 2).otherwise(3)
    text = F.when(status == "added", insert).when(status == "modified", update).otherwise(delete)
    return rows.select(step.alias("step"), *keys, text.alias("statement")).where(
        F.col("statement").isNotNull()
    )


def sync_insert_batches(
    rows: DataFrame, order: list[str], table: str, columns: list[str] | None = None,
    batch: int = INSERT_BATCH,
) -> DataFrame:
    """Multi-row inserts: ``(batch_no, statement)`` with ``batch`` rows each."""
    names = columns or rows.columns
    values = F.concat(
        F.lit("("), F.concat_ws(", ", *[literal_of(rows, c) for c in names]), F.lit(")")
    )
    numbered = with_running_index(rows.select(*order, values.alias("_v")), order, "_at")
    head = f"INSERT INTO {ident(table)} ({', '.join(ident(c) for c in names)}) VALUES "
    return _batched(numbered, batch, F.lit(head), ", ", F.lit(";"))


def sync_delete_batches(
    rows: DataFrame, keys: list[str], table: str, batch: int = CONDITION_BATCH
) -> DataFrame:
    """Deletes whose key predicates are OR-ed, ``batch`` rows per statement."""
    text = F.concat(F.lit("("), key_predicate(rows, keys), F.lit(")"))
    numbered = with_running_index(rows.select(*keys, text.alias("_v")), keys, "_at")
    return _batched(
        numbered, batch, F.lit(f"DELETE FROM {ident(table)} WHERE "), " OR ", F.lit(";")
    )


def sync_update_batches(
    source: DataFrame, target: DataFrame, keys: list[str], table: str,
    columns: list[str] | None = None, generated: list[str] | None = None,
    batch: int = CONDITION_BATCH, checked: bool = True,
) -> DataFrame:
    """``UPDATE ... SET c = CASE WHEN key THEN value ... ELSE c END`` batches."""
    skip = set(generated or generated_columns(target))
    rows = diff_rows(source, target, keys, columns, checked).where("status = 'modified'")
    cells = [c[2:] for c in rows.columns if c.startswith(SRC) and c[2:] not in skip]
    differs = {c: ~F.col(SRC + c).eqNullSafe(F.col(TGT + c)) for c in cells}
    rows = rows.where(_any(list(differs.values())))
    where = key_predicate(rows, keys)
    branch = {
        c: F.when(differs[c], F.concat(F.lit("WHEN "), where, F.lit(" THEN "), literal_of(rows, c, SRC)))
        for c in cells
    }
    numbered = with_running_index(
        rows.select(*keys, where.alias("_w"), *[branch[c].alias(f"b_{c}") for c in cells]),
        keys, "_at",
    )
    ordered = lambda name: F.transform(
        F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("_at", F.col(name).alias("v"))))),
        lambda x: x["v"],
    )
    grouped = numbered.groupBy(F.floor(F.col("_at") / batch).cast("bigint").alias("batch_no")).agg(
        ordered("_w").alias("w"), *[ordered(f"b_{c}").alias(f"b_{c}") for c in cells]
    )
    sets = [
        F.when(
            F.size(f"b_{c}") > 0,
            F.concat(
                F.lit(f"{ident(c)} = CASE "), F.concat_ws(" ", f"b_{c}"),
                F.lit(f" ELSE {ident(c)} END"),
            ),
        )
        for c in cells
    ]
    either = F.concat_ws(" OR ", F.transform("w", lambda x: F.concat(F.lit("("), x, F.lit(")"))))
    text = F.concat(
        F.lit(f"UPDATE {ident(table)} SET "), F.concat_ws(", ", *sets), F.lit(" WHERE "),
        either, F.lit(";"),
    )
    return grouped.select("batch_no", text.alias("statement"))


def _batched(numbered: DataFrame, batch: int, head: Column, glue: str, tail: Column) -> DataFrame:
    grouped = numbered.groupBy(F.floor(F.col("_at") / batch).cast("bigint").alias("batch_no")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("v")
    )
    body = F.concat_ws(glue, F.transform("v", lambda x: x["_v"]))
    return grouped.select("batch_no", F.concat(head, body, tail).alias("statement"))


def sync_apply(
    source: DataFrame, target: DataFrame, keys: list[str], insert: bool = True,
    update: bool = True, delete: bool = True, checked: bool = True,
) -> DataFrame:
    """The target after the chosen changes, from one full-outer join. Columns
    only the target has keep their values (NULL on inserted rows)."""
    if checked:
        check_keys(source, target, keys)
    shared = set(common_columns(source, target))
    cells = [c for c in target.columns if c in shared and c not in keys]
    extra = [c for c in target.columns if c not in shared]
    left = source.select(  # values as they are: only comparisons read NaN as NULL
        *[F.col(k).alias(f"{SRC}key_{k}") for k in keys],
        *[F.col(c).alias(SRC + c) for c in cells], F.lit(True).alias(f"{SRC}here"),
    )
    right = target.select(
        *[F.col(k).alias(f"{TGT}key_{k}") for k in keys],
        *[F.col(c).alias(TGT + c) for c in [*cells, *extra]], F.lit(True).alias(f"{TGT}here"),
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(f"{SRC}key_{k}").eqNullSafe(F.col(f"{TGT}key_{k}")) for k in keys],
    )
    joined = left.join(right, on, "full_outer")
    in_s, in_t = F.col(f"{SRC}here").isNotNull(), F.col(f"{TGT}here").isNotNull()
    keep = (in_s & in_t) | (in_s & F.lit(insert)) | (in_t & F.lit(not delete))
    take = in_s & (F.lit(update) | ~in_t)
    value = {k: F.coalesce(f"{SRC}key_{k}", f"{TGT}key_{k}") for k in keys}
    value |= {c: F.when(take, F.col(SRC + c)).otherwise(F.col(TGT + c)) for c in cells}
    value |= {c: F.col(TGT + c) for c in extra}
    return joined.where(keep).select(*[value[c].alias(c) for c in target.columns])
