"""Copying, upserting and merging tables, and document updates.

Files have no row updates, so each function returns the new version of the
target; ``sources.writers.replace_table`` swaps it in.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import expr, literal
from tablewright.operators.diff import check_keys
from tablewright.operators.document_filter import field_type, filter_document


def writable(df: DataFrame, name_case: str = "keep") -> DataFrame:
    """Without generated columns; names in the wanted case; a name that appears
    twice (ignoring case) is kept once."""
    seen, out = set(), []
    for f in df.schema:
        if (f.metadata or {}).get("generated") or f.name.lower() in seen:
            continue
        seen.add(f.name.lower())
        name = {"lower": f.name.lower(), "upper": f.name.upper()}.get(name_case, f.name)
        out.append(F.col(f.name).alias(name))
    return df.select(*out)


def conformed(source: DataFrame, target: DataFrame, name_case: str = "keep") -> DataFrame:
    """The writable columns of ``source`` in the target's columns and types."""
    rows = writable(source, name_case)
    missing = [c for c in target.columns if c not in rows.columns]
    kinds = {f.name: f.dataType for f in target.schema}
    rows = rows.withColumns({c: F.lit(None).cast(kinds[c]) for c in missing})
    return rows.select(*[F.col(c).cast(kinds[c]) for c in target.columns])


def transfer_append(source: DataFrame, target: DataFrame, name_case: str = "keep") -> DataFrame:
    """Target and new rows as one frame. To append to a stored table, use
    ``append_files``, which writes the new rows alone."""
    return target.unionByName(conformed(source, target, name_case))


def append_files(source: DataFrame, path: str, name_case: str = "keep") -> None:
    """Add the rows to the table at ``path`` as new files; the old ones are not read."""
    target = source.sparkSession.read.parquet(path)
    conformed(source, target, name_case).write.mode("append").parquet(path)


def transfer_overwrite(source: DataFrame, target: DataFrame, name_case: str = "keep") -> DataFrame:
    return conformed(source, target, name_case)


def last_per_key(df: DataFrame, keys: list[str], sequence: str | None) -> DataFrame:
    """One row per key, the one with the greatest sequence; combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    stamp = F.col(sequence) if sequence else F.lit(0)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(stamp, F.struct(*rest))).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def transfer_upsert(
    source: DataFrame, target: DataFrame, keys: list[str], sequence: str | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Insert or update by key. Without keys this appends; a table of nothing but
    keys keeps its rows. Rows that share a key resolve to the last by ``sequence``.
    A table has no order of its own, so without a ``sequence`` repeated keys are
    refused (skip the check with ``distinct``)."""
    if not keys:
        return transfer_append(source, target)
    if not distinct and sequence is None:
        check_keys(source, source.limit(0), keys)
    elif not distinct:
        source = last_per_key(source, keys, sequence)
    return merge_into(source, target, keys, "replace", checked=False)


def merge_into(
    source: DataFrame, target: DataFrame, on: list[str], matched: str = "merge",
    not_matched: str = "insert", checked: bool = True,
) -> DataFrame:
    """The target after merging. A NULL key is a key like any other, as in a diff. A key
    that repeats in the source would multiply target rows, so it is refused; leave
    ``checked`` out where keys are known to be unique. ``matched``: replace, keepExisting, merge (source
    fields win, fields only the target has stay) or fail; ``not_matched``:
    insert, discard or fail."""
    if checked:
        check_keys(source, source.limit(0), on)
    cells = [c for c in target.columns if c not in on]
    kinds = {f.name: f.dataType for f in target.schema}
    has = set(source.columns)
    s = source.select(
        *[F.col(k).alias(f"sk_{k}") for k in on], *[F.col(c).alias(f"s_{c}") for c in cells if c in has],
        F.lit(True).alias("_s"),
    )
    t = target.withColumn("_t", F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"sk_{k}")) for k in on])
    joined = t.join(s, cond, "left" if not_matched == "discard" else "full_outer")
    in_s, in_t = F.col("_s").isNotNull(), F.col("_t").isNotNull()

    def failing(test: Column, text: str, value: Column, kind: T.DataType) -> Column:
        return F.when(test, F.raise_error(F.lit(text)).cast(kind)).otherwise(value)

    out = []
    for c in target.columns:
        if c in on:
            value = F.coalesce(F.col(c), F.col(f"sk_{c}"))
        else:
            new = F.col(f"s_{c}") if c in has else F.lit(None).cast(kinds[c])
            if matched == "keepExisting":
                value = F.when(in_t, F.col(c)).otherwise(new)
            elif matched == "merge" and c not in has:
                value = F.col(c)
            else:
                value = F.when(in_s, new).otherwise(F.col(c))
        if matched == "fail":
            value = failing(in_s & in_t, "a merged row matches an existing one", value, kinds[c])
        if not_matched == "fail":
            value = failing(in_s & ~in_t, "a merged row matches no existing one", value, kinds[c])
        out.append(value.cast(kinds[c]).alias(c))
    return joined.select(*out)


def transfer_docs(df: DataFrame, name: str = "document") -> DataFrame:
    """Rows as JSON documents; NULL fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def docs_to_rows(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON documents as rows of the union schema; missing fields are NULL."""
    return df.select(F.from_json(F.col(column), schema).alias("_d")).select("_d.*")


# --- document updates -------------------------------------------------------

def _push(kind: T.ArrayType, c: Column, arg: Any) -> Column:
    spec = arg if isinstance(arg, dict) and "$each" in arg else {"$each": [arg]}
    new = literal(spec["$each"]).cast(kind) if spec["$each"] else F.array().cast(kind)
    array = F.coalesce(c, F.array().cast(kind))
    if "$position" in spec:
        at = F.lit(spec["$position"])
        if spec["$position"] < 0:  # counted from the end
            at = F.greatest(F.size(array) + at, F.lit(0))
        out = F.concat(
            F.slice(array, F.lit(1), at), new,
            F.slice(array, at + 1, F.greatest(F.size(array) - at, F.lit(0))),
        )
    else:
        out = F.concat(array, new)
    if "$sort" in spec:
        out = _sorted(out, spec["$sort"])
    if "$slice" in spec:
        n = spec["$slice"]
        head = F.slice(out, F.lit(1), F.lit(max(n, 0)))
        tail = F.slice(out, F.greatest(F.size(out) + n + 1, F.lit(1)), F.lit(abs(n)))
        out = head if n >= 0 else tail
    return out


def _sorted(array: Column, by: Any) -> Column:
    """Values by direction, or documents by their fields."""
    if not isinstance(by, dict):
        return F.sort_array(array, asc=by > 0)

    def order(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, way in reversed(by.items()):
            x, y = a.getField(name), b.getField(name)
            out = (
                F.when(x.isNull() & y.isNotNull(), -way).when(x.isNotNull() & y.isNull(), way)
                .when(x < y, -way).when(x > y, way).otherwise(out)
            )
        return out

    return F.array_sort(array, order)


def _pull(c: Column, arg: Any) -> Column:
    if isinstance(arg, dict):
        tests = {
            "$gt": lambda x, v: x > v, "$gte": lambda x, v: x >= v, "$lt": lambda x, v: x < v,
            "$lte": lambda x, v: x <= v, "$eq": lambda x, v: x == v, "$ne": lambda x, v: x != v,
            "$in": lambda x, v: x.isin(list(v)),
        }
        return F.filter(c, lambda x: ~reduce(lambda a, b: a & b, [tests[k](x, v) for k, v in arg.items()]))
    return F.filter(c, lambda x: x != literal(arg))


def updated(df: DataFrame, op: str, name: str, arg: Any, now: Column) -> Column:
    """New value of one field under one update operator."""
    c, kind = F.col(name), field_type(df.schema, name)
    if kind is None:
        raise ValueError(f"unknown field {name}")
    value = None if isinstance(arg, dict) else literal(arg)
    if op == "$set":
        return expr(arg) if isinstance(arg, Column) else literal(arg).cast(kind)
    if op == "$unset":
        return F.lit(None).cast(kind)
    if op == "$inc":
        return F.coalesce(c, F.lit(0)) + value
    if op == "$mul":
        return F.coalesce(c, F.lit(0)) * value
    if op == "$min":
        return F.least(c, value)
    if op == "$max":
        return F.greatest(c, value)
    if op == "$currentDate":
        return now.cast(kind)
    if op == "$push":
        return _push(kind, c, arg)
    if op == "$addToSet":
        each = arg["$each"] if isinstance(arg, dict) and "$each" in arg else [arg]
        array = F.coalesce(c, F.array().cast(kind))
        new = literal(each).cast(kind)
        # Values already there stay as they are, copies included.
        fresh = F.filter(F.array_distinct(new), lambda x: ~F.array_contains(array, x))
        return F.concat(array, fresh)
    if op == "$pop":
        keep = F.greatest(F.size(c) - 1, F.lit(0))
        return F.slice(c, F.lit(1 if arg > 0 else 2), keep)
    if op == "$pull":
        return _pull(c, arg)
    if op == "$pullAll":
        drop = literal(list(arg)).cast(kind)
        return F.filter(c, lambda x: ~F.array_contains(drop, x))
    if op == "$bit":
        for word, operand in arg.items():
            fn = {"and": c.bitwiseAND, "or": c.bitwiseOR, "xor": c.bitwiseXOR}[word]
            c = fn(F.lit(operand))
        return c
    raise ValueError(f"unknown update operator {op}")


def update_documents(
    df: DataFrame, where: dict[str, Any], update: dict[str, dict[str, Any]],
    now: Column | None = None,
) -> DataFrame:
    """Apply update operators to the rows matching a document filter."""
    hit = F.coalesce(filter_document(df.schema, where), F.lit(True)) if not where else F.coalesce(
        filter_document(df.schema, where), F.lit(False)
    )
    now = F.current_timestamp() if now is None else now
    values: dict[str, Column] = {}
    renames: dict[str, str] = {}
    for op, fields in update.items():
        if op == "$setOnInsert":
            continue  # only an upsert that inserts uses it
        if op == "$rename":
            renames |= fields
            continue
        for name, arg in fields.items():
            new = updated(df, op, name, arg, now).cast(field_type(df.schema, name))
            head, _, rest = name.partition(".")
            if rest:  # a field inside a document; a missing document is made
                whole, kind = values.get(head, F.col(head)), df.schema[head].dataType
                blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind])
                values[head] = F.when(hit, F.coalesce(whole, blank).withField(rest, new)).otherwise(F.col(head))
            else:
                values[name] = F.when(hit, new).otherwise(F.col(name))
    out = df.withColumn("_hit", hit).withColumns(values)
    for old, new in renames.items():
        if new not in out.columns:
            out = out.withColumn(new, F.lit(None).cast(df.schema[old].dataType))
        out = out.withColumns({
            new: F.when(F.col("_hit"), F.col(old)).otherwise(F.col(new)),
            old: F.when(~F.col("_hit"), F.col(old)),
        })
    return out.drop("_hit")


def upsert_document(
    df: DataFrame, where: dict[str, Any], update: dict[str, dict[str, Any]], now: Column | None = None
) -> DataFrame:
    """``update_documents`` that adds one row when nothing matches: the filter's
    equalities and ``$setOnInsert`` give its fields, then the update operators act on it."""
    if df.where(filter_document(df.schema, where)).take(1):
        return update_documents(df, where, update, now)
    fields = {k: v for k, v in where.items() if not k.startswith("$") and not isinstance(v, dict)}
    fields |= update.get("$setOnInsert", {})
    row = df.sparkSession.range(1).select(
        *[(literal(fields[f.name]) if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]
    )
    # The other operators act on the new document as on any.
    rest = {op: body for op, body in update.items() if op != "$setOnInsert"}
    return df.unionByName(update_documents(row, {}, rest, now))
