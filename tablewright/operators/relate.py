"""Joins: relationship diagrams, lookups with arrays of matches, graph search."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import expr
from tablewright.operators.aggregates import gather_chunks, push_chunks
from tablewright.operators.document_filter import match
from tablewright.storage import materialize, work_path

PIECE_ROWS = 10_000_000  # rows of a join that one key gives in one piece, more if that made over
PIECES = 200  # pieces, or
CORE_PIECES = 8  # a core
FAN_OUT = 8  # matches of a left row, on average, up to which a join is left to Spark


class Relationship(NamedTuple):
    source: str
    source_column: str
    target: str
    target_column: str


def join_relationships(
    tables: dict[str, DataFrame], relationships: list[Relationship], root: str | None = None,
    how: str = "left",
) -> DataFrame:
    """Left-deep join over a relationship list from ``root``. All relationships
    between a new table and the joined ones are AND-ed; those left over between
    joined tables become a filter; unconnected ones are skipped. Columns come out
    as ``table_column``."""
    named = {
        n: df.select(*[F.col(c).alias(f"{n}_{c}") for c in df.columns]) for n, df in tables.items()
    }

    def holds(r: Relationship) -> Column:
        return F.col(f"{r.source}_{r.source_column}") == F.col(f"{r.target}_{r.target_column}")

    if root is None or not any(root in (r.source, r.target) for r in relationships):
        root = relationships[0].source
    joined, open_ = {root}, list(relationships)
    out = named[root]
    while True:
        edge = next((r for r in open_ if (r.source in joined) != (r.target in joined)), None)
        if edge is None:
            break
        new = edge.target if edge.source in joined else edge.source
        used = [
            r for r in open_
            if (r.source == new and r.target in joined) or (r.target == new and r.source in joined)
        ]
        out = out.join(named[new], reduce(lambda a, b: a & b, [holds(r) for r in used]), how)
        joined.add(new)
        open_ = [r for r in open_ if r not in used]
    for r in open_:
        if r.source in joined and r.target in joined:
            out = out.where(holds(r))
    return out


def is_array(df: DataFrame, field: str) -> bool:
    """Whether a field, which may be a dotted path, is an array."""
    return isinstance(df.select(field).schema[0].dataType, T.ArrayType)


def _foreign_key(foreign: DataFrame, field: str) -> Column:
    """The values by which a foreign row is found: those of an array each, once."""
    if not is_array(foreign, field):
        return F.col(field)
    return F.explode(F.when(F.col(field).isNull(), F.array(F.lit(None))).otherwise(F.array_distinct(field)))


def lookup_count(left: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str) -> DataFrame:
    """Left rows with the number of their matches: a join with counts that combine in the
    map tasks, and no array of a hot key."""
    if is_array(left, local_field):
        rows = materialize(left.withColumn("_row", F.monotonically_increasing_id()), "lookup")
        there = foreign
        if is_array(foreign, foreign_field):  # a row found by two elements counts once
            there = materialize(foreign.select(foreign_field, F.monotonically_increasing_id().alias("_fid")), "lookup")
        pairs = rows.select("_row", F.explode(F.array_distinct(local_field)).alias("_el")).join(
            there.select(_foreign_key(there, foreign_field).alias("_fk"), *(["_fid"] if "_fid" in there.columns else [])), F.col("_el") == F.col("_fk")
        )
        if "_fid" in there.columns:
            pairs = pairs.select("_row", "_fid").distinct()
        counts = pairs.groupBy("_row").agg(F.count("*").alias("_n"))
        out = rows.join(counts, "_row", "left").drop("_row")
    else:
        counts = foreign.select(_foreign_key(foreign, foreign_field).alias("_fk")).groupBy("_fk").agg(F.count("*").alias("_n"))
        out = left.join(counts, F.col(local_field).eqNullSafe(F.col("_fk")), "left").drop("_fk")
    return out.withColumn(name, F.coalesce("_n", F.lit(0)).cast("int")).drop("_n")


def _heavy_keys(left: DataFrame, foreign: DataFrame, most: int) -> DataFrame | None:
    """``(_k, _rows, _columns)`` of the keys that give more than ``most`` rows of a join, both sides
    ``(_k)``: into how many parts the key's left and foreign rows are dealt. None for a join of fewer
    rows, or of few a left row, which needs no cut.

    The pieces of a key are its parts of the one side times those of the other, and each row is
    copied to all parts of the other side. They are as nearly square as can be, and not more than
    keep all cores busy, so the copies grow with the sides, not with what the join returns."""
    here = left.groupBy("_k").agg(F.count("*").alias("_here"))
    there = foreign.groupBy(F.col("_k").alias("_f")).agg(F.count("*").alias("_there"))
    counts = here.join(there, F.col("_k").eqNullSafe(F.col("_f")), "left").select("_k", "_here", F.coalesce("_there", F.lit(0)).alias("_there"))
    product = F.col("_here").cast("double") * F.col("_there")
    sums = counts.agg(F.sum("_here").alias("rows"), F.sum(product).alias("found")).first()
    found = sums["found"] or 0
    if found <= max(most, FAN_OUT * (sums["rows"] or 0)):
        return None
    most = max(most, found / max(PIECES, CORE_PIECES * left.sparkSession.sparkContext.defaultParallelism))
    heavy = counts.where(product > most).withColumn("_cells", F.ceil(product / most))
    square = F.round(F.sqrt(F.col("_cells") * F.col("_there") / F.col("_here")))
    heavy = heavy.withColumn("_columns", F.greatest(F.lit(1), F.least(square, "_cells", "_there")).cast("int"))
    rows = F.least(F.ceil(F.col("_cells") / F.col("_columns")), "_here").cast("int")
    return materialize(heavy.select("_k", rows.alias("_rows"), "_columns"), "heavy-keys")


def _joined(here: DataFrame, local: str, there: DataFrame, how: str, most: int) -> DataFrame:
    """``here`` joined by ``local`` with ``there``, its rows numbered in ``_fid``, by ``_fk``. Where
    keys have very many matches on both sides, the pairs of their rows are dealt into pieces (see
    ``_heavy_keys``): a shuffle by bytes alone leaves all that output to a few tasks."""
    heavy = _heavy_keys(here.select(F.col(local).alias("_k")), there.select(F.col("_fk").alias("_k")), most)
    if heavy is None:
        return here.join(there, F.col(local).eqNullSafe(F.col("_fk")), how).drop("_fk", "_fid")
    rows, columns = F.coalesce("_rows", F.lit(1)), F.coalesce("_columns", F.lit(1))
    cut = lambda df, key: df.join(heavy, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    part = lambda row, n: F.pmod(F.xxhash64(row), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    here = cut(here, local).withColumn("_part", part(F.monotonically_increasing_id(), rows)).withColumn("_other", each(columns))
    here = here.withColumn("_piece", F.col("_part") * columns + F.col("_other")).drop("_part", "_other", "_rows")
    there = cut(there, "_fk").withColumn("_part", part("_fid", columns)).withColumn("_other", each(rows))
    there = there.withColumn("_copy", F.col("_other") * columns + F.col("_part")).drop("_part", "_other", "_rows", "_columns", "_fid")
    # A broadcast would leave the left rows where they are.
    out = here.join(there.hint("merge"), F.col(local).eqNullSafe(F.col("_fk")) & (F.col("_piece") == F.col("_copy")), how)
    if how == "left":  # a row of a heavy key has matches, if not in this piece
        out = out.where("_columns IS NULL OR _copy IS NOT NULL")
    return out.drop("_fk", "_piece", "_copy", "_columns")


def lookup_rows(
    left: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str, keep_empty: bool = True,
    most: int = PIECE_ROWS,
) -> DataFrame:
    """The long form of ``lookup``: one row per match, the foreign row as struct ``name``
    (NULL for rows without a match, or no such rows). A plain join, which Spark splits on
    hot keys, and which is cut by its output where keys give more than ``most`` rows; the form
    for large data. A local array matches by any element, once."""
    here = left.drop(name)
    numbered = foreign.withColumn("_fid", F.monotonically_increasing_id())  # below the struct, of which unread fields are then not scanned
    there = numbered.select(F.struct(*foreign.columns).alias(name), _foreign_key(foreign, foreign_field).alias("_fk"), "_fid")
    how = "left" if keep_empty else "inner"
    if is_array(left, local_field):
        if keep_empty or is_array(foreign, foreign_field):
            raise ValueError("rows without a match of an array, and arrays on both sides, need lookup")
        keyed = here.withColumn("_el", F.explode(F.array_distinct(local_field)))
        return _joined(keyed.where("_el IS NOT NULL"), "_el", there, how, most).drop("_el")
    if "." in local_field:
        return _joined(here.withColumn("_local", F.col(local_field)), "_local", there, how, most).drop("_local")
    return _joined(here, local_field, there, how, most)


def lookup(
    left: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str,
    order: list[str] | None = None, row_key: list[str] | None = None, size: int | None = None,
) -> DataFrame:
    """Left rows with the array of matching foreign rows (empty when none); a
    missing local value matches missing foreign ones.

    Without ``size`` each left row comes out once, with all its matches in one array, as
    documents have them; a key with very many matches is better served by
    ``lookup_rows``. With ``size`` arrays hold at most that many matches (twice that
    without an ``order``): a row whose key has more comes out once per chunk, numbered
    in ``chunk``, so no match is lost and no task holds a hot key whole. A local array
    matches by any element and needs ``row_key``.
    """
    value = F.struct(*foreign.columns)
    both = is_array(left, local_field) and is_array(foreign, foreign_field)
    if both:
        return _lookup_arrays(left, foreign, local_field, foreign_field, name, row_key)
    keyed = foreign.withColumn("_fk", _foreign_key(foreign, foreign_field))
    if size is None:
        items = F.collect_list(F.struct(*(order or []), value.alias("_v")) if order else value)
        items = F.transform(F.sort_array(items), lambda x: x["_v"]) if order else items
        matches = keyed.groupBy("_fk").agg(items.alias(name)).withColumn("chunk", F.lit(0).cast("bigint"))
    elif order:
        matches = push_chunks(keyed, ["_fk"], value, order, name, size)
    else:
        matches = gather_chunks(keyed, ["_fk"], value, name, size)
    empty = F.coalesce(F.col(name), F.array().cast(matches.schema[name].dataType))
    chunk = F.coalesce(F.col("chunk"), F.lit(0).cast("bigint"))
    if is_array(left, local_field):
        if not row_key:
            raise ValueError("a local array needs row_key")
        wanted = left.select(*row_key, F.explode(F.array_distinct(local_field)).alias("_el"))
        found = wanted.join(matches, F.col("_el") == F.col("_fk"))
        arrays = found.groupBy(*[F.col(k).alias(f"_k_{k}") for k in row_key], "chunk").agg(
            F.flatten(F.sort_array(F.collect_list(F.struct("_el", name))).getField(name)).alias(name)
        )
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in row_key])
        out = left.join(arrays, on, "left").drop(*[f"_k_{k}" for k in row_key])
    else:
        out = left.join(matches, F.col(local_field).eqNullSafe(F.col("_fk")), "left").drop("_fk")
    out = out.withColumns({name: empty, "chunk": chunk})
    return out.drop("chunk") if size is None else out


def _lookup_arrays(left: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str, row_key: list[str] | None) -> DataFrame:
    """Arrays on both sides: a foreign row that several elements find is one match."""
    if not row_key:
        raise ValueError("a local array needs row_key")
    there = materialize(foreign.select(F.struct(*foreign.columns).alias("_v"), foreign_field, F.monotonically_increasing_id().alias("_fid")), "lookup")
    there = there.select("_v", "_fid", _foreign_key(there, there.columns[1]).alias("_fk"))
    pairs = left.select(*row_key, F.explode(F.array_distinct(local_field)).alias("_el")).join(there, F.col("_el") == F.col("_fk"))
    once = pairs.dropDuplicates([*row_key, "_fid"])
    arrays = once.groupBy(*[F.col(k).alias(f"_k_{k}") for k in row_key]).agg(F.collect_list("_v").alias(name))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in row_key])
    out = left.join(arrays, on, "left").drop(*[f"_k_{k}" for k in row_key])
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(arrays.schema[name].dataType)))


def lookup_pipeline(
    left: DataFrame, foreign: DataFrame, let: dict[str, Any], stages: list[dict[str, Any]], name: str,
    run_stages: Callable[[DataFrame, list[dict[str, Any]]], DataFrame],
) -> DataFrame:
    """``lookup`` by a pipeline: ``$match`` stages with ``$expr`` over foreign fields and the
    ``$$`` variables of ``let`` are the join condition (equalities make it a hash or
    sort join); stages after them may compute fields. Without such a match every
    left row gets all rows that the pipeline gives, so those should be few."""
    rows = materialize(left.withColumn("_row", F.monotonically_increasing_id()), "lookup")
    bound = rows.select("_row", *[expr(v).alias(f"_let_{k}") for k, v in let.items()])
    env = {k: F.col(f"_let_{k}") for k in let}
    on, rest, at = [], [], 0
    for at, stage in enumerate(stages):
        body = stage.get("$match")
        if body is None or "$expr" not in body:
            break
        on.append(expr(body["$expr"], env))
        if plain := {k: v for k, v in body.items() if k != "$expr"}:
            rest.append({"$match": plain})
    else:
        at = len(stages)
    later = stages[at:]
    for stage in later:
        op = next(iter(stage))
        if on and op not in ("$match", "$project", "$addFields", "$set", "$unset"):
            raise ValueError(f"{op} after a correlated $match of $lookup is not supported")
    if on:
        found = bound.join(run_stages(foreign, rest), reduce(lambda a, b: a & b, on)).drop(*[f"_let_{k}" for k in let])
        kept = [
            {"$project": {"_row": 1, **s["$project"]}} if "$project" in s and any(v not in (0, False) for v in s["$project"].values()) else s
            for s in later
        ]
        found = run_stages(found, kept)
        fields = [c for c in found.columns if c != "_row"]
        arrays = found.groupBy(F.col("_row").alias("_of")).agg(F.collect_list(F.struct(*fields)).alias(name))
        out = rows.join(arrays, F.col("_row") == F.col("_of"), "left").drop("_of")
    else:
        found = run_stages(foreign, stages)
        one = found.agg(F.collect_list(F.struct(*found.columns)).alias(name)).withColumn("_one", F.lit(1))
        out = rows.withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one")
    kind = out.schema[name].dataType
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind))).drop("_row")


def graph_lookup(
    starts: DataFrame, edges: DataFrame, connect_from: str, connect_to: str, max_depth: int | None = None,
    restrict: dict | None = None,
) -> DataFrame:
    """Rows reachable from each start: ``(start, node, depth)`` with least depth.

    ``starts`` is ``(start, value)``; a level matches rows whose ``connect_to`` equals
    the values so far and goes on with their ``connect_from``. Each level is one
    join of the frontier, written so that the lineage stays short; nodes seen
    before are dropped, so cycles end. Without ``max_depth`` it ends when a level
    finds nothing new.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must not be negative")
    spark = starts.sparkSession
    rows = materialize(
        match(edges, restrict or {})
        .select(F.col(connect_to).alias("_to"), F.col(connect_from).alias("_next"))
        .distinct(),
        "edges",
    )
    frontier = starts.toDF("start", "value")
    folder = work_path(spark, "reached")
    schema = seen = None
    for depth in itertools.count() if max_depth is None else range(max_depth + 1):
        reached = frontier.join(rows, F.col("value") == F.col("_to")).select(
            "start", F.col("_to").alias("node"), "_next", F.lit(depth).alias("depth")
        )
        if seen is not None:
            reached = reached.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        reached.write.parquet(f"{folder}/level={depth}")
        schema = schema or T.StructType([*reached.schema.fields, T.StructField("level", T.IntegerType())])
        seen = spark.read.schema(schema).parquet(folder)
        level = seen.where(F.col("level") == depth)
        if level.isEmpty():
            break
        frontier = level.where("_next IS NOT NULL").select("start", F.col("_next").alias("value")).distinct()
    return seen.select("start", "node", "depth").distinct()
