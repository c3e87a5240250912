"""Document stages as DataFrame calls: find, project, unwind and friends."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import expr
from tablewright.operators.document_filter import match
from tablewright.operators.stage_plan import rewrite
from tablewright.storage import materialize


def sort_columns(spec: dict[str, int]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if way > 0 else F.col(c).desc_nulls_last() for c, way in spec.items()]


def sort(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    return df.orderBy(*sort_columns(spec))


def _without(kind: T.DataType, c: Column, path: list[str]) -> Column:
    """A nested value less the field at ``path``; arrays lose it in every element."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _without(kind.elementType, e, path))
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        return c
    if len(path) > 1:
        return c.withField(path[0], _without(kind[path[0]].dataType, c[path[0]], path[1:]))
    if kind.names == path:
        raise ValueError(f"{path[0]} is the only field beside it; drop what holds it")
    return c.dropFields(path[0])


def _with(kind: T.DataType | None, c: Column | None, path: list[str], value: Column) -> Column:
    """A nested value with the field at ``path`` set; what is missing on the way is made."""
    if not path:
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _with(kind.elementType, e, path, value))
    if not isinstance(kind, T.StructType):
        return F.struct(_with(None, None, path[1:], value).alias(path[0]))
    whole = F.coalesce(c, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind]))
    inner = kind[path[0]].dataType if path[0] in kind.names else None
    return whole.withField(path[0], _with(inner, None if inner is None else whole[path[0]], path[1:], value))


def _top(df: DataFrame, name: str) -> tuple[str, T.DataType | None, list[str]]:
    """First part of a dotted name, its type, and the other parts. A column of the whole
    name comes first."""
    first, *path = [name] if name in df.columns else name.split(".")
    return first, df.schema[first].dataType if first in df.columns else None, path


def project(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Include (1), exclude (0) or computed fields; a dotted name excludes a nested one."""
    if all(v in (0, False) for v in spec.values()):
        for name in spec:
            first, kind, path = _top(df, name)
            if not path:
                df = df.drop(first)
            elif kind is not None:
                df = df.withColumn(first, _without(kind, F.col(first), path))
        return df
    out = []
    for name, value in spec.items():
        if value in (0, False):
            continue
        out.append(F.col(name) if value in (1, True) and not isinstance(value, str) else expr(value).alias(name))
    return df.select(*out)


def add_fields(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Set fields, all from the row as it was; a dotted name sets a nested one."""
    plain = {n: expr(v) for n, v in spec.items() if not _top(df, n)[2]}
    nested = {n: expr(v) for n, v in spec.items() if n not in plain}
    out = df.withColumns({f"_set_{i}": v for i, v in enumerate(nested.values())}) if nested else df
    out = out.withColumns(plain)
    for i, name in enumerate(nested):
        first, kind, path = _top(out, name)
        out = out.withColumn(first, _with(kind, None if kind is None else F.col(first), path, F.col(f"_set_{i}")))
    return out.drop(*[f"_set_{i}" for i in range(len(nested))])


def unset(df: DataFrame, names: str | list[str]) -> DataFrame:
    return df.drop(*([names] if isinstance(names, str) else names))


def replace_root(df: DataFrame, new_root: Any) -> DataFrame:
    return df.select(expr(new_root).alias("_root")).select("_root.*")


def unwind(
    df: DataFrame, path: str, index: str | None = None, keep_empty: bool = False
) -> DataFrame:
    """One row per array element; a scalar counts as an array of one. A dotted path unwinds
    a nested array in its place."""
    name = path.lstrip("$")
    first, kind, below = _top(df, name)
    source = ".".join([f"`{first}`", *below])
    values = F.col(source)
    if not isinstance(df.select(values).schema[0].dataType, T.ArrayType):
        values = F.when(values.isNotNull(), F.array(values))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    if below:
        out = df.select("*", explode(values).alias("_at", "_el")).withColumn(first, _with(kind, F.col(first), below, F.col("_el"))).drop("_el")
    else:
        out = df.select(*[c for c in df.columns if c != name], explode(values).alias("_at", name))
    if index:
        return out.withColumn(index, F.col("_at").cast("bigint")).drop("_at")
    return out.drop("_at")


def find_documents(
    df: DataFrame, body: dict[str, Any], projection: dict[str, Any] | None = None,
    order: dict[str, int] | None = None, skip: int = 0, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The page of documents, and a one-row ``total`` counted with the filter."""
    found = match(df, body)
    total = found.agg(F.count("*").alias("total"))
    page = sort(found, order) if order else found
    page = page.offset(skip) if skip else page
    page = page if limit is None else page.limit(limit)
    return (project(page, projection) if projection else page), total


def count(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def sort_by_count(df: DataFrame, by: Any) -> DataFrame:
    return df.groupBy(expr(by).alias("_id")).agg(F.count("*").alias("count")).orderBy(
        F.desc("count"), F.asc_nulls_first("_id")
    )


def union_with(df: DataFrame, other: DataFrame) -> DataFrame:
    """Bag union; a field only one side has is NULL on the other."""
    return df.unionByName(other, allowMissingColumns=True)


def sample(df: DataFrame, size: int, by: list[str], seed: int = 0) -> DataFrame:
    """``size`` rows chosen by a hash of ``by``: the same rows on every run."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])
    keyed = df.withColumn("_h", F.md5(text))
    return keyed.orderBy("_h", *by).limit(size).drop("_h")


def literal_rows(spark, rows: list[dict[str, Any]], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_SIMPLE = {
    "$match": match, "$sort": sort, "$project": project, "$addFields": add_fields,
    "$set": add_fields, "$unset": unset, "$replaceWith": replace_root,
    "$limit": lambda df, n: df.limit(n), "$skip": lambda df, n: df.offset(n),
    "$count": count, "$sortByCount": sort_by_count,
    "$replaceRoot": lambda df, a: replace_root(df, a["newRoot"]),
}


def facet_rows(df: DataFrame, parts: dict[str, list], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """``$facet`` as rows ``(facet, document)``, the documents as JSON text, since the
    facets differ in their fields and have any number of documents."""
    out = None
    for name, stages in parts.items():
        rows = apply_stages(df, stages, tables)
        rows = rows.select(F.lit(name).alias("facet"), F.to_json(F.struct(*rows.columns)).alias("document"))
        out = rows if out is None else out.unionAll(rows)
    return out


def _graph_lookup(df: DataFrame, arg: dict[str, Any], tables: dict[str, DataFrame]) -> DataFrame:
    """Each row with the array of documents reachable from its ``startWith``."""
    from tablewright.operators import relate

    foreign = tables[arg["from"]]
    rows = df.withColumn("_start", expr(arg["startWith"]))
    starts = rows.where("_start IS NOT NULL").select(F.col("_start").alias("start"), F.col("_start").alias("value")).distinct()
    reached = relate.graph_lookup(
        starts, foreign, arg["connectFromField"], arg["connectToField"], arg.get("maxDepth"), arg.get("restrictSearchWithMatch")
    )
    allowed = match(foreign, arg.get("restrictSearchWithMatch") or {})
    depth = [F.col("depth").cast("bigint").alias(arg["depthField"])] if "depthField" in arg else []
    found = reached.join(allowed, F.col("node") == allowed[arg["connectToField"]])
    arrays = found.groupBy(F.col("start").alias("_s")).agg(
        F.collect_list(F.struct(*[allowed[c] for c in allowed.columns], *depth)).alias(arg["as"])
    )
    out = rows.join(arrays, F.col("_start") == F.col("_s"), "left").drop("_start", "_s")
    return out.withColumn(arg["as"], F.coalesce(F.col(arg["as"]), F.array().cast(arrays.schema[arg["as"]].dataType)))


def _merge(df: DataFrame, arg: dict[str, Any] | str, tables: dict[str, DataFrame]) -> DataFrame:
    """The new version of the target; ``sources.writers.replace_table`` puts it in place."""
    from tablewright.operators import transfer

    spec = {"into": arg} if isinstance(arg, str) else arg
    on = spec.get("on", "_id")
    modes = (spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert"))
    return transfer.merge_into(df, tables[spec["into"]], [on] if isinstance(on, str) else list(on), *modes)


def _lookup(df: DataFrame, arg: dict[str, Any], tables: dict[str, DataFrame]) -> DataFrame:
    from tablewright.operators import relate

    foreign, pipeline = tables[arg["from"]], arg.get("pipeline") or []
    if "localField" not in arg:
        return relate.lookup_pipeline(df, foreign, arg.get("let", {}), pipeline, arg["as"], lambda d, s: apply_stages(d, s, tables))
    if arg.get("let"):
        raise ValueError("$lookup takes localField or let, not both")
    if pipeline:
        foreign = apply_stages(foreign, pipeline, tables)
    keys = None
    if relate.is_array(df, arg["localField"]):
        df, keys = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "lookup"), ["_row"]
    return relate.lookup(df, foreign, arg["localField"], arg["foreignField"], arg["as"], row_key=keys).drop("_row")


def _fused(first: dict[str, Any], second: dict[str, Any] | None) -> dict[str, Any] | None:
    """The ``$unwind`` spec of a plain ``$lookup`` that it follows, if one join does both."""
    arg, unwound = first.get("$lookup"), (second or {}).get("$unwind")
    if arg is None or unwound is None or "localField" not in arg or arg.get("let"):
        return None
    spec = {"path": unwound} if isinstance(unwound, str) else unwound
    return spec if spec["path"] == "$" + arg["as"] and not spec.get("includeArrayIndex") else None


def apply_stages(
    df: DataFrame, stages: list[dict[str, Any]], tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Run document stages in order over ``df``; ``tables`` are the named
    collections other stages may read. ``$merge`` and ``$out`` give the new version
    of their target, ``$facet`` rows of (facet, document); ``$documents`` replaces
    ``df``. A ``$lookup`` with its ``$unwind`` is one join; arrays of matches and of pushed
    values are built only where they come out (see ``stage_plan``), then whole: one row per
    document and group."""
    from tablewright.functions import formatters
    from tablewright.operators import aggregates, buckets, relate, windows

    tables = tables or {}
    stages = rewrite(stages)
    skip = False
    for at, stage in enumerate(stages):
        if skip:
            skip = False
            continue
        op, arg = next(iter(stage.items()))
        spec = _fused(stage, stages[at + 1] if at + 1 < len(stages) else None)
        keep = bool(spec and spec.get("preserveNullAndEmptyArrays"))
        if spec and not (relate.is_array(df, arg["localField"]) and (keep or relate.is_array(tables[arg["from"]], arg["foreignField"]))):
            foreign = apply_stages(tables[arg["from"]], arg.get("pipeline") or [], tables)
            df = relate.lookup_rows(df, foreign, arg["localField"], arg["foreignField"], arg["as"], keep)
            skip = True
        elif op in _SIMPLE:
            df = _SIMPLE[op](df, arg)
        elif op == "$unwind":
            spec = {"path": arg} if isinstance(arg, str) else arg
            df = unwind(
                df, spec["path"], spec.get("includeArrayIndex"),
                spec.get("preserveNullAndEmptyArrays", False),
            )
        elif op == "$group":
            spec = dict(arg)
            df = aggregates.group(df, spec.pop("_id"), spec, None)
        elif op == "_group_unwound":
            spec = dict(arg["spec"])
            df = aggregates.group_unwound(df, spec.pop("_id"), spec, arg["as"])
        elif op == "_lookup_count":
            foreign = apply_stages(tables[arg["from"]], arg.get("pipeline") or [], tables)
            df = relate.lookup_count(df, foreign, arg["localField"], arg["foreignField"], arg["as"])
        elif op == "$lookup":
            df = _lookup(df, arg, tables)
        elif op == "$graphLookup":
            df = _graph_lookup(df, arg, tables)
        elif op == "$facet":
            df = facet_rows(df, arg, tables)
        elif op == "$densify":
            reach = arg["range"]
            df = windows.densify(
                df, arg["field"], reach["step"], arg.get("partitionByFields"), reach.get("bounds", "full"), reach.get("unit")
            )
        elif op == "$fill":
            by = arg.get("partitionByFields")
            if by is None and arg.get("partitionBy") is not None:
                by = [f.lstrip("$") for f in (arg["partitionBy"].values() if isinstance(arg["partitionBy"], dict) else [arg["partitionBy"]])]
            if any(way < 0 for way in arg.get("sortBy", {}).values()):
                raise ValueError("$fill sorts ascending")
            df = windows.fill(df, arg["output"], by, list(arg.get("sortBy", {})))
        elif op == "$geoNear":
            key = arg["key"]  # a struct of lon and lat, or of two coordinates by name
            fields = df.schema[key].dataType.names
            place = df.withColumns({"_lon": F.col(f"{key}.{fields[0]}"), "_lat": F.col(f"{key}.{fields[1]}")})
            near = arg["near"]["coordinates"] if isinstance(arg["near"], dict) else arg["near"]
            found = formatters.geo_near(
                place, "_lon", "_lat", tuple(near), arg["distanceField"], arg.get("maxDistance"), arg.get("minDistance")
            )
            df = match(found, arg.get("query") or {}).orderBy(arg["distanceField"]).drop("_lon", "_lat")
        elif op == "$merge":
            df = _merge(df, arg, tables)
        elif op == "$out":
            pass  # the rows are the target's new version
        elif op == "$documents":
            df = df.sparkSession.createDataFrame(arg)
        elif op == "$unionWith":
            spec = {"coll": arg} if isinstance(arg, str) else arg
            df = union_with(df, apply_stages(tables[spec["coll"]], spec.get("pipeline", []), tables))
        elif op == "$bucket":
            df = buckets.bucket(
                df, arg["groupBy"], arg["boundaries"], arg.get("default"), arg.get("output")
            )
        elif op == "$bucketAuto":
            df = buckets.bucket_auto(df, arg["groupBy"], arg["buckets"], arg.get("output"))
        elif op == "$setWindowFields":
            df = windows.set_window_fields(
                df, arg.get("partitionBy"), arg.get("sortBy", {}), arg["output"]
            )
        elif op == "$sample":
            df = sample(df, arg["size"], df.columns)
        else:
            raise ValueError(f"unknown stage {op}")
    return df
