"""Field tree of JSON documents."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.storage import materialize


def flatten_fields(df: DataFrame, column: str, max_depth: int | None = None) -> DataFrame:
    """``(path, kind, documents)``: dotted paths of all fields, kind scalar, object or
    array, and the number of documents that have them. Elements of an array
    share the array's path. All levels are read unless ``max_depth`` is given. Each level explodes only nested values."""
    rows = df.select(
        F.xxhash64(F.col(column), F.monotonically_increasing_id()).alias("_doc"),
        F.lit("").alias("path"), F.try_parse_json(column).alias("v"),
    ).where("v IS NOT NULL")
    rows = materialize(rows, "documents")
    spark, found = df.sparkSession, None
    for _ in itertools.count() if max_depth is None else range(max_depth):
        children = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            "_doc",
            F.when(F.col("key").isNull(), F.col("path"))
            .when(F.col("path") == "", F.col("key"))
            .otherwise(F.concat_ws(".", "path", "key")).alias("path"),
            F.col("key").isNotNull().alias("named"), F.col("value").alias("v"),
        )
        shape = F.schema_of_variant("v")
        kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("scalar")
        level = materialize(children.withColumn("kind", kind), "fields")
        named = level.where("named").select("_doc", "path", "kind").distinct()
        found = named if found is None else found.unionAll(named)
        rows = level.where("kind <> 'scalar'").select("_doc", "path", "v")
        if rows.isEmpty():
            break
    first = F.when(F.col("path") == "_id", 0).otherwise(1)
    counted = found.distinct().groupBy("path", "kind").agg(F.count("*").alias("documents"))
    return counted.orderBy(first, "path")
