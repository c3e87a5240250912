"""Fixed and even buckets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import expr
from tablewright.operators.aggregates import group
from tablewright.operators.segments import with_running_total


def bucket_index(value: Column, boundaries: list[Any]) -> Column:
    """Lower boundary of the half-open bucket of ``value``, NULL outside."""
    out = F.when(value.isNull() | (value < boundaries[0]), None)
    for low, high in zip(boundaries, boundaries[1:]):
        out = out.when(value < high, F.lit(low))
    return out


def bucket(
    df: DataFrame, by: Any, boundaries: list[Any], default: Any = None,
    output: dict[str, Any] | None = None,
) -> DataFrame:
    """Buckets ``[b_i, b_i+1)``; rows outside go to ``default``."""
    low = bucket_index(expr(by), boundaries)
    if default is not None:
        low = F.coalesce(low.cast("string"), F.lit(str(default)))
    else:
        low = F.coalesce(low, F.raise_error(F.lit("value outside the boundaries and no default")).cast("double"))
    return group(df.withColumn("_bucket", low), "$_bucket", output or {"count": {"$sum": 1}})


def bucket_auto(
    df: DataFrame, by: Any, buckets: int, output: dict[str, Any] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``buckets`` ranges of about equal row counts; equal values stay together.

    Values are counted first, so only distinct values are ordered, and their
    running totals come from a range partitioning, not from one task. A bucket's
    ``max`` is the next bucket's ``min``; the last one's is its own maximum.
    """
    rows = df.withColumn("_value", expr(by))
    counts = rows.where("_value IS NOT NULL").groupBy("_value").agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("_value").alias("n")).first()["n"]
    placed = with_running_total(counts, ["_value"], "_n", "_before", partitions).withColumn(
        "bucket_no", F.floor(F.col("_before") * buckets / F.lit(max(total, 1))).cast("int")
    )
    edges = placed.groupBy("bucket_no").agg(
        F.min("_value").alias("min"), F.max("_value").alias("_top"), F.sum("_n").alias("count")
    )
    listed = edges.orderBy("bucket_no").collect()  # at most ``buckets`` rows
    ends = [r["min"] for r in listed[1:]] + [r["_top"] for r in listed[-1:]]
    spark = df.sparkSession
    kind = edges.schema["min"].dataType.simpleString()
    frame = spark.createDataFrame(
        [(r["bucket_no"], r["min"], e, r["count"]) for r, e in zip(listed, ends)],
        f"bucket_no int, min {kind}, max {kind}, count bigint",
    )
    if output is None:
        return frame
    # The edges are known, so a row finds its bucket without a join.
    number = F.lit(None).cast("int")
    for r in listed:
        number = F.when(F.col("_value") >= F.lit(r["min"]), F.lit(r["bucket_no"])).otherwise(number)
    mapped = rows.where("_value IS NOT NULL").withColumn("bucket_no", number)
    grouped = group(mapped, "$bucket_no", output).withColumnRenamed("_id", "bucket_no")
    return frame.drop("count").join(grouped, "bucket_no")
