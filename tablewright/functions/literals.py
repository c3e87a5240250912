"""SQL text for values: literals, predicates and IN lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.segments import with_running_index


def sql_literal(value: Column, kind: T.DataType) -> Column:
    """The SQL literal for ``value``: NULL, bare numbers and booleans, hex
    blobs, quoted text with quotes doubled, JSON text for nested values."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(kind, T.NumericType):
        text = value.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = quoted(F.to_json(value))
    else:
        text = quoted(value.cast("string"))
    return F.coalesce(text, F.lit("NULL"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal_of(df: DataFrame, name: str, prefix: str = "") -> Column:
    return sql_literal(F.col(prefix + name), df.schema[prefix + name].dataType)


def key_predicate(df: DataFrame, keys: list[str], prefix: str = "") -> Column:
    """``"k1" = v1 AND "k2" = v2``; a NULL key is written ``IS NULL``."""
    parts = [
        F.when(F.col(prefix + k).isNull(), F.lit(f"{ident(k)} IS NULL")).otherwise(
            F.concat(F.lit(f"{ident(k)} = "), literal_of(df, k, prefix))
        )
        for k in keys
    ]
    return F.concat_ws(" AND ", *parts)


def in_lists(df: DataFrame, column: str, size: int = 1000) -> DataFrame:
    """Distinct values of ``column`` as ``(v1, v2, ...)`` lists of at most
    ``size`` values, one row per list."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = with_running_index(values, [column], "_at")
    lists = numbered.groupBy(F.floor(F.col("_at") / size).cast("bigint").alias("list_no")).agg(
        F.sort_array(F.collect_list(F.struct("_at", literal_of(df, column).alias("v")))).alias("v"),
    )
    joined = F.concat_ws(", ", F.transform("v", lambda x: x["v"]))
    return lists.select("list_no", F.concat(F.lit("("), joined, F.lit(")")).alias("in_list"))
