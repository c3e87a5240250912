"""Type inference over all rows, and typed import of text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.temporal import DATE, DATETIME, ZONED, local_time, normalize

SPARK_TYPE = {
    "boolean": "boolean", "integer": "bigint", "decimal": "double", "date": "date",
    "timestamp": "timestamp_ntz", "json": "string", "text": "string",
}


def cell_type(text: Column) -> Column:
    """Type name of one text cell, NULL for NULL. Digits with a leading zero are
    text; blanks are text."""
    value = F.trim(text)
    dated = local_time(value).isNotNull()
    zero = value.rlike(r"^[+-]*0\d")
    whole = value.rlike(r"^[+-]?\d{1,18}$") | (
        value.rlike(r"^\+?\d{19,20}$|^-\d{19}$") & value.try_cast("decimal(20,0)").between(
            F.lit("-9223372036854775808").cast("decimal(20,0)"),
            F.lit("18446744073709551615").cast("decimal(20,0)"),
        )
    )
    number = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & value.rlike("[.eE]")
    finite = F.abs(value.try_cast("double")) < float("inf")
    return (
        F.when(value.isNull(), None)
        .when((value.rlike(ZONED) | value.rlike(DATETIME)) & dated, "timestamp")
        .when(value.rlike(DATE) & dated, "date")
        .when(~zero & whole, "integer")
        .when(~zero & number & finite, "decimal")
        .otherwise("text")
    )


def value_type(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return cell_type(c)
    fixed = (
        "boolean" if isinstance(kind, T.BooleanType)
        else "integer" if isinstance(kind, T.IntegralType)
        else "decimal" if isinstance(kind, T.NumericType)
        else "date" if isinstance(kind, T.DateType)
        else "timestamp" if isinstance(kind, (T.TimestampType, T.TimestampNTZType))
        else "json"
    )
    return F.when(c.isNotNull(), fixed)


def fold_types(seen: Column) -> Column:
    """Common type of a set of cell types: integer with decimal is decimal, date
    with timestamp is timestamp, any other mix is text, nothing is text."""
    def only(*names: str) -> Column:
        return F.size(F.array_except(seen, F.array(*[F.lit(n) for n in names]))) == 0

    return (
        F.when(F.size(seen) == 0, "text")
        .when(F.size(seen) == 1, seen[0])
        .when(only("integer", "decimal"), "decimal")
        .when(only("date", "timestamp"), "timestamp")
        .otherwise("text")
    )


PLAIN_DIGITS = 15  # significant digits that a double keeps
MOST_DIGITS = 38


def _measures(c: Column, kind: Column) -> dict[str, Column]:
    """What the numbers of a text column need: whether one is beyond 64 signed bits or has an
    exponent, and the most characters before and after the point."""
    value, number = F.trim(c), kind.isin("integer", "decimal")
    dot = F.instr(value, ".")
    whole = F.when(dot > 0, dot - 1).otherwise(F.length(value))
    return {
        "big": F.max(F.when(number & (dot == 0) & (F.length(value) > 18), value.try_cast("bigint").isNull())),
        "exponent": F.max(F.when(number, F.contains(F.lower(value), F.lit("e")))),
        "whole": F.max(F.when(number, whole)), "part": F.max(F.when(number & (dot > 0), F.length(value) - dot)),
        "digits": F.max(F.when(number, F.length(value) - (dot > 0).cast("int"))),
    }


def _exact_type(kind: Column, m: Column) -> Column:
    """The Spark type of a column: exact where a bigint or a double would not hold its numbers."""
    to_spark = F.create_map(*[x for k, v in SPARK_TYPE.items() for x in (F.lit(k), F.lit(v))])
    part = F.coalesce(m["part"], F.lit(0))
    total = m["whole"] + part
    exact = F.concat(F.lit("decimal("), total.cast("string"), F.lit(","), part.cast("string"), F.lit(")"))
    lossy = ~F.coalesce(m["exponent"], F.lit(False)) & (m["digits"] > PLAIN_DIGITS) & (total <= MOST_DIGITS)
    return F.when((kind == "integer") & m["big"], "decimal(20,0)").when((kind == "decimal") & lossy, exact).otherwise(to_spark[kind])


def import_infer(
    df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None
) -> DataFrame:
    """``(column, position, type, data_type)`` per column from one aggregation over all
    rows (or a sample). A column's state is a set of at most seven type names and the
    digits of its numbers. Whole numbers beyond 64 signed bits become decimal(20,0), and
    decimals of more digits than a double keeps the decimal that holds them all."""
    names = columns or df.columns
    rows = df if sample_rows is None else df.limit(sample_rows)
    states, none = [], F.lit(None)
    for i, c in enumerate(names):
        kind = value_type(df, c)
        states.append(F.collect_set(kind).alias(f"t{i}"))
        if isinstance(df.schema[c].dataType, T.StringType):
            measures = _measures(F.col(c), kind)
        else:
            measures = {"big": none.cast("boolean"), "exponent": none.cast("boolean"), **{k: none.cast("int") for k in ("whole", "part", "digits")}}
        states.append(F.struct(*[m.alias(k) for k, m in measures.items()]).alias(f"m{i}"))
    listed = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), fold_types(F.col(f"t{i}")).alias("type"), F.col(f"m{i}").alias("m"))
        for i, c in enumerate(names)
    ])
    found = rows.agg(*states).select(F.inline(listed))
    return found.select("column", "position", "type", _exact_type(F.col("type"), F.col("m")).alias("data_type"))


class ImportMappingError(ValueError):
    pass


def check_mapping(df: DataFrame, mapping: list[tuple[str, str, str]]) -> None:
    targets = [target.lower() for _, target, _ in mapping]
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        raise ImportMappingError(f"duplicate target column: {', '.join(twice)}")
    missing = [s for s, _, _ in mapping if s not in df.columns]
    if missing:
        raise ImportMappingError(f"missing source column: {', '.join(missing)}")


_KINDS = {"date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def typed(df: DataFrame, source: str, data_type: str, pattern: str | None = None) -> Column:
    c = F.col(source)
    if isinstance(df.schema[source].dataType, T.StringType):
        c = F.trim(c) if data_type != "string" else c
        if data_type in _KINDS:
            c = normalize(c, _KINDS[data_type], pattern)
        elif data_type != "string":
            c = F.when(c != "", c)
    return c.try_cast(data_type)


def project_cast_map(
    df: DataFrame, mapping: list[tuple[str, str, str]], pattern: str | None = None
) -> DataFrame:
    """Select ``(source, target, type)`` mappings; a cell that does not fit is NULL."""
    check_mapping(df, mapping)
    return df.select(*[typed(df, s, kind, pattern).alias(target) for s, target, kind in mapping])


def import_table(
    df: DataFrame, mapping: list[tuple[str, str, str]] | None = None, pattern: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Typed rows and rejected rows. Without a mapping the types are inferred over
    all rows. A rejected row names its bad cells; nothing is lost silently."""
    if mapping is None:
        found = import_infer(df).orderBy("position").collect()  # one row per column
        mapping = [(r["column"], r["column"], r["data_type"]) for r in found]
    check_mapping(df, mapping)
    bad = [
        F.when(F.col(s).isNotNull() & (F.trim(F.col(s).cast("string")) != "") & typed(df, s, kind, pattern).isNull(), F.lit(target))
        for s, target, kind in mapping
    ]
    marked = df.withColumn("_bad", F.concat_ws(",", *bad))
    good = project_cast_map(marked.where("_bad = ''"), mapping, pattern)
    return good, marked.where("_bad <> ''").withColumnRenamed("_bad", "bad_columns")


def import_preview(df: DataFrame, rows: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first rows and the total count."""
    return df.limit(rows), df.agg(F.count("*").alias("total"))


def union_columns(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
