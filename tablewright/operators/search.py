"""Finding a term in tables, result cells and key-value entries."""

from __future__ import annotations

import decimal
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.formatters import like_escape
from tablewright.functions.literals import ident, literal_of
from tablewright.sources.readers import glob_match

def column_test(df: DataFrame, name: str, term: str) -> Column | None:
    """Text columns contain the term ignoring case; numbers equal it when it is a
    number; columns of other types are not searched."""
    kind = df.schema[name].dataType
    wanted = term.strip().lower()
    if not wanted or not isinstance(kind, (T.StringType, T.NumericType)):
        return None
    if isinstance(kind, T.NumericType):
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", wanted):
            return None
        number = decimal.Decimal(wanted)
        if isinstance(kind, T.IntegralType):
            whole = int(number)
            fits = number == whole and -(2**63) <= whole < 2**63
            return F.col(name) == F.lit(whole) if fits else None
        return F.col(name) == F.lit(number if isinstance(kind, T.DecimalType) else float(number))
    pattern = f"%{like_escape(wanted, '~')}%"
    return F.like(F.lower(F.col(name)), F.lit(pattern), F.lit("~"))


def matched_columns(tests: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(t, F.lit(c)) for c, t in tests.items()])


def key_text(keys: list[str]) -> Column:
    """A key as text: of one column its value, of several a JSON object with all parts."""
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def search_table(
    df: DataFrame, table: str, keys: list[str], term: str, limit: int | None = None
) -> DataFrame | None:
    """``(table_name, key, matched_columns, row_json)`` of the rows with a hit: one
    pass, one filter, however many columns."""
    tests = {c: t for c in df.columns if (t := column_test(df, c, term)) is not None}
    if not tests:
        return None
    hits = df.where(reduce(lambda a, b: a | b, tests.values()))
    out = hits.select(
        F.lit(table).alias("table_name"),
        key_text(keys).alias("key"),
        matched_columns(tests).alias("matched_columns"),
        F.to_json(F.struct(*[c for c in df.columns if not isinstance(df.schema[c].dataType, T.VariantType)])).alias("row_json"),
    )
    return out if limit is None else out.limit(limit)


def search_database(
    tables: dict[str, tuple[DataFrame, list[str]]], term: str, limit: int | None = None
) -> DataFrame:
    """Hits of a term in all tables; ``limit`` caps each table and is off by default."""
    found = [search_table(df, name, keys, term, limit) for name, (df, keys) in tables.items()]
    parts = [p for p in found if p is not None]
    if not parts:  # a blank term, or no column that could hold it
        spark = next(iter(tables.values()))[0].sparkSession
        return spark.createDataFrame([], "table_name string, key string, matched_columns string, row_json string")
    return reduce(DataFrame.unionAll, parts)


def search_hit_locator(
    df: DataFrame, keys: list[str], term: str, columns: int = 3
) -> DataFrame:
    """A predicate text that finds each hit again: the key columns, or else the
    first matched columns; at most three."""
    tests = {c: t for c in df.columns if (t := column_test(df, c, term)) is not None}
    hits = df.where(reduce(lambda a, b: a | b, tests.values()))

    def equals(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(f"{ident(c)} IS NULL")).otherwise(
            F.concat(F.lit(f"{ident(c)} = "), literal_of(df, c))
        )

    if keys:
        text = F.concat_ws(" AND ", *[equals(k) for k in keys[:columns]])
    else:
        found = F.array_compact(F.array(*[F.when(t, equals(c)) for c, t in tests.items()]))
        text = F.array_join(F.slice(found, F.lit(1), F.lit(columns)), " AND ")
    return hits.select(*df.columns, text.alias("locator"))


def search_cells(df: DataFrame, ids: list[str], term: str, columns: list[str] | None = None) -> DataFrame:
    """Every cell containing the term: ids, ``column``, ``column_index``, ``value``."""
    names = columns or df.columns
    wanted = term.lower()
    cells = [
        F.when(
            F.lower(F.col(c).cast("string")).contains(wanted),
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("column_index"), F.col(c).cast("string").alias("value")),
        )
        for i, c in enumerate(names)
    ]
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(c).cast("string")).contains(wanted) for c in names])
    return df.where(hit).select(*ids, F.inline(F.array_compact(F.array(*cells))))


def search_headers(columns: list[str], term: str) -> list[tuple[int, str]]:
    return [(i, c) for i, c in enumerate(columns) if term.lower() in c.lower()]


def search_match_join(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows with the array ``matched`` of column names whose test holds."""
    named = [F.when(t, F.lit(c)) for c, t in tests.items()]
    hits = df.where(reduce(lambda a, b: a | b, tests.values()))
    return hits.withColumn("matched", F.array_compact(F.array(*named)))


def kv_text(df: DataFrame) -> Column:
    """Text of a key-value entry with columns ``text``, ``items`` and ``fields``."""
    parts = [F.col("text")]
    if "items" in df.columns:
        parts.append(F.array_join("items", " "))
    if "fields" in df.columns:
        pairs = F.transform(F.map_entries("fields"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
        parts.append(F.array_join(pairs, " "))
    return F.coalesce(*parts)


def search_kv(df: DataFrame, term: str, glob: str | None = None) -> DataFrame:
    """Entries whose key or value contains the term; ``glob`` narrows the keys."""
    rows = df if glob is None else df.where(glob_match(F.col("key"), glob))
    wanted = term.lower()
    value = kv_text(df)
    in_key = F.lower("key").contains(wanted)
    in_value = F.coalesce(F.lower(value).contains(wanted), F.lit(False))
    return rows.where(in_key | in_value).select(
        "key", "type", in_key.alias("key_match"), in_value.alias("value_match")
    )
