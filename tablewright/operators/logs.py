"""Query logs: kinds of activity, filters and stable paging."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.formatters import like_escape

# Leading keywords of schema and data changes.
SCHEMA_WORDS = ("CREATE", "ALTER", "DROP", "RENAME")
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE", "TRUNCATE")


def activity_classify(sql: Column) -> Column:
    """schema_change if any statement changes a schema, else data_change if any
    writes, else query. Comments are ignored."""
    bare = F.regexp_replace(sql, r"(?s)/\*.*?\*/", " ")
    bare = F.regexp_replace(bare, r"(?m)(--|#).*$", " ")

    def any_of(words: tuple[str, ...]) -> Column:
        return bare.rlike(r"(?i)(^|;)\s*(" + "|".join(words) + r")\b")

    return F.when(any_of(SCHEMA_WORDS), "schema_change").when(any_of(WRITE_WORDS), "data_change").otherwise("query")


TEXT_FIELDS = ("sql_text", "database", "connection_name", "error", "target")


def log_filter(
    df: DataFrame, scopes: list[tuple[str, str | None]] | None = None, kinds: list[str] | None = None,
    success: bool | None = None, start: Any = None, end: Any = None, text: str | None = None,
) -> DataFrame:
    """Scope (connection, optionally one of its databases), kind, outcome, time range
    and a text in any of the five text fields."""
    out = df
    if scopes:
        each = [
            (F.col("connection_id") == c) & (F.lit(True) if d is None else F.col("database") == d)
            for c, d in scopes
        ]
        out = out.where(reduce(lambda a, b: a | b, each))
    if kinds:
        out = out.where(F.col("activity_kind").isin(kinds))
    if success is not None:
        out = out.where(F.col("success") == success)
    if start is not None:
        out = out.where(F.col("executed_at") >= _at(start))
    if end is not None:
        out = out.where(F.col("executed_at") <= _at(end))
    if text and text.strip():
        pattern = F.lit(f"%{like_escape(text.strip().lower(), '~')}%")
        each = [F.like(F.lower(F.col(f)), pattern, F.lit("~")) for f in TEXT_FIELDS if f in df.columns]
        out = out.where(reduce(lambda a, b: a | b, [F.coalesce(e, F.lit(False)) for e in each]))
    return out


def _at(value: Any) -> Column:
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value).cast("timestamp_ntz")


def log_search_page(
    df: DataFrame, limit: int = 100, cursor: tuple[Any, Any] | None = None,
    at: str = "executed_at", key: str = "id",
) -> DataFrame:
    """The next newest-first page with ``total`` (counted before the cursor) and
    ``has_more``. Equal times are told apart by id, so no row is skipped."""
    size = min(max(limit, 1), 200)
    rows = df
    if cursor is not None:
        t, i = _at(cursor[0]), F.lit(cursor[1])
        c = F.col(at)
        rows = df.where((c <= t) & ((c < t) | ((c == t) & (F.col(key) < i))))
    page = rows.orderBy(F.desc(at), F.desc(key)).limit(size + 1)
    # The page has at most 201 rows.
    found = page.agg(
        F.slice(F.sort_array(F.collect_list(F.struct(at, key, F.struct(*df.columns).alias("r"))), asc=False), F.lit(1), F.lit(size)).alias("p"),
        (F.count("*") > size).alias("has_more"),
    )
    rows = found.select(F.inline("p"), "has_more").select("r.*", "has_more")
    return rows.withColumn("total", df.agg(F.count("*")).scalar()).select(*df.columns, "total", "has_more")
