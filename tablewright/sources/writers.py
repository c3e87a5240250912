"""Exports as text lines and files, table copies and snapshots.

Each text format is a function to a one-column frame of lines, so the same
expressions serve a file sink, a preview and a check. Rows are rendered where
they lie; only numbered batches need an order.
"""

from __future__ import annotations

import fnmatch
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.literals import ident, literal_of
from tablewright.functions.temporal import format_text, spark_pattern
from tablewright.operators.paging import scan_page
from tablewright.operators.segments import with_running_index
from tablewright.storage import work_path

# Fixed value: rows per exported insert statement.
EXPORT_BATCH = 100


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as export text; nested values as JSON, bytes as ``\\x`` hex."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    return c.cast("string")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, null_text: str = "", name: str = "line") -> DataFrame:
    """Every value quoted, quotes doubled; NULL is ``null_text`` bare (use ``""`` for
    the page export form)."""
    cells = [F.coalesce(_quoted(cell_text(df, c)), F.lit(null_text)) for c in df.columns]
    return df.select(F.concat_ws(",", *cells).alias(name))


def tsv_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Quoted only where a value holds a tab, a line break or a quote."""
    def cell(c: str) -> Column:
        text = cell_text(df, c)
        return F.coalesce(F.when(text.rlike('[\t\r\n"]'), _quoted(text)).otherwise(text), F.lit(""))

    return df.select(F.concat_ws("\t", *[cell(c) for c in df.columns]).alias(name))


def json_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """One object per row with all columns in order, NULL included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def markdown_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Table rows: pipes escaped, line breaks as ``<br>``, NULL written out."""
    def cell(c: str) -> Column:
        text = F.replace(cell_text(df, c), F.lit("|"), F.lit("\\|"))
        return F.coalesce(F.regexp_replace(text, "\r\n|\r|\n", "<br>"), F.lit("NULL"))

    row = F.concat_ws(" | ", *[cell(c) for c in df.columns])
    return df.select(F.concat(F.lit("| "), row, F.lit(" |")).alias(name))


def markdown_header(columns: list[str]) -> list[str]:
    return [
        "| " + " | ".join(c.replace("|", "\\|") for c in columns) + " |",
        "| " + " | ".join("---" for _ in columns) + " |",
    ]


def csv_header(columns: list[str], sep: str = ",") -> str:
    return sep.join(columns)


def insert_lines(
    df: DataFrame, table: str, order: list[str], batch: int = EXPORT_BATCH
) -> DataFrame:
    """``INSERT ... VALUES`` statements of ``batch`` rows in ``order``."""
    names = ", ".join(ident(c) for c in df.columns)
    values = F.concat(F.lit("("), F.concat_ws(", ", *[literal_of(df, c) for c in df.columns]), F.lit(")"))
    numbered = with_running_index(df.select(*order, values.alias("_v")), order, "_at")
    grouped = numbered.groupBy(F.floor(F.col("_at") / batch).cast("bigint").alias("batch_no")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("v")
    )
    body = F.concat_ws(",\n", F.transform("v", lambda x: x["_v"]))
    head = F.lit(f"INSERT INTO {ident(table)} ({names}) VALUES\n")
    return grouped.select("batch_no", F.concat(head, body, F.lit(";")).alias("statement"))


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None) -> None:
    """Lines as text part files. The header is a partition of its own in front, so
    the parts joined in name order are one valid file."""
    out = lines.select(F.col(lines.columns[-1]).alias("value"))
    if header:
        top = lines.sparkSession.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
        out = top.unionAll(out)
    out.write.text(path)


def write_csv(df: DataFrame, path: str, header: bool = True, null_text: str = "") -> None:
    write_lines(csv_lines(df, null_text), path, [csv_header(df.columns)] if header else None)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    write_lines(tsv_lines(df), path, [csv_header(df.columns, "\t")] if header else None)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def write_markdown(df: DataFrame, path: str) -> None:
    write_lines(markdown_lines(df), path, markdown_header(df.columns))


def write_sql_inserts(df: DataFrame, path: str, table: str, order: list[str]) -> None:
    write_lines(insert_lines(df, table, order), path)


def export_filtered(
    df: DataFrame, columns: list[str], where: Column | str | None = None,
    order_by: list[Any] | None = None, row_limit: int | None = None,
    date_time_format: str | None = None,
) -> DataFrame:
    """The rows of a filtered export; dates and times take the user's pattern. Any
    of the writers above takes the result."""
    if row_limit is not None:
        out = scan_page(df, None, where, order_by, row_limit)
    else:
        out = df if where is None else df.where(where)
        out = out.orderBy(*order_by) if order_by else out
    if not date_time_format or not date_time_format.strip():
        return out.select(*columns)
    shown = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            shown.append(F.date_format(c, spark_pattern(date_time_format)).alias(c))
        elif (df.schema[c].metadata or {}).get("temporal"):
            shown.append(format_text(F.col(c), date_time_format).alias(c))
        else:
            shown.append(F.col(c))
    return out.select(*shown)


# --- copies, versions and snapshots -----------------------------------------

def copy_table(source: DataFrame, path: str, columns: list[str] | None = None, mode: str = "append") -> None:
    (source.select(*columns) if columns else source).write.mode(mode).parquet(path)


def copy_structure(source: DataFrame, path: str) -> None:
    """An empty table with the same columns."""
    source.limit(0).write.parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version beside ``path`` and swap the two folders. The new rows
    may be computed from the old version. A run that stops between the two renames leaves
    no folder at ``path``; ``restore_table`` then puts the new version in place, and so
    does the next run."""
    spark = df.sparkSession
    restore_table(spark, path)
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = jvm.org.apache.hadoop.fs.Path
    if fs.exists(at(old)):
        fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise RuntimeError(f"could not set the old version at {path} aside; the new one is at {fresh}")
    if not fs.rename(at(fresh), at(path)):
        fs.rename(at(old), at(path))  # back to the old version
        raise RuntimeError(f"could not put the new version in place at {path}; it is at {fresh}")


def restore_table(spark: SparkSession, path: str) -> None:
    """Finish a swap that stopped half-way: the new version is whole once the old one is aside."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.old")):
        whole = f"{path}.new" if fs.exists(at(f"{path}.new/_SUCCESS")) else f"{path}.old"
        fs.rename(at(whole), at(path))


def pattern_matches(pattern: str, name: str) -> bool:
    """A pattern of one, two or three parts against as many last parts of ``d.s.t``."""
    parts, have = pattern.lower().split("."), name.lower().split(".")
    if len(parts) > len(have):
        return False
    return all(fnmatch.fnmatchcase(h, p) for p, h in zip(parts, have[-len(parts):]))


def selected_tables(names: list[str], include: list[str], exclude: list[str]) -> list[str]:
    """No include pattern means every table; exclude wins."""
    kept = [n for n in names if not include or any(pattern_matches(p, n) for p in include)]
    return [n for n in kept if not any(pattern_matches(p, n) for p in exclude)]


def snapshot_tables(
    tables: dict[str, DataFrame], root: str, snapshot: str, include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> list[str]:
    """Write the chosen tables below ``root/snapshot=.../``; returns their names."""
    names = selected_tables(list(tables), include or [], exclude or [])
    for n in names:
        tables[n].write.mode("overwrite").parquet(f"{root}/snapshot={snapshot}/{n}")
    return names


def read_snapshot(spark: SparkSession, root: str, snapshot: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={snapshot}/{name}")


def snapshot_prune(runs: DataFrame, keep: int) -> DataFrame:
    """Successful runs beyond the newest ``keep`` of their schedule. The ``keep``-th
    newest start is found per schedule first, so no schedule is sorted whole."""
    good = runs.where("status = 'success'")
    newest = Window.partitionBy("schedule_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    kept = good.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(keep, 0))
    return good.join(kept.select("run_id"), "run_id", "left_anti")


def round_trip(lines: DataFrame, label: str) -> DataFrame:
    """Write lines as text and read them back."""
    path = work_path(lines.sparkSession, label)
    write_lines(lines, path)
    return lines.sparkSession.read.text(path).select(F.col("value").alias("line"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
