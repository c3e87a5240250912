"""Files, documents, JDBC tables and messages as DataFrames."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.sources import spans


def preview(spark: SparkSession, path: str, limit: int = 1000) -> DataFrame | None:
    """First rows of a file, read by its extension; None for an unknown one."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    elif kind in ("json", "jsonl", "ndjson"):
        df = spark.read.json(path, multiLine=kind == "json")
    else:
        return None
    return df.limit(limit)


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Column names of a title row: BOM off, trimmed, blanks become ``column_n``."""
    out = []
    for i, cell in enumerate(cells, 1):
        name = (cell or "").lstrip("﻿").strip()
        out.append(name or f"column_{i}")
    return out


# Encodings Spark reads without further settings.
PLAIN_ENCODINGS = {"ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "UTF-8"}


def allow_encoding(spark: SparkSession, encoding: str) -> None:
    """Other encodings (GBK, Shift_JIS, ...) need the session to admit the JVM's."""
    if encoding.upper() not in PLAIN_ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, trim: bool = False,
    empty_as_null: bool = False, encoding: str = "UTF-8", title_row: int = 1,
    first_row: int | None = None, last_row: int | None = None, multi_line: bool = False,
) -> DataFrame:
    """A delimited text table; every column is text, so nothing is guessed.

    ``title_row``, ``first_row`` and ``last_row`` are 1-based numbers of records; a quoted
    field may hold line breaks. With them, or with ``multi_line``, the records are found in
    all splits of a file at once (see ``spans``); lines end in ``\\n`` or ``\\r\\n`` there.
    """
    if len(sep.encode()) != 1:
        raise ValueError("the delimiter must be one byte")
    allow_encoding(spark, encoding)
    ranged = title_row != 1 or first_row is not None or last_row is not None
    if not ranged and not multi_line:
        base = dict(sep=sep, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE")
        names = spark.read.csv(path, header=False, **base).take(1)
        if not names:
            return spark.createDataFrame([], T.StructType([]))
        cells = list(names[0])
        names = header_names(cells) if header else [f"column_{i + 1}" for i in range(len(cells))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).csv(
            path, header=header, enforceSchema=True, nullValue="\u0000", emptyValue="", **base
        )
    else:
        start = first_row if first_row is not None else (title_row + 1 if header else title_row)
        if last_row is not None and last_row < start:
            raise ValueError("the last row comes before the first row")
        rows = delimited_records(spark, path, sep, encoding)
        titles = rows.where(F.col("record_no") == title_row).take(1)
        if not titles and not ranged:
            return spark.createDataFrame([], T.StructType([]))
        if not titles:
            raise ValueError(f"no title row {title_row}")
        cells = next(csv.reader(io.StringIO(titles[0]["record"].lstrip("\ufeff"), newline=""), delimiter=sep), [""])
        names = header_names(cells) if header else [f"column_{i + 1}" for i in range(len(cells))]
        wanted = F.col("record_no") >= start
        if last_row is not None:
            wanted = wanted & (F.col("record_no") <= last_row)
        schema = ", ".join(f"_{i} string" for i in range(len(names)))
        options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "lineSep": "\u0001"}
        parsed = rows.where(wanted).select(F.from_csv("record", schema, options).alias("r"))
        df = parsed.select(*[F.col(f"r._{i}").alias(n) for i, n in enumerate(names)])
    if trim:
        df = df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if empty_as_null:
        df = df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def delimited_records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(record_no, record): the records of delimited text, numbered from 1; blank ones count,
    but have no row."""
    lines = spans.pieces(spark, path, "\n")
    if encoding.upper() not in ("UTF-8", "US-ASCII"):
        if encoding.upper().startswith(("UTF-16", "UTF-32")):
            raise ValueError("row ranges need an encoding with one-byte line breaks")
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    found = spans.records(lines, spans.quoted_fields(sep), "\n")
    return found.select("record_no", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")


def read_json_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array or object: all objects give the union of their keys, all arrays
    give ``column_1`` to the widest; a mix is refused. Values are read as text."""
    values = json_items(spark, path, multi_line)
    kinds = values.agg(
        F.count_if(F.col("kind") == "object").alias("objects"),
        F.count_if(F.col("kind") == "array").alias("arrays"), F.count("*").alias("n"),
        F.max("width").alias("width"),
    ).first()
    if kinds["n"] == 0:
        return spark.createDataFrame([], T.StructType([]))
    if kinds["arrays"] == kinds["n"]:
        cells = F.from_json("item", "array<string>")
        return values.select(*[
            F.get(cells, F.lit(i)).alias(f"column_{i + 1}") for i in range(kinds["width"])
        ])
    if kinds["objects"] != kinds["n"]:
        raise ValueError("JSON rows must be all objects or all arrays")
    names = union_keys(values.select("item", "at"), "item", F.col("at"))
    fields = F.from_json("item", "map<string,string>")
    return values.select(*[F.try_element_at(fields, F.lit(n)).alias(n) for n in names])


def json_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``(item, kind, width, at)`` of each top-level row, from JSON documents or lines;
    ``at`` rises in the order of reading.

    A document that is one array is read by all its splits at once (see ``spans``); its
    elements are the rows. Any other document is one row."""
    if multi_line:
        blank = F.lit(" \t\r\n\ufeff")
        found = spans.records(spans.pieces(spark, path, ","), spans.json_pieces, ",", {"[": 1})
        # Only an array's last element is open; its brackets are around the first and the last.
        text = found.withColumn("item", F.btrim("record", blank)).withColumns({
            "item": F.when(F.col("first") & F.col("item").startswith("["), F.expr("substring(item, 2)")).otherwise(F.col("item")),
        }).withColumn("item", F.when(F.col("open"), F.expr("left(item, length(item) - 1)")).otherwise(F.col("item")))
        items = text.select(F.btrim("item", blank).alias("item"), F.col("record_no").alias("at")).where("item <> ''")
    else:
        items = spark.read.text(path).select(F.trim("value").alias("item"), F.monotonically_increasing_id().alias("at")).where("item <> ''")
    first = F.left(F.ltrim("item"), F.lit(1))
    kind = F.when(first == "{", "object").when(first == "[", "array").otherwise("scalar")
    return items.select("item", kind.alias("kind"), F.json_array_length("item").alias("width"), "at")


def union_keys(df: DataFrame, column: str, at: Column | None = None) -> list[str]:
    """All keys of JSON objects, in the order a reader would first meet them."""
    keys = df.select(
        (F.monotonically_increasing_id() if at is None else at).alias("_row"),
        F.posexplode(F.json_object_keys(column)).alias("_pos", "key"),
    )
    seen = keys.groupBy("key").agg(F.min(F.struct("_row", "_pos")).alias("_first"))
    return [r["key"] for r in seen.orderBy("_first").collect()]  # one row per field name


def read_documents(df: DataFrame, column: str) -> DataFrame:
    """JSON documents as columns: union of keys, types from one aggregation over
    all documents."""
    found = df.agg(F.expr(f"schema_of_variant_agg(try_parse_json(`{column}`))").alias("s")).first()["s"]
    ddl = re.sub(r"^OBJECT<", "STRUCT<", found).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return df.select(F.from_json(F.col(column), ddl).alias("_d")).select("_d.*")


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None,
    bounds: tuple[str, str] | None = None, partitions: int = 32, fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table; with a partition column the read is split over tasks."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, fetchsize=str(fetch_size), **(properties or {})
    )
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=str(partitions),
        )
    return reader.load()


def read_messages(
    spark: SparkSession, servers: str, topic: str, start: str = "earliest", end: str = "latest"
) -> DataFrame:
    """Messages of a Kafka topic as a batch; nothing is committed."""
    return (
        spark.read.format("kafka")
        .options(**{
            "kafka.bootstrap.servers": servers, "subscribe": topic,
            "startingOffsets": start, "endingOffsets": end, "includeHeaders": "true",
        })
        .load()
    )


def peek_messages(
    df: DataFrame, count: int, partition: int | None = None, offset: int | None = None
) -> DataFrame:
    """At most ``count`` messages of a message frame, from ``offset`` of one partition or
    from the start of all."""
    if partition is not None:
        df = df.where(F.col("partition") == partition)
    if offset is not None:
        df = df.where(F.col("offset") >= offset)
    return df.orderBy("partition", "offset").limit(count)


def glob_pattern(glob: str) -> str:
    """A key glob as an anchored regex: ``*``, ``?``, classes ``[a-c]`` and ``[^x]``, and a
    backslash before a character that stands for itself."""
    body, at = [], 0
    while at < len(glob):
        ch = glob[at]
        close = glob.find("]", at + 2) if ch == "[" else -1
        if ch == "\\" and at + 1 < len(glob):
            body.append(re.escape(glob[at + 1]))
            at += 2
        elif close > 0:
            inner = glob[at + 1 : close]
            negated = inner.startswith("^")
            inner = re.sub(r"([\[\]&\\^])", r"\\\1", inner[negated:])
            body.append(f"[{'^' if negated else ''}{inner}]")
            at = close + 1
        else:
            body.append({"*": ".*", "?": "."}.get(ch, re.escape(ch)))
            at += 1
    return f"^{''.join(body)}$"


def glob_match(column: Column, glob: str) -> Column:
    return column.rlike("(?is)" + glob_pattern(glob))
