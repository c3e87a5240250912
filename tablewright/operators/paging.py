"""Pages, sorts and nearest neighbours."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.aggregates import top_per_group
from tablewright.operators.segments import with_running_index
from tablewright.storage import work_path


# Rows one task may hold to serve an OFFSET page; deeper pages are numbered.
DEEP_PAGE = 100_000


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _page(ordered: DataFrame, order: list[Any], limit: int, offset: int) -> DataFrame:
    # All other columns break ties, so every form of a page holds the same rows.
    named = {o for o in order if isinstance(o, str)}
    order = [*order, *[f.name for f in ordered.schema if f.name not in named and _sortable(f.dataType)]]
    if not offset:
        return ordered.orderBy(*order).limit(limit)
    if offset + limit <= DEEP_PAGE:
        return ordered.orderBy(*order).offset(offset).limit(limit)
    numbered = with_running_index(ordered, order, "_at")
    return numbered.where(F.col("_at").between(offset, offset + limit - 1)).orderBy("_at").drop("_at")


INDEX_ROWS = 100_000  # of a range


class OrderIndex:
    """A table written in ``order``, cut into ranges with their row counts.

    Built once, it serves any number of pages: a page, however deep, reads the one or two
    ranges that it lies in. Ties are broken by all other columns, as in ``page_offset``;
    the counts, one per range, are all that the driver holds."""

    def __init__(self, df: DataFrame, order: list[Any], rows: int = INDEX_ROWS, path: str | None = None):
        spark = df.sparkSession
        named = {o for o in order if isinstance(o, str)}
        self.order = [*order, *[f.name for f in df.schema if f.name not in named and _sortable(f.dataType)]]
        self.path = path or work_path(spark, "order-index")
        ranges = max(1, -(-df.count() // rows))
        ranged = df.repartitionByRange(ranges, *self.order).withColumn("_range", F.spark_partition_id())
        ranged.sortWithinPartitions(*self.order).write.partitionBy("_range").parquet(self.path)
        self.spark, self.schema = spark, df.schema
        self.counts = [tuple(r) for r in spark.read.parquet(self.path).groupBy("_range").count().orderBy("_range").collect()]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows from ``offset`` on."""
        before, first, wanted = 0, 0, []
        for number, n in self.counts:
            if before < offset + limit and before + n > offset:
                first = first if wanted else before
                wanted.append(number)
            before += n
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/_range={n}" for n in wanted])
        return rows.orderBy(*self.order).offset(max(0, offset - first)).limit(limit)


def scan_page(
    df: DataFrame, columns: list[str] | None = None, where: Column | str | None = None,
    order_by: list[Any] | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """A page of a table; filter and columns reach the scan."""
    out = df if where is None else df.where(where)
    if order_by:
        out = _page(out, order_by, limit, offset)
    else:
        out = (out.offset(offset) if offset else out).limit(limit)
    return out.select(*columns) if columns else out


def page_offset(
    df: DataFrame, limit: int, offset: int = 0, order_by: list[Any] | None = None,
    own_limit: int | None = None,
) -> DataFrame:
    """LIMIT/OFFSET over any result. Without an order all columns order the rows,
    so pages are stable; the query's own smaller limit wins."""
    size = max(1, limit)
    if own_limit is not None:
        size = max(0, min(size, own_limit - offset))
    return _page(df, order_by or df.columns, size, offset)


def after_key(keys: list[str], values: list[Any], descending: bool = False) -> Column:
    """``k1 > v1 OR (k1 = v1 AND k2 > v2) ...``; the leading key also gets a plain
    bound so the scan can skip row groups."""
    out = F.lit(False)
    equal = F.lit(True)
    for k, v in zip(keys, values):
        c = F.col(k)
        out = out | (equal & ((c < F.lit(v)) if descending else (c > F.lit(v))))
        equal = equal & (c == F.lit(v))
    first = F.col(keys[0])
    bound = first <= F.lit(values[0]) if descending else first >= F.lit(values[0])
    return bound & out


def page_keyset(
    df: DataFrame, keys: list[str], last: list[Any] | None = None, limit: int = 1000,
    tie: list[str] | None = None,
) -> DataFrame:
    """The next page after key ``last`` in key order: cost does not grow with depth.
    ``tie`` orders rows that share a key."""
    rows = df if last is None else df.where(after_key(keys, last))
    return rows.orderBy(*keys, *(tie or [])).limit(limit)


def row_number_page(
    df: DataFrame, order: list[str], first: int, last: int, partitions: int | None = None
) -> DataFrame:
    """Rows ``first`` to ``last`` (1-based) in ``order``, for pages too deep for OFFSET."""
    numbered = with_running_index(df, order, "_at", partitions)
    return numbered.where(F.col("_at").between(first - 1, last - 1)).withColumn(
        "row_no", F.col("_at") + 1
    ).drop("_at")


def sort_query(df: DataFrame, column: str | int, ascending: bool = True) -> DataFrame:
    name = df.columns[column - 1] if isinstance(column, int) else column
    return df.orderBy(F.col(name).asc() if ascending else F.col(name).desc())


LENGTH = 10  # digits of the length of a digit run
# The usual collation order of ASCII punctuation, before digits.
PUNCTUATION = " _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def _fold_table() -> tuple[str, str]:
    """Characters and their sort stand-ins: punctuation in collation order below
    the digits, accented letters as their base letter, combining marks gone."""
    pairs = [(ch, chr(0x0E + i)) for i, ch in enumerate(PUNCTUATION)]
    for code in [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        parts = unicodedata.normalize("NFKD", ch)
        if len(parts) > 1 and unicodedata.combining(parts[1]) and ch == ch.lower():
            pairs.append((ch, parts[0]))
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def natural_key(df: DataFrame, name: str) -> list[Column]:
    """Sort keys of a column: numbers by value, ISO-dated text by time, other text
    ignoring case and accents with digit runs compared as numbers.

    The text key is built once per row and compares as bytes; a collation would be
    asked again at every comparison of the sort.
    """
    kind = df.schema[name].dataType
    c = F.col(name)
    if not isinstance(kind, T.StringType):
        return [c]
    folded = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    # A digit run becomes its length without leading zeros, in LENGTH digits, and itself,
    # so runs of any length compare as numbers.
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    keyed = lambda x: F.when(
        x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), LENGTH, "0"), bare(x))
    ).otherwise(x)
    runs = F.regexp_extract_all(folded, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    text = F.when(folded.rlike("[0-9]"), F.array_join(F.transform(runs, keyed), "")).otherwise(folded)
    dated = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("timestamp"))
    return [dated, text]


def with_natural_keys(df: DataFrame, name: str, prefix: str = "_n") -> tuple[DataFrame, list[str]]:
    """The sort keys as columns. A sort evaluates an expression at each comparison,
    a column only once."""
    keys = {f"{prefix}{i}": k for i, k in enumerate(natural_key(df, name))}
    return df.withColumns(keys), list(keys)


def sort_natural(
    df: DataFrame, column: str, ascending: bool = True, tie: list[str] | None = None, index: str | None = None
) -> DataFrame:
    """Natural sort; NULL last in both directions. ``index`` adds the 0-based place."""
    keyed, names = with_natural_keys(df, column)
    ways = [F.col(n).asc_nulls_last() if ascending else F.col(n).desc_nulls_last() for n in names]
    order = [F.col(column).isNull(), *ways, *(tie or [])]
    return (with_running_index(keyed, order, index) if index else keyed.orderBy(*order)).drop(*names)


# --- nearest neighbours ------------------------------------------------------

# Numbers in the query matrix of a pass, and scores that a task holds at once.
QUERY_CELLS, SCORE_CELLS = 1_000_000, 4_000_000


def vector_topk(
    vectors: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int = 10, metric: str = "cosine",
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` best vectors per query: ``(query_id, rank, id, score)``.

    Each task scores its Arrow batches with one matrix product and passes on only
    its best ``k`` per query; the shuffle sees tasks x queries x k rows at most.
    Larger query sets run as several passes; of a DataFrame (id, vector) the driver
    holds one pass at a time.
    """
    out = None
    for block in _query_blocks(queries):
        part = _topk(vectors, block, k, metric, id_column, vector_column)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    return out


def _query_blocks(queries: DataFrame | list[tuple[int, list[float]]]) -> Iterator[list[tuple[int, list[float]]]]:
    if isinstance(queries, list):
        per_pass = max(1, QUERY_CELLS // max(1, len(queries[0][1]))) if queries else 1
        for at in range(0, len(queries), per_pass):
            yield queries[at:at + per_pass]
        return
    named = queries.toDF("_q", "_v").where("_q IS NOT NULL AND _v IS NOT NULL")
    n, width = named.agg(F.count("*"), F.max(F.size("_v"))).first()
    per_pass = max(1, QUERY_CELLS // max(1, width or 1))
    if n <= per_pass:
        rows = named.orderBy("_q").collect()
        if rows:
            yield [(r["_q"], list(r["_v"])) for r in rows]
        return
    numbered = with_running_index(named, ["_q"], "_at")
    for at in range(0, n, per_pass):
        rows = numbered.where(F.col("_at").between(at, at + per_pass - 1)).orderBy("_at").collect()
        yield [(r["_q"], list(r["_v"])) for r in rows]


def _topk(vectors, queries, k, metric, id_column, vector_column) -> DataFrame:
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64)

    cells = SCORE_CELLS

    # The task code stands alone: workers need numpy and Arrow, not this package.
    def unit(m: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length == 0, 1.0, length)

    if metric == "cosine":
        matrix = unit(matrix)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_ids = np.empty((len(ids), 0), dtype=np.int64)
        top = np.empty((len(ids), 0))
        step = max(1, cells // len(ids))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = flat.astype(np.float64).reshape(batch.num_rows, -1)
            if metric == "cosine":
                score = matrix @ unit(rows).T
            elif metric == "dot":
                score = matrix @ rows.T
            else:
                gap = (matrix**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * matrix @ rows.T
                score = -np.sqrt(np.maximum(gap, 0))
            here = np.broadcast_to(batch.column(0).to_numpy(zero_copy_only=False), score.shape)
            top = np.concatenate([top, score], axis=1)
            top_ids = np.concatenate([top_ids, here], axis=1)
            order = np.lexsort((top_ids, -top), axis=1)[:, :k]
            top = np.take_along_axis(top, order, axis=1)
            top_ids = np.take_along_axis(top_ids, order, axis=1)
        n = top.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)), pa.array(top_ids.ravel()), pa.array(top.ravel())],
                names=["query_id", "id", "score"],
            )

    scored = (
        vectors.where(F.col(vector_column).isNotNull())
        .select(F.col(id_column).cast("bigint"), vector_column)
        .mapInArrow(best, "query_id bigint, id bigint, score double")
    )
    ranked = top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)
    score = F.col("score") if metric != "l2" else -F.col("score")
    return ranked.select("query_id", F.col("_rank").alias("rank"), "id", score.alias("score"))
