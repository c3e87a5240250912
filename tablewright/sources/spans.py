"""Records that a line break may lie in, read by many tasks.

A file is read in pieces (lines, or what lies between commas), in Spark's own splits. Whether
a piece ends a record depends on what comes before it: open quotes and open brackets. Each
split is run from both possible starts (outside and inside a text), which gives it a function
from start to end; the functions of a file, one row per split, are composed on the driver, and
a second pass cuts the records from known starts. Records that cross splits come out as
fragments, which are put together by a small grouping.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.storage import materialize

# A scan takes pieces and whether the first begins inside a text; it gives, after each piece,
# whether that goes on and the brackets opened so far.
Scan = Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]]
ENDS = "file string, block bigint, first string, end0 boolean, opened0 bigint, end1 boolean, opened1 bigint"
RECORDS = "file string, block bigint, seq bigint, head boolean, tail boolean, record string"


def quoted_fields(sep: str, quote: str = '"') -> Scan:
    """Lines of delimited text: a quote opens a text at the start of a field; doubled, it is
    one quote of the text."""

    def after(line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                close = line.find(quote, at)
                if close < 0:
                    return True
                at = close + 1
                if line.startswith(quote, at):
                    at += 1
                    continue
                inside = False
            elif line.startswith(quote, at):
                inside, at = True, at + 1
                continue
            at = line.find(sep, at) + 1
            if not at:
                return False

    def scan(values: list[str], inside: bool) -> tuple[np.ndarray, np.ndarray]:
        ends = np.empty(len(values), bool)
        for i, line in enumerate(values):
            if quote in line:
                inside = after(line, inside)
            ends[i] = inside
        return ends, np.zeros(len(values), np.int64)

    return scan


_TEXT = re.compile(r'"(?:[^"\\]|\\.)*("|\Z)', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*("|\Z)', re.S)


def json_pieces(values: list[str], inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """JSON between commas: texts and the brackets outside them. No escape ends in a comma, so
    none crosses pieces."""
    ends, opened, depth = np.empty(len(values), bool), np.empty(len(values), np.int64), 0
    for i, piece in enumerate(values):
        if inside:
            found = _REST.match(piece)
            inside = not found[1]
            piece = piece[found.end() :]
        if not inside:
            if '"' in piece:
                last = None
                for last in _TEXT.finditer(piece):
                    pass
                inside = not last[1]
                piece = _TEXT.sub("", piece)
            depth += piece.count("[") + piece.count("{") - piece.count("]") - piece.count("}")
        ends[i], opened[i] = inside, depth
    return ends, opened


def pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(value, file, block) of a text file in ``sep``-ended pieces; ``block`` is where their split starts."""
    text = spark.read.option("lineSep", sep).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The pieces of each batch by split; splits of a task come one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, values = (batch.column(c) for c in ("file", "block", "value"))
        b = blocks.to_numpy()
        f = files.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((b[1:] != b[:-1]) | (f[1:] != f[:-1])) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield (files[a].as_py(), int(b[a])), values.slice(a, e - a).to_pylist()


def records(lines: DataFrame, scan: Scan, join: str, levels: dict[str, int] | None = None) -> DataFrame:
    """(record_no, record, first, open) of all files, numbered from 1 in the order of file names.

    A record ends with a piece after which no text is open and as many brackets as
    ``levels`` says for the file's first character (none, if it does not say), or with its
    file: then it is ``open``. ``first`` marks the first of a file. Its pieces are joined by ``join``. ``lines`` is read twice
    and must give the same splits."""
    levels = levels or {}
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = lines.sparkSession
    of_ends, of_records = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (ENDS, RECORDS))

    def functions(batches):
        at, state, first = None, [], ""

        def row():
            (e0, d0), (e1, d1) = state
            return pa.RecordBatch.from_pylist(
                [{"file": at[0], "block": at[1], "first": first, "end0": e0, "opened0": d0, "end1": e1, "opened1": d1}], of_ends
            )

        for split, values in _splits(batches):
            if split != at:
                if at is not None:
                    yield row()
                at, state, first = split, [(False, 0), (True, 0)], values[0].lstrip("\ufeff \t\r\n")[:1]
            for k, (inside, depth) in enumerate(state):
                ends, opened = scan(values, inside)
                state[k] = (bool(ends[-1]), depth + int(opened[-1]))
        if at is not None:
            yield row()

    found = lines.mapInArrow(functions, ENDS).collect()  # one row per split
    starts: dict[tuple[str, int], tuple[bool, int, int]] = {}
    state, file, level = (False, 0), None, 0
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            state, file, level = (False, 0), r["file"], levels.get(r["first"], 0)
        starts[r["file"], r["block"]] = (*state, level)
        inside, depth = state
        state = (r["end1"], depth + r["opened1"]) if inside else (r["end0"], depth + r["opened0"])
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches):
        at, inside, depth, level, held, seq, head = None, False, 0, 0, [], 0, False

        def row(tail):
            return {"file": at[0], "block": at[1], "seq": seq, "head": head, "tail": tail, "record": join.join(held)}

        for split, values in _splits(batches):
            out = []
            if split != at:
                if held:
                    out.append(row(True))
                at, seq, held = split, 0, []
                inside, depth, level = shared.value[split]
                # The first split of a file starts a record, whatever its brackets.
                head = split[1] > 0 and (inside or depth != level)
            ends, opened = scan(values, inside)
            last = 0
            for i in np.flatnonzero(~ends & (opened + depth == level)).tolist():
                held += values[last : i + 1]
                out.append(row(False))
                last, held, seq, head = i + 1, [], seq + 1, False
            held += values[last:]
            inside, depth = bool(ends[-1]), depth + int(opened[-1])
            if out:
                yield pa.RecordBatch.from_pylist(out, of_records)
        if held:
            yield pa.RecordBatch.from_pylist([row(True)], of_records)

    done = materialize(lines.mapInArrow(cut, RECORDS), "records")
    # Where each split's own records are numbered from: one row per split.
    counts = done.groupBy("file", "block").agg(F.count_if(~F.col("head")).alias("n"), F.max(F.col("head").cast("int")).alias("head")).collect()
    offsets, total = [], 1
    for r in sorted(counts):
        offsets.append((r["file"], r["block"], total - r["head"]))
        total += r["n"]
    numbers = spark.createDataFrame(offsets, "file string, block bigint, before bigint")
    # At most two fragments per split: where each record that crosses splits begins.
    torn = done.where("head OR tail")
    begins, at = [], None
    for r in sorted(torn.select("file", "block", "seq", "head").collect()):
        if not r["head"] or at is None or at[0] != r["file"]:
            at = r
        begins.append((r["file"], r["block"], r["seq"], at["block"], at["seq"]))
    known = spark.createDataFrame(begins, "file string, block bigint, seq bigint, from_block bigint, from_seq bigint")
    parts = F.sort_array(F.collect_list(F.struct("block", "seq", "record", "tail")))
    whole = torn.join(known, ["file", "block", "seq"]).groupBy("file", F.col("from_block").alias("b"), F.col("from_seq").alias("s")).agg(parts.alias("parts"))
    whole = whole.select(
        "file", F.col("b").alias("block"), F.col("s").alias("seq"),
        F.array_join(F.transform("parts", lambda x: x["record"]), join).alias("record"), F.element_at("parts", -1)["tail"].alias("open"),
    )
    plain = done.where("NOT head AND NOT tail").select("file", "block", "seq", "record", F.lit(False).alias("open"))
    return plain.unionAll(whole).join(numbers, ["file", "block"]).select(
        (F.col("before") + F.col("seq")).alias("record_no"), "record", ((F.col("block") == 0) & (F.col("seq") == 0)).alias("first"), "open"
    )
