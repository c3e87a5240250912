"""Line deduplication over a corpus.

Every line becomes a 128-bit hash of its key with document and position; the texts stay
where they are. The hashes are range-partitioned by (hash, document, position), so that a
line that a third of all documents hold spreads over many partitions, and sorted inside
each. A task streams its partition, keeps the first document of each hash (the largest
id, as ids fall) and names the lines of all later ones. Only the first and the last hash
of a partition can go on in another; their lines are marked open and settled by two
summary rows per partition. The result is one compressed bitmap per document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import as_bytes, map_batches, pieces
from tablewright.storage import materialize

BLANK = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)  # stands for a NULL id: below all others
LINES = "doc bigint, row bigint, pos int, h1 bigint, h2 bigint"
FOUND = "kind int, h1 bigint, h2 bigint, doc bigint, row bigint, pos int, part int, last_doc bigint, n bigint"
DROPPED, OPEN, EDGE = 0, 1, 2


def _identified(docs: DataFrame, id_column: str, text_column: str, *more: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text_column).alias("row"),
        F.col(text_column).alias("text"),
        *more,
    )


def line_hashes(docs: DataFrame, min_chars: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per line whose key has ``min_chars`` code points, and one per document
    with pos -1 and the number of its lines in h1."""

    def run(batches):
        for batch in pieces(batches, "text"):
            docs_in, rows_in = batch.column("doc").to_pylist(), batch.column("row").to_pylist()
            doc, row, pos, keys = [], [], [], []
            h1 = []
            for d, r, text in zip(docs_in, rows_in, as_bytes(batch.column("text"))):
                lines = text.split(b"\n")
                doc.append(d), row.append(r), pos.append(-1), h1.append(len(lines)), keys.append(bytes(16))
                for at, line in enumerate(lines):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(BLANK)
                    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
                        continue
                    doc.append(d), row.append(r), pos.append(at), h1.append(0)
                    keys.append(hashlib.blake2b(key.lower(), digest_size=16).digest())
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            first = np.where(np.array(pos) < 0, np.array(h1, np.int64), both[:, 0])
            yield {"doc": doc, "row": row, "pos": pos, "h1": pa.array(first), "h2": pa.array(np.ascontiguousarray(both[:, 1]))}

    return map_batches(_identified(docs, id_column, text_column), run, LINES)


def _stream(min_docs: int):
    """The lines to drop in one sorted partition, its open lines and its two edges."""

    def found(kind, rows):
        n = len(rows["doc"])
        return {"kind": np.full(n, kind, np.int32), **rows, "part": np.zeros(n, np.int32),
                "last_doc": np.zeros(n, np.int64), "n": np.zeros(n, np.int64)}

    def edge(key, first, last, n, part):
        return {"kind": [EDGE], "h1": [key[0]], "h2": [key[1]], "doc": [first], "row": [0], "pos": [0],
                "part": [part], "last_doc": [last], "n": [n]}

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ("h1", "h2", "doc", "row", "pos")
        begun = False
        state = None  # kind, key, first and last document, documents of the hash that goes on
        held = None  # instead of a state: its rows, while it has too few documents
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if held is not None:
                rows, held = {n: np.concatenate([held[n], rows[n]]) for n in names}, None
            doc, size = rows["doc"], len(rows["doc"])
            new_key = np.ones(size, bool)
            new_key[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
            starts = np.flatnonzero(new_key)
            ends = np.append(starts[1:], size)
            fresh = new_key.copy()  # where a document begins within its hash
            fresh[1:] |= doc[1:] != doc[:-1]
            counts = np.add.reduceat(fresh.astype(np.int64), starts)
            at, head = 0, (int(rows["h1"][0]), int(rows["h2"][0]))
            if not begun:
                begun, state = True, [OPEN, head, int(doc[0]), None, 0]
            if state is not None:
                if state[1] == head:
                    mine = {n: v[: ends[0]] for n, v in rows.items()}
                    state[4] += int(counts[0]) - (state[3] == int(doc[0]))
                    state[3] = int(mine["doc"][-1])
                    stays = np.ones(ends[0], bool) if state[0] == OPEN else mine["doc"] != state[2]
                    yield found(state[0], {n: v[stays] for n, v in mine.items()})
                    at = 1
                if at == len(starts):
                    continue
                if state[0] == OPEN:
                    yield edge(*state[1:], part)
                state = None
            run_of = np.repeat(np.arange(len(starts)), ends - starts)
            drop = (run_of >= at) & (counts[run_of] >= min_docs) & (doc != doc[starts][run_of])
            if drop.any():
                yield found(DROPPED, {n: v[drop] for n, v in rows.items()})
            # The last hash may go on in the next batch.
            tail = {n: v[starts[-1] :].copy() for n, v in rows.items()}
            if counts[-1] >= min_docs:
                key = (int(tail["h1"][0]), int(tail["h2"][0]))
                state = [DROPPED, key, int(tail["doc"][0]), int(tail["doc"][-1]), int(counts[-1])]
            else:
                held = tail
        if held is not None:
            yield found(OPEN, held)
            key = (int(held["h1"][0]), int(held["h2"][0]))
            state = [OPEN, key, int(held["doc"][0]), int(held["doc"][-1]), len(np.unique(held["doc"]))]
        if state is not None:
            yield edge(*state[1:], part)

    return run


def _settled(edges, min_docs: int) -> list[tuple]:
    """(h1, h2, kept document) of the hashes at partition borders that lose lines.

    ``edges``: at most two rows per partition, in partition order."""
    runs: dict[tuple, list] = {}
    for e in edges:
        run = runs.setdefault((e["h1"], e["h2"]), [e["doc"], None, 0])
        run[2] += e["n"] - (run[1] == e["doc"])
        run[1] = e["last_doc"]
    return [(*k, first) for k, (first, _, n) in runs.items() if n >= min_docs]


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc, row, pos) of every line that goes."""
    spark = lines.sparkSession
    ordered = ["h1", "h2", F.col("doc").desc(), "row", "pos"]
    dealt = lines.where("pos >= 0").repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    found = materialize(map_batches(dealt, _stream(min_docs), FOUND), "line-runs")
    # Two rows per partition: bounded by the number of partitions, not by the data.
    edges = found.where(F.col("kind") == EDGE).select("h1", "h2", "doc", "last_doc", "n", "part").collect()
    edges = sorted(edges, key=lambda e: (e["part"], e["h1"], e["h2"]))
    settled = spark.createDataFrame(_settled(edges, min_docs), "h1 bigint, h2 bigint, kept bigint")
    open_lines = found.where(F.col("kind") == OPEN).join(F.broadcast(settled), ["h1", "h2"]).where("doc <> kept")
    return (
        found.where(F.col("kind") == DROPPED).select("doc", "row", "pos")
        .unionAll(open_lines.select("doc", "row", "pos"))
    )


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc, row (hash of the text), n_lines, n_dropped and keep_bitmap: zlib of one bit per
    line, first line in the highest bit, 1 for a line that stays.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. A key of
    at least ``min_chars`` code points found in at least ``min_docs`` documents loses its
    lines everywhere but in the largest id. A NULL or empty text is one empty line; rows
    of one id are one document; a NULL id is one document below all others (in ``doc``:
    the smallest bigint). Equal rows get one bitmap. An empty table gives none. Other
    columns are not read."""
    lines = materialize(line_hashes(docs, min_chars, id_column, text_column), "line-hashes")
    gone = dropped_lines(lines, min_docs).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    whole = lines.where("pos < 0").groupBy("doc", "row").agg(F.first("h1").alias("n_lines"))

    def run(batches):
        for batch in batches:
            n_lines, bitmaps, n_gone = batch.column("n_lines").to_pylist(), [], []
            for n, at in zip(n_lines, batch.column("gone")):
                bits = np.ones(n, np.uint8)
                if at.is_valid:
                    bits[at.values.to_numpy()] = 0
                n_gone.append(n - int(bits.sum()))
                bitmaps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield {"doc": batch.column("doc"), "row": batch.column("row"), "n_lines": n_lines, "n_dropped": n_gone, "keep_bitmap": bitmaps}

    schema = "doc bigint, row bigint, n_lines bigint, n_dropped bigint, keep_bitmap binary"
    return map_batches(whole.join(gone, ["doc", "row"], "left").select("doc", "row", "n_lines", "gone"), run, schema)


def kept_lines(text: bytes, n_lines: int, bitmap: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)
    return text if bits.all() else b"\n".join(line for line, bit in zip(text.split(b"\n"), bits) if bit)


def with_kept_text(
    docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped and kept_sha256 of every row of ``docs``."""
    # The bitmaps of a partition are a hash table, one small row per text: no text is sorted.
    joined = _identified(docs, id_column, text_column, F.col(id_column).cast("bigint").alias("doc_id")).join(bitmaps.hint("shuffle_hash"), ["doc", "row"])

    def run(batches):
        for batch in pieces(batches, "text"):
            kept = [
                kept_lines(t, n, b)
                for t, n, b in zip(as_bytes(batch.column("text")), batch.column("n_lines").to_pylist(), batch.column("keep_bitmap").to_pylist())
            ]
            yield {
                "doc_id": batch.column("doc_id"), "n_lines": batch.column("n_lines"), "n_dropped": batch.column("n_dropped"),
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept_text": [k.decode() for k in kept],
            }

    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string"
    return map_batches(joined.select("doc_id", "text", "n_lines", "n_dropped", "keep_bitmap"), run, schema)
