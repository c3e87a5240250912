"""Harmonic packing of token sequences.

A class k holds pieces of capacity / k tokens, and a bin of the class exactly k of them. A
document is cut greedily: the largest class length that fits, again and again, so its
pieces fill their classes' bins without loss (only class lengths that leave at most SLACK
tokens of a bin empty are used). Every task packs its own documents, class by class,
independently of the others. What it holds at its end in bins that are not full, less than
one bin per class, is cut once more: into whole sequences, then into powers of two, which
need no padding. So a sequence's padding is at most SLACK, wherever it lies.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_batches, pieces

CAPACITY = 1024
SLACK = 2
FLUSH = 50_000  # rows given out at once
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def class_lengths(capacity: int, slack: int = SLACK) -> list[int]:
    """capacity // k, descending, where k pieces leave at most ``slack`` tokens empty; ends in 1."""
    found = {capacity // k: k for k in range(capacity, 0, -1)}
    return [n for n in sorted(found, reverse=True) if capacity - capacity // n * n <= slack]


class Packer:
    """Bins of one task. A piece is (doc, start, length, crc, document's tokens)."""

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK):
        self.capacity, self.lengths = capacity, class_lengths(capacity, slack)
        # For each length below the capacity, the largest class length within it.
        self.fit = [0] * (capacity + 1)
        for n in reversed(self.lengths):
            self.fit[n:] = [n] * (capacity + 1 - n)
        self.open: dict[int, list] = {n: [] for n in self.lengths}
        self.count = {n: capacity // n for n in self.lengths}
        self.next = 0
        self.rows: list[tuple] = []

    def _close(self, held: list) -> None:
        at = 0
        for doc, start, ids, total in held:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at, ids))
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        """One document, its ids as little-endian 32-bit bytes."""
        total, at = len(ids) // 4, 0
        while at < total:
            n = self.fit[min(total - at, self.capacity)]
            held = self.open[n]
            held.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            if len(held) == self.count[n]:
                self._close(held)
                self.open[n] = []

    def finish(self) -> None:
        """Empty the open bins: sequences of the capacity, then of falling powers of two."""
        rest = [p for n in self.lengths for p in self.open[n]]
        left = sum(len(ids) // 4 for _, _, ids, _ in rest)
        sizes = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        sizes += [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
        rest.reverse()
        for size in sizes:
            held, free = [], size
            while free:
                doc, start, ids, total = rest.pop()
                n = min(free, len(ids) // 4)
                held.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.append((doc, start + n, ids[4 * n :], total))
                free -= n
            self._close(held)
        self.open = {n: [] for n in self.lengths}

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, slack: int = SLACK, end_id: int = 0, id_column: str = "doc_id",
    text_column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    ``with_ids`` adds the ids themselves.

    Every row of ``docs`` is a document of its own, also one that repeats an id or has none;
    NULL and empty texts are the end id alone. sequence_id has the task's partition in its
    upper bits; sequences hold no gap. An empty table gives no piece. Other columns are not
    read. A retried task reads the same rows and so gives the same pieces."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        from tablewright.llm.token_files import ENCODED_BYTES, encoder

        high = TaskContext.get().partitionId() << 40
        encode, packer = encoder(shared.value).encode, Packer(capacity, slack)

        def given():
            rows = packer.take()
            out = {name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(names)}
            out["sequence_id"] = pa.array([high | r[5] for r in rows], pa.int64())
            if with_ids:
                ends = np.cumsum([0, *(r[2] for r in rows)]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(r[7] for r in rows), "<i4")))
            return out

        for batch in pieces(batches, "text", ENCODED_BYTES):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                packer.add(doc, ids + end)
            if len(packer.rows) > FLUSH:
                yield given()
        packer.finish()
        yield given()

    return map_batches(docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")), run, schema)
