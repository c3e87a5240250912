"""What the operators share: splits by document id, bounded pieces of Arrow batches,
words and word hashes.

Words are runs of bytes other than space and ``\\t \\n \\v \\f \\r`` (what ``bytes.split``
takes), and case folding touches A-Z alone (what ``bytes.lower`` does), in every operator.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 2_000_000  # text handled at once by a task
WORD_CACHE = 400_000  # words a task remembers something of
SPACE = r"\x20\x09-\x0D"
U64 = np.uint64


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def held_out(id_column: str, modulus: int, rest: int) -> Column:
    """True for ids with that remainder, and for rows without an id."""
    return F.coalesce(remainder(id_column, modulus) == rest, F.lit(True))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name += "_"
        out.append(name)
    return out


def give_back() -> None:
    """Return to the system what a task of this Python worker, or an earlier one, has freed.

    The C library keeps it, and a worker outlives its tasks; other libraries have no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has about ``size`` bytes of ``column``, or one row."""
    give_back()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``df.mapInArrow`` for a function that yields dictionaries of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        give_back()
        columns = None
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow],
                schema=arrow,
            )
        del columns
        give_back()  # the worker may have no task for long

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df.mapInArrow`` for a function that yields batches of rows of ``df``."""

    def run(batches):
        give_back()
        kept = None
        for kept in fn(batches):
            yield kept
        del kept
        give_back()  # as in map_batches

    return df.mapInArrow(run, df.schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8, NULL as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    factor = 0x9E3779B97F4A7C15
    for k in range(size):
        out += words[k : k + n] * U64((factor * (2 * k + 1) ** 3 | 1) & 0xFFFFFFFFFFFFFFFF)
    return mixed(out)


SPACES = b" \t\n\v\f\r"


class Words:
    """64-bit hashes of the words of many texts at once.

    A word is a run of bytes other than ``separators``. Its hash is a polynomial of random
    64-bit stand-ins of its bytes, modulo 2**64, taken from running sums over the whole
    buffer, then mixed with its length; so it depends on the word alone."""

    CHUNK = 4_000_000

    def __init__(self, separators: bytes = SPACES):
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        if not self.separator[10]:
            raise ValueError("a line feed must separate words: it stands between texts")
        rng = np.random.default_rng(20_240_607)
        self.stand_in = rng.integers(0, 2**64, 256, dtype=U64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                row = np.full(size, step, U64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (one more bound at the end)."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        parts: list[np.ndarray] = []
        begins: list[np.ndarray] = []
        at = 0
        while at < len(raw):
            to = min(at + self.CHUNK, len(raw))
            gap = self.separator[raw[at:to]]
            while not gap[-1]:  # on to the next separator
                more = self.separator[raw[to : to + self.CHUNK]]
                step = int(more.argmax()) + 1 if more.any() else len(more)
                gap = np.append(gap, more[:step])
                to += step
            change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
            if not gap[0]:
                change = np.append(0, change)
            starts, ends = change[::2], change[1::2]
            self._powers(to - at)
            sums = np.empty(to - at + 1, U64)
            sums[0] = 0
            np.cumsum(self.stand_in[raw[at:to]] * self.up[: to - at], out=sums[1:])
            value = (sums[ends] - sums[starts]) * self.down[starts]
            parts.append(mixed(value + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407)))
            begins.append(starts + at)
            at = to
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.append(0, np.cumsum(lengths + 1))
        bounds = np.searchsorted(np.concatenate(begins), first)
        return np.concatenate(parts), bounds
