"""Token ids in binary files of patched frame-of-reference blocks.

Documents are range-partitioned by id and sorted; each task encodes its share and emits
segments, which Spark's text writer puts into files byte by byte (one column, cast from
binary; a newline ends each segment), so output is committed by Spark on any file system
and a retried task leaves no second copy. A file is read back whole, as one binary row.

A segment, little-endian: ``HEADER``; per document the id (i8), whether it is NULL (u1)
and its number of ids (u4); per block its minimum (u4), bit width (u1), number of
exceptions (u2) and start in the payload (u8); the payload; a newline. A block holds
``BLOCK`` ids less their minimum, packed at the width that ``SHARE`` of them fit; larger
ones are exceptions: positions (u2), then values (u4), after the packed words. 64 values
of width w fill w 64-bit words. The last block is padded with its last id.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import map_batches, pieces
from tablewright.storage import materialize, work_path

BLOCK, LANE = 256, 64
SHARE = 0.9
MAGIC = b"TWPF1\0\0\0"
HEADER = struct.Struct("<8sQIQIQ")  # magic, bytes, part, ids of the part before it, documents, ids
SEGMENT_IDS = 1_000_000
UNIT_CACHE = 350_000
ENCODED_BYTES = 4_000_000  # text encoded at once by a task: the more, the fewer of its units are distinct
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]
# Two white-space characters side by side: there a pre-token may reach over a cut.
_RUN = re.compile(r"\s\s")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
# Bytes before which a text is cut: blanks and line feeds, and these marks after a Latin letter
# (an apostrophe may be part of "'s").
_BEFORE, _MARK, _LETTER = np.zeros((3, 256), bool)
_BEFORE[[32, 10]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_STEPS = np.array([1 << w for w in range(33)], np.uint64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 64) values below 2**width as (rows, width) words."""
    words = np.zeros((width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T)
    for j in range(LANE):
        word, shift = divmod(j * width, 64)
        words[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return words.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((LANE, len(words)), np.uint64)
    for j in range(LANE):
        word, shift = divmod(j * width, 64)
        v = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | columns[word + 1] << np.uint64(64 - shift)
        out[j] = v & mask
    return out.T


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, part: int = 0, start: int = 0) -> bytes:
    """One segment, without the newline that ends it in a file."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if n else np.empty(0, np.uint32)
    delta = rows - low[:, None]
    if not n or delta.max() < 1 << 16:
        delta = delta.astype(np.uint16)  # less to move
    at = math.ceil(SHARE * BLOCK) - 1
    widths = np.searchsorted(_STEPS, np.partition(delta, at, axis=1)[:, at].astype(np.uint64), "right").astype(np.uint8)
    body: list[bytes] = [b""] * blocks
    counts = np.zeros(blocks, np.uint16)
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        part_delta, most = delta[mine], (1 << int(width)) - 1
        packed = _pack((part_delta & delta.dtype.type(most)).astype(np.uint64).reshape(-1, LANE), int(width)) if width else None
        big = part_delta > most
        counts[mine] = big.sum(axis=1)
        which, where = np.nonzero(big)
        values = part_delta[which, where].astype("<u4")
        ends = np.cumsum(counts[mine].astype(np.int64))
        data = np.ascontiguousarray(packed).astype("<u8").tobytes() if width else b""
        size = int(width) * 8 * (BLOCK // LANE)
        where = where.astype("<u2")
        for k, block in enumerate(mine):
            a, b = int(ends[k]) - int(counts[block]), int(ends[k])
            body[block] = data[k * size : (k + 1) * size] + where[a:b].tobytes() + values[a:b].tobytes()
    starts = np.zeros(blocks, "<u8")
    starts[1:] = np.cumsum([len(b) for b in body[:-1]]) if blocks else 0
    rest = b"".join([
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u4").tobytes(),
        low.astype("<u4").tobytes(), widths.tobytes(), counts.astype("<u2").tobytes(), starts.tobytes(),
        *body,
    ])
    return HEADER.pack(MAGIC, HEADER.size + len(rest), part, start, len(doc_ids), n) + rest


def decode_segment(data: memoryview) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """part, start, document ids, lengths, token ids."""
    magic, size, part, start, n_docs, n = HEADER.unpack_from(data)
    if magic != MAGIC or len(data) < size:
        raise ValueError("not a token segment")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    ids, nulls, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    blocks = -(-n // BLOCK)
    low, widths, counts, starts = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks)
    payload = np.frombuffer(data, np.uint8, size - at, at)
    out = np.zeros((blocks, BLOCK), np.uint64)
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        length = int(width) * 8 * (BLOCK // LANE)
        if width:
            at_block = np.lib.stride_tricks.sliding_window_view(payload, length)
            words = at_block[starts[mine].astype(np.int64)].view("<u8").reshape(-1, int(width))
            out[mine] = _unpack(words, int(width)).reshape(len(mine), BLOCK)
    for block in np.flatnonzero(counts):
        k, a = int(counts[block]), at + int(starts[block]) + int(widths[block]) * 8 * (BLOCK // LANE)
        out[block, np.frombuffer(data, "<u2", k, a)] = np.frombuffer(data, "<u4", k, a + 2 * k)
    tokens = (out + low[:, None]).astype(np.uint32).reshape(-1)[:n]
    return part, start, [None if z else int(d) for d, z in zip(ids, nulls)], lengths, tokens


class Units(dict):
    """Ids of units of text, remembered for the ones seen lately: new ones in a dictionary,
    ``size`` older ones in Arrow arrays, which take a fraction of its memory."""

    def __init__(self, ids, size: int):
        super().__init__()
        self.ids, self.size, self.older = ids, size, Older()

    def __missing__(self, unit: str) -> bytes:
        value = self[unit] = self.ids(unit)
        return value

    def of(self, units: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct units."""
        at = pc.index_in(units, value_set=self.older.units)
        seen = at.is_valid()
        found = at.drop_null().to_numpy()
        self.older.used[found] = True
        new = pa.array(list(map(self.__getitem__, units.filter(pc.invert(seen)).to_pylist())), pa.large_binary())
        place = np.empty(len(units), np.int64)
        mask = seen.to_numpy(zero_copy_only=False)
        place[mask], place[~mask] = found, len(self.older.units) + np.arange(len(new))
        out = pa.concat_arrays([self.older.ids, new]).take(pa.array(place))
        if len(self) >= self.size // 8:
            self.older.add(self, self.size)
            self.clear()
        return out


class Older:
    """Units and their ids, those used last first."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.units, self.ids, self.used = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    def add(self, new: dict[str, bytes], size: int) -> None:
        """Units are taken in that are not there or are there as well; the latter are held twice until they age."""
        lately = pa.array(np.append(np.flatnonzero(self.used), np.flatnonzero(~self.used)))
        join = lambda fresh, held: pa.concat_arrays([pa.array(fresh, held.type), held.take(lately)])[:size]
        units, ids = join(list(new), self.units), join(list(new.values()), self.ids)
        # A slice keeps the whole array alive.
        self.units, self.ids = pa.concat_arrays([units]), pa.concat_arrays([ids])
        self.used = np.zeros(len(units), bool)


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a UTF-8 text is cut before each byte: before a blank, around a line feed, and
    before a mark after a letter up to U+024F."""
    cut = _BEFORE[raw]
    cut[1:] |= raw[:-1] == 10
    marks = np.flatnonzero(_MARK[raw])
    last, lead = raw[np.maximum(marks - 1, 0)], raw[np.maximum(marks - 2, 0)]
    two = (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))  # but the signs of times and division
    after = _LETTER[last] | (last >= 128) & (two | (lead == 0xC9) & (last <= 0x8F))
    cut[marks[after]] = True
    return cut


class Encoder:
    """Ids of a text, as little-endian 32-bit bytes, by a file of the tokenizers library.

    With byte-level pre-tokens, a text that has no two white-space characters side by side
    is cut before each blank, around each newline and before each mark after a letter, where
    no pre-token reaches across. The distinct units of the texts, told apart in Arrow, are cut
    into pre-tokens, the library's model encodes these, and their ids are remembered. Any other text goes through the library whole, also one that holds the
    string of a special token, which the library takes for that token."""

    def __init__(self, file_text: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        setup = json.loads(file_text)
        # Tokens that the library finds in a text before anything else.
        self.added = [t["content"] for t in setup.get("added_tokens") or []]
        before = setup.get("pre_tokenizer") or {}
        self.by_word = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True) and not setup.get("normalizer")
            and not any(t.get("normalized") or not t.get("special") for t in setup.get("added_tokens") or [])
        )
        # Fixed value: the pattern of byte-level pre-tokens.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.units = Units(self._unit, UNIT_CACHE)
        # Bytes as the printable characters that stand for them in the vocabulary.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.blank = self.shown[32]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pretoken(self, text: str) -> bytes:
        return self._shown_ids(text.encode().decode("latin-1").translate(self.shown))

    def _shown_ids(self, shown: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(shown)]
        return _PACKERS[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        if unit.isascii():
            if unit.isalpha():  # shown as it is
                return self._shown_ids(unit)
            if not unit:
                return b""
            if unit[0] == " " and (word := unit[1:]).isalpha():
                return self._shown_ids(self.blank + word)
        elif max(unit) > "\u024f":  # beyond Latin letters the library's own tables count
            return self.whole(unit)
        elif unit.isalpha() or unit[0] == " " and unit[1:].isalpha():
            return self._pretoken(unit)
        parts = self.cut(unit)
        return self._pretoken(unit) if len(parts) == 1 else b"".join(map(self.units.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
            if runs or any(map(text.__contains__, self.added)) or any(map(text.__contains__, _OTHER_SPACE)) and _RUN.search(text):
                out[k] = self.whole(text)
            elif text:
                plain.append(k)
        for k, ids in zip(plain, self._by_unit([texts[k] for k in plain])):
            out[k] = ids
        return out

    def _by_unit(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that may be cut, none of them empty."""
        if not texts:
            return
        data = [t.encode() for t in texts]
        begins = np.cumsum([0, *map(len, data)])
        raw = np.frombuffer(b"".join(data), np.uint8)
        del data
        cut = _cuts(raw)
        cut[begins[:-1]] = True
        starts = np.flatnonzero(cut)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        _, offsets, content = self.units.of(units.dictionary).take(units.indices).buffers()
        ends = np.frombuffer(offsets, np.int64, len(starts) + 1)[np.searchsorted(starts, begins)].tolist()
        content = memoryview(content) if content else b""
        yield from (bytes(content[a:b]) for a, b in zip(ends[:-1], ends[1:]))


_ENCODERS: dict[int, Encoder] = {}


def encoder(file_text: str) -> Encoder:
    """The encoder of this Python worker; its words outlive a task."""
    key = zlib.crc32(file_text.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(file_text)
    return _ENCODERS[key]


def write_token_files(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode every row and write the segments below ``path``.

    The order is ascending id, NULL first; rows of one id follow the hash of their text,
    equal rows are kept each. NULL and empty texts have the end id alone. An empty table
    writes no segment. Columns other than id and text are not read."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary

    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        from tablewright.llm.token_files import encoder as own_encoder

        part, before = TaskContext.get().partitionId(), 0
        encode = own_encoder(shared.value).encode
        ids, encoded, size = [], [], 0

        def segment():
            nonlocal before, ids, encoded, size
            data = encode_segment(ids, [len(e) // 4 for e in encoded], np.frombuffer(b"".join(encoded), "<u4"), part, before)
            before += size
            ids, encoded, size = [], [], 0
            return {"segment": pa.array([data], pa.binary())}

        for batch in pieces(batches, "text", ENCODED_BYTES):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc, data in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids.append(doc)
                encoded.append(data + end)
                size += len(encoded[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
        if ids:
            yield segment()

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    map_batches(dealt, run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def part_and_ids(data: memoryview) -> tuple[int, int]:
    """The part of a segment and its number of ids, from its header."""
    return HEADER.unpack_from(data)[2::3]


def segments_of(content: memoryview) -> Iterator[memoryview]:
    at = 0
    while at < len(content):
        size = HEADER.unpack_from(content, at)[1]
        yield content[at : at + size]
        at += size + 1  # the newline


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, from the files."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for data in segments_of(memoryview(content.as_buffer())):
                    part, start, docs, lengths, tokens = decode_segment(data)
                    ends = np.cumsum(lengths.astype(np.int64))
                    starts = ends - lengths
                    raw = memoryview(tokens.astype("<u4").tobytes())
                    out = {
                        "part": np.full(len(docs), part, np.int32), "doc_id": docs, "start": starts + start, "n_tokens": lengths.astype(np.int64),
                        "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], np.int64),
                    }
                    if with_ids:
                        offsets = np.append(starts, ends[-1:]).astype(np.int32)
                        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32)))
                    yield out

    schema = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    rows = map_batches(files, run, schema)

    def heads(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = [part_and_ids(data) for data in segments_of(memoryview(content.as_buffer()))]
                yield {"part": [p for p, _ in found], "n_tokens": [n for _, n in found]}

    # One total per part, that is per written partition: from the rows where these are small and
    # kept, so the files are read once, else from the headers alone.
    if with_ids:
        counted = map_batches(files, heads, "part int, n_tokens bigint")
    else:
        rows = counted = materialize(rows, "token-rows")
    totals = counted.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for r in totals:
        offsets.append((r["part"], total))
        total += r["n"]
    known = spark.createDataFrame(offsets, "part int, before bigint")
    return rows.join(F.broadcast(known), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens (with the end id), ids_crc32."""
    spark = docs.sparkSession
    path = path or work_path(spark, "token-ids")
    write_token_files(docs, path, tokenizer_file, end_id)
    return read_token_files(spark, path)
