"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Every word is two units, hashed: the word and its shape (``Word,`` is ``Xx,``). A unit has
a sparse random index vector; its context vector is the sum of the index vectors of the
units beside it, over the whole corpus. A document's features are mean and spread of the
context vectors and the mean of the index vectors of its units. The network is fitted in
numpy on a bounded sample of labelled rows and its logits are divided by a temperature
chosen on a part of the sample that the fit leaves out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WORD_CACHE, as_bytes, filter_batches, map_batches, pieces

UNITS, DIMS, NONZERO = 8192, 64, 2
CHUNKS = 256
SAMPLE = 20_000  # labelled rows that the network is fitted on, the first by a hash of the id
HIDDEN, EPOCHS, STEPS, BATCH, RATE, DECAY = 32, 40, 800, 256, 3e-3, 1e-4  # STEPS: at least
THRESHOLD = 0.3
_RUNS = re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes(
    ord("x") if 97 <= b <= 122 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b
    for b in range(256)
)


def index_vectors(seed: int = 0) -> np.ndarray:
    """(UNITS, NONZERO, 2): dimension and sign of the non-zero entries."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, DIMS, (UNITS, NONZERO)), rng.choice([-1, 1], (UNITS, NONZERO))], axis=2)


class Units(dict):
    """Both units of a word as one number: word * UNITS + shape."""

    def __missing__(self, word: bytes) -> int:
        import zlib

        if len(self) >= WORD_CACHE:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))
        half = UNITS // 2
        value = self[word] = (zlib.crc32(word) % half) * UNITS + half + zlib.crc32(shape) % half
        return value

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return both // UNITS, both % UNITS


def _dense(index: np.ndarray) -> np.ndarray:
    out = np.zeros((UNITS, DIMS), np.float32)
    np.add.at(out, (np.arange(UNITS)[:, None], index[:, :, 0]), index[:, :, 1])
    return out


def context_vectors(docs: DataFrame, index: np.ndarray, text_column: str = "text") -> np.ndarray:
    """Sum of the neighbours' index vectors for every unit, over all documents.

    A task adds up its own; the sums go in CHUNKS blocks, are added per block in two
    steps, and CHUNKS blocks (UNITS x DIMS numbers) reach the driver. They are whole
    numbers, so their order does not matter."""
    size = UNITS * DIMS // CHUNKS

    def blocks(sums: np.ndarray, chunk: np.ndarray, part: int):
        used = [k for k in range(len(chunk)) if sums[k].any()]
        return {
            "chunk": chunk[used].astype(np.int32), "part": np.full(len(used), part, np.int32),
            "block": pa.array([sums[k].astype("<f8").tobytes() for k in used], pa.binary()),
        }

    def count(batches):
        from pyspark import TaskContext

        units, sums = Units(), np.zeros(UNITS * DIMS)
        at, sign = index[:, :, 0], index[:, :, 1]
        for batch in pieces(batches, "text"):
            pairs = []
            for text in as_bytes(batch.column("text")):
                word, shape = units.of(text)
                if len(word) > 1:
                    pairs.append(np.stack([word[:-1], shape[:-1], word[1:], shape[1:]]))
            if not pairs:
                continue
            left_word, left_shape, right_word, right_shape = np.concatenate(pairs, axis=1)
            for target in ((left_word, right_word), (left_word, right_shape), (left_shape, right_word), (left_shape, right_shape)):
                for a, b in (target, target[::-1]):
                    for k in range(NONZERO):
                        sums += np.bincount(a * DIMS + at[b, k], sign[b, k], UNITS * DIMS)
        yield blocks(sums.reshape(CHUNKS, size), np.arange(CHUNKS), TaskContext.get().partitionId() % 64)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, block in zip(batch.column("chunk").to_pylist(), batch.column("block")):
                got = np.frombuffer(block.as_buffer(), "<f8")
                total[chunk] = total[chunk] + got if chunk in total else got
        if total:
            keys = np.array(sorted(total))
            yield blocks(np.stack([total[k] for k in keys]), keys, 0)

    schema = "chunk int, part int, block binary"
    parts = map_batches(docs.select(F.col(text_column).alias("text")), count, schema)
    parts = map_batches(parts.repartition("chunk", "part"), add, schema)
    out = np.zeros((CHUNKS, size))
    for r in map_batches(parts.repartition("chunk"), add, schema).collect():
        out[r["chunk"]] += np.frombuffer(r["block"], "<f8")
    return out.reshape(UNITS, DIMS)


def unit_table(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Context vectors of length one beside the index vectors: (UNITS, 2 * DIMS)."""
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return np.concatenate([context / np.maximum(length, 1e-9), _dense(index)], axis=1).astype(np.float32)


def features(text: bytes, units: Units, table: np.ndarray) -> np.ndarray:
    """Means over words and over shapes of both vectors, spread of the words' context
    vectors; zeros without words."""
    word, shape = units.of(text)
    if not len(word):
        return np.zeros(5 * DIMS, np.float32)
    by_word, n = np.bincount(word, minlength=UNITS), len(word)
    by_shape = np.bincount(shape, minlength=UNITS)
    w, s = np.flatnonzero(by_word), np.flatnonzero(by_shape)
    mean_word = by_word[w] @ table[w] / n
    mean_shape = by_shape[s] @ table[s] / n
    square = by_word[w] @ table[w, :DIMS] ** 2 / n
    spread = np.sqrt(np.maximum(square - mean_word[:DIMS] ** 2, 0))
    return np.concatenate([mean_word, mean_shape, spread]).astype(np.float32)


@dataclass
class Network:
    """Standardised features, a tanh layer, a logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logit(x) / self.temperature).clip(-500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Adam on the log loss; a fifth of the rows chooses the temperature. Without both
    labels the answer is their share (0.5 without rows)."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        share = 0.5 if n == 0 else min(max(float(y.mean()), 0.01), 0.99)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(n)
    tune, train = order[: n // 5], order[n // 5 :]
    net = Network(x[train].mean(0, dtype=np.float64), x[train].std(0, dtype=np.float64) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    state = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.zeros(1)) for _ in (0, 1)]
    inputs = (x - net.mean.astype(x.dtype)) / net.scale.astype(x.dtype)
    np.clip(inputs, -8, 8, out=inputs)
    step = 0
    for _ in range(max(EPOCHS, STEPS // -(-len(train) // BATCH))):
        shuffled = rng.permutation(train)
        for at in range(0, len(shuffled), BATCH):
            some = shuffled[at : at + BATCH]
            a, t = inputs[some].astype(np.float64), y[some]
            hidden = np.tanh(a @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2).clip(-500, 500)))
            g = (p - t) / len(some)
            back = np.outer(g, net.w2) * (1 - hidden**2)
            grads = [a.T @ back + DECAY * net.w1, back.sum(0), hidden.T @ g + DECAY * net.w2, np.array([g.sum()])]
            step += 1
            moves = []
            for k, grad in enumerate(grads):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
                state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * grad**2
                moves.append(RATE * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    if len(tune):
        z, t = net.logit(x[tune]), y[tune]
        loss = lambda h: np.logaddexp(0, -z / h * (2 * t - 1)).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, Network]:
    """Unit table (from all documents) and network (from ``labels``: id, label 0/1)."""
    spark = docs.sparkSession
    index = index_vectors()
    table = unit_table(context_vectors(docs, index, text_column), index)
    shared = spark.sparkContext.broadcast(table)  # UNITS x 2 DIMS numbers
    known = labels.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    # At most SAMPLE rows, so the broadcast has a bound.
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        units = Units()
        for batch in pieces(batches, "text"):
            blocks = [features(t, units, shared.value).tobytes() for t in as_bytes(batch.column("text"))]
            yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array(blocks, pa.binary())}

    # One row per id, so that repeated ids do not add to the sample.
    found = map_batches(rows, run, "doc_id bigint, label int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("m"))
    got = sorted((r["doc_id"], r["m"]["x"], r["m"]["label"]) for r in found.collect())
    shared.destroy()
    x, y = np.empty((len(got), 5 * DIMS), np.float32), np.array([r[2] for r in got], np.float64)
    for row, (_, block, _) in zip(x, got):
        row[:] = np.frombuffer(block, np.float32)
    del got
    return table, fit_network(x, y)


def score(
    docs: DataFrame, table: np.ndarray, net: Network, keep: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, score and predicted (score >= THRESHOLD) of every row, after the columns
    ``keep``. A NULL or empty text has features of zero and a score like any other; rows
    of one id are scored each by its own text; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((table, net))

    def run(batches):
        units, (vectors, network) = Units(), shared.value
        for batch in pieces(batches, "text"):
            x = np.stack([features(t, units, vectors) for t in as_bytes(batch.column("text"))]).astype(np.float64)
            p = network.score(x)
            yield {**{c: batch.column(c) for c in keep}, "doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

    rows = docs.select(*keep, F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows, run, (kinds + ", " if kinds else "") + "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, table: np.ndarray, net: Network, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted 1, all columns as they are.

    Text goes through the scorer and back only as its row's verdict: the rows are filtered
    in the task that scores them."""
    shared = docs.sparkSession.sparkContext.broadcast((table, net))

    def run(batches):
        units, (vectors, network) = Units(), shared.value
        for batch in pieces(batches, text_column):
            x = np.stack([features(t, units, vectors) for t in as_bytes(batch.column(text_column))]).astype(np.float64)
            good = batch.filter(pa.array(network.score(x) >= THRESHOLD))
            if good.num_rows:
                yield good

    return filter_batches(docs, run)
