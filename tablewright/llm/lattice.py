"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary weigh every segmentation of a word, and a word's
probability is the sum over all of them, by a forward recursion in log space. No piece
crosses a word, so a document's log probability is the sum over its words and its end,
and the recursion runs once per distinct word of the corpus, as a Spark job.

Training counts every word of the training documents. One expectation step spreads each
word's count over the pieces of its segmentations under the vocabulary's own scores; the
pieces' probabilities are these expected counts, smoothed by the scores.

Scoring looks up the most frequent words (a bounded table, broadcast) in the task that
reads the text; the other words are joined with the table of words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import as_bytes, map_batches, mixed, pieces
from tablewright.storage import discard, materialize

FREQUENT = 300_000  # words broadcast; the rest is joined
FLUSH = 400_000  # distinct words a task counts before it hands them on
PRIOR = 1000.0  # weight of the vocabulary's scores against expected counts
WORD_START = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 21


@dataclass
class Vocabulary:
    """Pieces that may occur in a text, their log probabilities, and single bytes."""

    pieces: list[str]
    log_p: np.ndarray  # natural logs; the bytes follow the pieces

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        """From a sentencepiece model with byte pieces. Scores that are log probabilities
        are taken as they are; others (ranks) order the pieces, and a piece weighs one
        over its rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        rest = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in rest])
        if not 0.5 < np.exp(scores).sum() < 2:
            rank = np.empty(len(rest))
            rank[np.argsort(-scores, kind="stable")] = np.arange(len(rest))
            scores = -np.log(rank + 3)
        p = np.exp(scores)
        p = np.concatenate([p / p.sum() * 0.999, np.full(256, 0.001 / 256)])
        return Vocabulary([model.id_to_piece(i) for i in rest], np.log(p))


class Lattice:
    """Sums over all segmentations of many words at once, by their length."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray):
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64) for p in vocabulary.pieces]
        self.longest = max(map(len, codes))
        self.log_p = log_p
        self.n_pieces = len(codes)
        hashes = np.zeros(len(codes), np.uint64)
        for i, code in enumerate(codes):
            h = np.array([len(code)], np.uint64)
            for c in code:
                h = h * BASE + c + np.uint64(1)
            hashes[i] = h[0]
        self.hashes = np.append(hashes, np.uint64(0))
        slot = self.slot(hashes)
        # Two levels of slots; a third piece on one slot goes to a small exact table.
        self.first, self.second, self.more = np.full(SLOTS, -1, np.int32), np.full(SLOTS, -1, np.int32), {}
        for i, s in enumerate(slot):
            if self.first[s] < 0:
                self.first[s] = i
            elif self.second[s] < 0:
                self.second[s] = i
            else:
                self.more[int(hashes[i])] = i
        self.single = {int(c[0]) for c in codes if len(c) == 1}

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (mixed(hashes) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        slot = self.slot(hashes)
        out = self.first[slot]
        miss = self.hashes[out] != hashes
        out[miss] = -1
        if miss.any():
            again = self.second[slot[miss]]
            again[self.hashes[again] != hashes[miss]] = -1
            out[miss] = again
        if self.more:
            for h, i in self.more.items():
                out[hashes == np.uint64(h)] = i
        return out

    def edges(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece length from 1: piece ids and log weights of all starts of words
        of one length (a row each). A character that no piece holds is spelt in bytes:
        id -1 with their weight."""
        n, length = chars.shape
        out = []
        for k in range(1, min(self.longest, length) + 1):
            h = np.full((n, length - k + 1), k, np.uint64)
            for j in range(k):
                h = h * BASE + chars[:, j : length - k + 1 + j] + np.uint64(1)
            ids = self.find(h.ravel()).reshape(h.shape)
            logs = np.where(ids >= 0, self.log_p[ids], -np.inf)
            if k == 1:
                for row, at in zip(*np.nonzero(ids < 0)):
                    spelt = chr(int(chars[row, at])).encode("utf-8", "surrogatepass")
                    logs[row, at] = sum(self.log_p[self.n_pieces + b] for b in spelt)
            out.append((ids, logs))
        return out

    @staticmethod
    def _forward(logs: list[np.ndarray], n: int, length: int) -> np.ndarray:
        total = np.full((length + 1, n), -np.inf)
        total[0] = 0.0
        for end in range(1, length + 1):
            for k in range(1, min(len(logs), end) + 1):
                total[end] = np.logaddexp(total[end], total[end - k] + logs[k - 1][:, end - k])
        return total

    def marginals(self, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each word; expected counts of the pieces (and bytes)
        if ``counts`` weighs the words."""
        result, expected = np.empty(len(words)), np.zeros(self.n_pieces + 256)
        marked = [WORD_START + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            length = int(lengths[group[0]])
            step = max(1, 400_000 // length)
            for at in range(0, len(group), step):
                some = group[at : at + step]
                text = "".join([marked[i] for i in some]).encode("utf-32-le", "surrogatepass")
                chars = np.frombuffer(text, np.uint32).reshape(len(some), length).astype(np.uint64)
                found = self.edges(chars)
                logs = [x for _, x in found]
                total = self._forward(logs, len(some), length)
                result[some] = total[length]
                if counts is None:
                    continue
                back = np.full((length + 1, len(some)), -np.inf)
                back[length] = 0.0
                weight = np.log(counts[some]) - total[length]
                for start in range(length - 1, -1, -1):
                    for k in range(1, min(len(logs), length - start) + 1):
                        ids, x = found[k - 1][0][:, start], logs[k - 1][:, start]
                        through = x + back[start + k]
                        back[start] = np.logaddexp(back[start], through)
                        share = np.exp(total[start] + through + weight)
                        real = ids >= 0
                        np.add.at(expected, ids[real], share[real])
                        if k == 1 and not real.all():
                            for row in np.flatnonzero(~real):
                                for b in chr(int(chars[row, start])).encode("utf-8", "surrogatepass"):
                                    expected[self.n_pieces + b] += share[row]
        return result, expected


def word_counts(docs: DataFrame, train_column: str, text_column: str = "text") -> DataFrame:
    """Every word of the corpus with its count ``n`` in training documents (0 if it occurs
    in others only)."""

    def run(batches):
        train, other = Counter(), set()

        def flush():
            rest = other - train.keys()
            words = [*train, *rest]
            return {"word": pa.array(words, pa.binary()).cast(pa.string()), "n": [*train.values(), *[0] * len(rest)]}

        for batch in pieces(batches, "text"):
            for text, learn in zip(as_bytes(batch.column("text")), batch.column("train").to_pylist()):
                if learn:
                    train.update(text.lower().split())
                else:
                    other.update(text.lower().split())
            if len(train) + len(other) > FLUSH:
                yield flush()
                train, other = Counter(), set()
        yield flush()

    rows = docs.select(F.col(text_column).alias("text"), F.col(train_column).alias("train"))
    return map_batches(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, vocabulary: Vocabulary, documents: int) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, from one expectation step over all
    training words. One sum per piece reaches the driver."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        lattice = Lattice(shared.value, shared.value.log_p)
        sums = np.zeros(lattice.n_pieces + 256)
        for batch in batches:
            if batch.num_rows:
                counts = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
                sums += lattice.marginals(batch.column("word").to_pylist(), counts)[1]
        at = np.flatnonzero(sums)
        yield {"piece": at.astype(np.int32), "x": sums[at]}

    expected = np.zeros(len(vocabulary.log_p))
    parts = map_batches(words.where("n > 0").select("word", "n"), run, "piece int, x double")
    for r in parts.groupBy("piece").agg(F.sum("x").alias("x")).collect():
        expected[r["piece"]] = r["x"]
    total = expected.sum() + PRIOR
    end = (documents + 1) / (total + documents + 1)
    return np.log((expected + PRIOR * np.exp(vocabulary.log_p)) / total * (1 - end)), math.log(end)


def word_scores(words: DataFrame, vocabulary: Vocabulary, log_p: np.ndarray) -> DataFrame:
    """Adds ``lm``, the log10 marginal probability of each word."""
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, log_p))

    def run(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            if batch.num_rows:
                logs, _ = lattice.marginals(batch.column("word").to_pylist())
                yield {"word": batch.column("word"), "n": batch.column("n"), "lm": logs / math.log(10)}

    return map_batches(words.select("word", "n"), run, "word string, n bigint, lm double")


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words with the highest counts, ``most`` at the most, cut at an eighth of a
    power of two: the counts' histogram (a few hundred rows) gives the bound."""
    level = F.floor(F.log2("n") * 8).cast("int")
    seen, least = 0, None
    for r in words.where("n > 0").groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        seen += r["count"]
        if seen > most:
            break
        least = r["level"]
    return words.where(F.lit(least is not None) & (F.col("n") > 0) & (level >= F.lit(least or 0)))


PARTS = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, seen double, lm double, rare array<struct<word: string, n: bigint>>"


def score_documents(
    docs: DataFrame, model_file: str, train_column: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row.

    ``train_column`` is true for documents to learn from (NULL: false). Words are split at
    white space, A-Z lower-cased; an end follows each document. base_score is the word
    unigram with one added; score the log10 marginal probability of words and end in the
    lattice. A NULL or empty text is the end alone. Without training documents the
    vocabulary's own scores count. Rows of one id are scored each; an empty table gives an
    empty one; other columns are not read."""
    spark = docs.sparkSession
    train = F.coalesce(F.col(train_column), F.lit(False))
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), train.alias("train"))
    vocabulary = Vocabulary.load(model_file)
    counted = materialize(word_counts(rows, "train"), "words")
    documents = rows.where("train").count()
    log_p, log_end = fit_pieces(counted, vocabulary, documents)
    words = materialize(word_scores(counted, vocabulary, log_p), "word-scores")
    discard(counted)
    sums = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_train, distinct = (sums["n"] or 0) + documents, sums["v"] + (documents > 0)
    table = spark.sparkContext.broadcast({
        word.encode(): (math.log10(n + 1), lm) for word, n, lm in _frequent(words, FREQUENT).select("word", "n", "lm").collect()
    })

    def run(batches):
        from pyspark import TaskContext

        known = table.value
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text"):
            out = []
            for text in as_bytes(batch.column("text")):
                tokens = text.lower().split()
                n, seen, lm, rare = 0, 0.0, 0.0, []
                for word, times in Counter(tokens).items():
                    got = known.get(word)
                    if got is None:
                        rare.append({"word": word.decode(), "n": times})
                    else:
                        n += times
                        seen += times * got[0]
                        lm += times * got[1]
                out.append((row, len(tokens) + 1, n, seen, lm, rare))
                row += 1
            names = ("row", "n_tokens", "known", "seen", "lm", "rare")
            held = [not t for t in batch.column("train").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "held_out": held, **dict(zip(names, map(list, zip(*out))))}

    # Written once: the row numbers stay as they are, whatever is run again.
    parts = materialize(map_batches(rows, run, PARTS), "lm-parts")
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    sums = (
        rare.join(words, "word").groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
            F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_seen"),
            F.sum(F.col("times") * F.col("lm")).alias("more_lm"),
        )
    )
    end_known = int(documents > 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + zero("more") + end_known).cast("bigint").alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("seen") + zero("more_seen") + math.log10(documents + 1) - F.col("n_tokens") * math.log10(n_train + distinct + 1)).alias("base_score"),
        (F.col("lm") + zero("more_lm") + log_end / math.log(10)).alias("score"),
    )


def lm_scores(spark: SparkSession, docs: DataFrame, model_file: str) -> DataFrame:
    """``score_documents`` with crc32(id as text) mod 7 = 2 held out."""
    from tablewright.llm.common import remainder

    return score_documents(docs.withColumn("_train", F.coalesce(remainder("doc_id", 7) != 2, F.lit(False))), model_file, "_train")
