"""Quality rules: fixed counts of a text, then a likelihood ratio of hashed n-grams.

Words and word pairs are hashed into buckets. Two multinomials are counted over the whole
corpus: all documents (raw) and all trusted ones (target), for which each text is shuffled
once, to the trusted ids. A document's score is the mean log ratio of its n-grams; it is
kept if the score reaches the highest threshold that the share KEPT of the trusted
documents reach.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SPACES, Words, as_bytes, map_batches, mixed, pieces, window_hashes
from tablewright.storage import materialize

BUCKETS = 1 << 16
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
KEPT = 0.985  # share of the trusted documents that reach the threshold, at least
STEP = 1e-4  # of the scores that are counted for the threshold
STATS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean"
)


def grams(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and of each pair of neighbours within a text."""
    single, pair = mixed(hashes), window_hashes(hashes, 2)
    if len(pair):
        inside = np.ones(len(pair), bool)
        cut = bounds[1:-1]
        inside[cut[(cut > 0) & (cut < len(hashes))] - 1] = False
        pair = pair[inside]
    return (single >> np.uint64(48)).astype(np.int64), (pair >> np.uint64(48)).astype(np.int64)


def trusted_sample(trusted: DataFrame, bound: int, id_column: str = "doc_id") -> np.ndarray:
    """At most ``bound`` distinct ids, the first by a hash of the id, ascending."""
    ids = trusted.select(F.col(id_column).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    first = ids.orderBy(F.xxhash64("id"), "id").limit(bound).collect()
    return np.sort(np.array([r["id"] for r in first], np.int64))


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``trusted``: whether the doc_id, if any, is among the distinct ``ids``.

    The ids of a partition are a hash table, at any size: texts are shuffled, never sorted."""
    found = ids.withColumn("trusted", F.lit(True)).hint("shuffle_hash")
    known = docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return known.unionByName(docs.where("doc_id IS NULL").withColumn("trusted", F.lit(False)))


def count_grams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the trusted documents and in all, of rows of text and
    trusted.

    Tasks count into vectors; 2 * BUCKETS sums reach the driver."""

    def run(batches):
        words, sums = Words(), np.zeros((2, BUCKETS), np.int64)
        for batch in pieces(batches, "text"):
            hashes, bounds = words(as_bytes(batch.column("text")))
            single, pair = grams(hashes, bounds)
            of_single = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            of_pair = of_single[1:][of_single[1:] == of_single[:-1]]
            known = batch.column("trusted").to_numpy(zero_copy_only=False)
            for buckets, of in ((single, of_single), (pair, of_pair)):
                sums[0] += np.bincount(buckets[known[of]], minlength=BUCKETS)
                sums[1] += np.bincount(buckets, minlength=BUCKETS)
        at, bucket = np.nonzero(sums)
        yield {"k": at.astype(np.int32), "bucket": bucket.astype(np.int32), "n": sums[at, bucket]}

    out = np.zeros((2, BUCKETS))
    for r in map_batches(docs, run, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r["k"], r["bucket"]] = r["n"]
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), each with one added per bucket."""
    return (np.log(target + 1) - np.log((target + 1).sum()) - np.log(raw + 1) + np.log((raw + 1).sum())).astype(np.float32)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values, each by itself, so that no other text matters."""
    out, some = np.zeros(len(counts)), counts > 0
    if some.any():
        starts = np.append(0, np.cumsum(counts)[:-1])[some]
        out[some] = np.add.reduceat(values.astype(np.float64), starts)
    return out


def text_stats(text: bytes, hashed: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = text.translate(None, SPACES)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = window_hashes(hashed, WINDOW)
    repeated = 0
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            again = np.zeros(len(windows), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            cover = np.zeros(len(hashed) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int((np.cumsum(cover) > 0).sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def score_rules(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The counts, ``base_failed`` and the mean log ratio (``score``; 0 without words) of
    rows of doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches):
        words, table = Words(), shared.value
        for batch in pieces(batches, "text"):
            rows, texts = [], as_bytes(batch.column("text"))
            hashes, bounds = words(texts)
            single, pair = grams(hashes, bounds)
            count = np.diff(bounds)
            pairs = np.maximum(count - 1, 0)
            total = _sums(table[single], count) + _sums(table[pair], pairs)
            means = total / np.maximum(count + pairs, 1)
            for text, a, b, score in zip(texts, bounds[:-1], bounds[1:], means):
                n = int(b - a)
                chars, symbols, dup, repeat = text_stats(text, hashes[a:b])
                rows.append((n, chars, symbols, dup, repeat, n < 20 or 100 * repeat > 30 * n, float(score)))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
            yield {"doc_id": batch.column("doc_id"), **dict(zip(names, map(list, zip(*rows))))}

    return map_batches(docs, run, STATS + ", score double")


def least_score(scores: DataFrame) -> float:
    """The highest threshold that KEPT of the scores reach, up to STEP; -inf without any.

    One row per STEP of the scores reaches the driver."""
    steps = scores.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    rows = sorted(steps.collect(), reverse=True)
    reached, total = 0, sum(r["n"] for r in rows)
    for r in rows:
        reached += r["n"]
        if reached >= KEPT * total:
            return r["least"]
    return float("-inf")


def quality_rules(
    docs: DataFrame, trusted: DataFrame, bound: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Counts, ``score``, ``threshold``, ``base_failed`` and ``kept`` per row of ``docs``.

    ``trusted`` holds the ids of the target corpus, all of which are used, or at most ``bound``;
    without any, no document fails by its score. A NULL or empty text has no words and
    fails the base rule. Rows of one id are scored each by its own text; a NULL id is never
    trusted. An empty table gives an empty one. Columns of ``docs`` other than id and text
    are not read."""
    frame = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    if bound is None:
        ids = trusted.select(F.col(id_column).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    else:
        ids = docs.sparkSession.createDataFrame([(int(i),) for i in trusted_sample(trusted, bound, id_column)], "doc_id bigint")
    ids = materialize(ids, "trusted-ids")
    target, raw = count_grams(marked(frame, ids).select("text", "trusted"))
    scored = materialize(score_rules(frame, log_ratio(target, raw)), "rule-scores")
    of_trusted = scored.where("NOT base_failed").select("doc_id", "score").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    least = least_score(of_trusted)
    return scored.withColumns({
        "threshold": F.lit(least),
        "kept": ~F.col("base_failed") & (F.col("score") >= F.lit(least)),
    })
