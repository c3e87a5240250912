"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages (windows of ``2 * BLOCK`` words, one
every ``BLOCK``) of hashed words, weighted by inverse document frequencies counted over
all documents. Randomised singular value decompositions of the benchmark's passages (the
index), run by tasks over SPACE of them at a time, give latent spaces whose ranks follow
the passages, so that no item fades however large the benchmark is. Words that no item has
fall out of a space, so a passage that quotes or paraphrases an item lies close to it whatever stands
around. Every passage of every document is projected and compared with all benchmark
passages by cosine, in the task that reads the text, so no text is shuffled. A candidate
is verified on the words around it: longest common subsequence with the whole item, and
the item's last words (its answer).
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SPACES, Words, as_bytes, filter_batches, map_batches, pieces

FEATURES = 1 << 16
BLOCK = 16  # words
SPACE = 128  # benchmark passages of a latent space
ENERGY = 0.97  # share of the squares of its passages that a space keeps
COSINE = 0.75
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.5, 0.5
ITEM_BLOCK = 1000  # benchmark items searched for in one pass
PASS_BYTES = 500_000  # text of the items of a pass, about
REGION_WORDS = 500_000  # of candidates that are compared at once
# Words end at white space and at these marks, so a word is the same in any punctuation.
MARKS = b".,;:!?\"'()[]{}<>*#$%&|-_"


def splitter() -> Words:
    return Words(SPACES + MARKS)


def split(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the texts' bounds."""
    return words([t.lower() for t in texts])


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """idf of every feature over all documents; FEATURES sums reach the driver."""

    def run(batches):
        words, seen, texts = splitter(), np.zeros(FEATURES, np.int64), 0
        for batch in pieces(batches, "text"):
            hashes, bounds = split(words, as_bytes(batch.column("text")))
            of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            once = np.unique(of * FEATURES + features(hashes))
            seen += np.bincount(once % FEATURES, minlength=FEATURES)
            texts += batch.num_rows
        at = np.flatnonzero(seen)
        yield {"feature": np.append(at, -1).astype(np.int32), "n": np.append(seen[at], texts)}

    counts = np.zeros(FEATURES)
    total = 0
    parts = map_batches(docs.select(F.col(text_column).alias("text")), run, "feature int, n bigint")
    for r in parts.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r["feature"] < 0:
            total = r["n"]
        else:
            counts[r["feature"]] = r["n"]
    return np.log((total + 1) / (counts + 1)).astype(np.float32)


def block_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every block of BLOCK words of each text, and its text."""
    n = -(-np.diff(bounds) // BLOCK)
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return bounds[:-1][of] + inside * BLOCK, of


def _tfidf(found: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse unit vectors of the passages of a text."""
    out = []
    for start in range(0, max(1, len(found) - BLOCK), BLOCK):
        at, n = np.unique(found[start : start + 2 * BLOCK], return_counts=True)
        value = n * idf[at]
        length = np.linalg.norm(value)
        if length > 0:
            out.append((at, (value / length).astype(np.float32)))
    return out


@dataclass
class Space:
    place: np.ndarray  # row of each feature, -1 outside
    table: np.ndarray  # (row, rank): the directions, times idf
    targets: np.ndarray  # (passage, rank): unit vectors
    owner: np.ndarray  # item of each target


def randomised_svd(matrix: np.ndarray, energy: float, rng: np.random.Generator) -> np.ndarray:
    """Leading right singular vectors, as columns: as few as hold ``energy`` of the squares.

    The range of the matrix is found from random combinations of its columns, sharpened by
    two power iterations; twice as many are drawn while they hold too little."""
    n, total, drawn = min(matrix.shape), float((matrix**2).sum()), 16
    while True:
        drawn = min(n, drawn)
        basis = np.linalg.qr(matrix @ rng.normal(size=(matrix.shape[1], drawn)))[0]
        for _ in range(2):
            basis = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ basis)[0])[0]
        small = basis.T @ matrix
        if drawn == n or (small**2).sum() >= energy * total:
            break
        drawn *= 2
    _, size, directions = np.linalg.svd(small, full_matrices=False)
    rank = int(np.searchsorted(np.cumsum(size**2), energy * min(total, (size**2).sum()) * (1 - 1e-9))) + 1
    return directions[:rank].T


def latent_space(passages: list[tuple[np.ndarray, np.ndarray]], owner: list[int], idf: np.ndarray) -> Space:
    """The directions that hold ENERGY of ``passages`` (of ``_tfidf``)."""
    at = np.unique(np.concatenate([p for p, _ in passages]))
    matrix = np.zeros((len(passages), len(at)))
    for row, (p, value) in zip(matrix, passages):
        row[np.searchsorted(at, p)] = value
    basis = randomised_svd(matrix, ENERGY, np.random.default_rng(len(at)))
    targets = matrix @ basis
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-9)
    place = np.full(FEATURES, -1, np.int32)
    place[at] = np.arange(len(at))
    return Space(place, (basis * idf[at][:, None]).astype(np.float32), targets.astype(np.float32), np.array(owner))


def latent_spaces(items: DataFrame, idf: np.ndarray, n_items: int) -> list[tuple[Space, list[tuple[int, int]]]]:
    """Spaces of SPACE passages each, of rows (item_id, text, text_hash), and their items.

    Items are dealt to groups of about SPACE passages; a task decomposes the passages of
    its groups, and what is left of a group, its directions, reaches the driver."""
    groups = max(1, n_items * 2 // SPACE)
    weights = items.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        by_group: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by_group.setdefault(r["g"], []).append((r["item_id"], r["text_hash"], r["text"]))
        for g, rows in sorted(by_group.items()):
            rows.sort()
            hashes, bounds = split(splitter(), [t.encode() for _, _, t in rows])
            passages, owner = [], []
            for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
                mine = _tfidf(features(hashes[low:high]), weights.value)
                passages += mine
                owner += [k] * len(mine)
            for n in range(0, len(passages), SPACE):
                space = latent_space(passages[n : n + SPACE], owner[n : n + SPACE], weights.value)
                yield {"g": [g], "n": [n], "space": pa.array([pickle.dumps((space, [r[:2] for r in rows]))], pa.binary())}

    dealt = items.withColumn("g", F.pmod(F.xxhash64("text_hash"), F.lit(groups))).repartition(min(groups, 64), "g")
    rows = map_batches(dealt, run, "g bigint, n bigint, space binary").collect()
    weights.destroy()
    return [pickle.loads(r["space"]) for r in sorted(rows)]


@dataclass
class Item:
    item_id: int
    words: list[int]  # hashes
    counts: Counter
    answer: list[int]


def make_item(item_id: int, words: np.ndarray) -> Item:
    listed = words.tolist()
    return Item(item_id, listed, Counter(listed), listed[-max(1, len(listed) // 5) :])


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit per word of ``a``."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = places.get(w, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def judge(item: Item, region: list[int]) -> tuple[float, float] | None:
    """Shares of the item and of its answer found in order in ``region``, if it is a leak."""
    n = len(item.words)
    there = Counter(filter(item.counts.__contains__, region))
    if sum(min(k, item.counts[w]) for w, k in there.items()) < PARAPHRASE * n:
        return None
    share = common_subsequence(item.words, region) / n
    if share < PARAPHRASE:
        return None
    answer = common_subsequence(item.answer, region) / len(item.answer)
    return (share, answer) if share >= VERBATIM or answer >= ANSWER else None


class Searcher:
    """Projects passages and finds the benchmark items near them."""

    def __init__(self, spaces: list[Space], items: list[Item]):
        self.words, self.spaces, self.items = splitter(), spaces, items
        self.lengths = np.array([len(item.words) for item in items], np.int64)
        self.vocabulary = np.unique(np.concatenate([np.array(item.words, np.uint64) for item in items]))
        self.local = np.full(len(self.vocabulary) + 1, -1, np.int64)
        self.own = []  # of each item: places of its words in the vocabulary, how often each occurs
        for item in items:
            at, n = np.unique(np.searchsorted(self.vocabulary, np.array(item.words, np.uint64)), return_counts=True)
            self.own.append((at, n))

    def near(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and best cosine of each pair that reaches COSINE, ascending, and the
        passages' first words and texts. A text of one block is one passage."""
        starts, of = block_starts(bounds)
        pairs, values = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        follows = np.zeros(len(of), bool)  # a block with another of its text after it
        follows[:-1] = of[1:] == of[:-1]
        kept = follows | (np.bincount(of, minlength=len(bounds) - 1)[of] == 1)
        place = features(hashes)
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(place))))
        for space in self.spaces if len(starts) else ():
            rows = space.place[place]
            inside = rows >= 0
            sums = self._block_sums(space.table, rows[inside], block[inside], len(starts))
            passages = sums.copy()
            passages[:-1][follows[:-1]] += sums[1:][follows[:-1]]
            passages = passages[kept]
            length = np.linalg.norm(passages, axis=1, keepdims=True)
            np.divide(passages, length, out=passages, where=length > 1e-6)
            for at in range(0, len(passages), 4096):
                cosine = passages[at : at + 4096] @ space.targets.T
                window, target = np.nonzero(cosine >= COSINE)
                pairs.append((at + window) * len(self.items) + space.owner[target])
                values.append(cosine[window, target])
        pair, value = np.concatenate(pairs), np.concatenate(values)
        order = np.lexsort((-value, pair))
        pair, value = pair[order], value[order]
        best = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        pair = pair[best]
        return pair // max(1, len(self.items)), pair % max(1, len(self.items)), value[best], starts[kept], of[kept]

    @staticmethod
    def _block_sums(table: np.ndarray, rows: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
        """Sums of the table's rows of each block: blocks with as many rows together, and few
        of them at a time, which stay in the cache."""
        out = np.zeros((n, table.shape[1]), np.float32)
        count = np.bincount(block, minlength=n)
        first = np.cumsum(count) - count
        for size in range(1, BLOCK + 1):
            same = np.flatnonzero(count == size)
            step = max(1, 1024 // size)
            for at in range(0, len(same), step):
                mine = same[at : at + step]
                out[mine] = table[rows[first[mine][:, None] + np.arange(size)]].sum(axis=1)
        return out

    def _overlap(self, k: int, words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words of item ``k``, each as often as there, lie in the regions [first, end)
        of ``words`` (places in the vocabulary of all items)."""
        own, counts = self.own[k]
        self.local[own] = np.arange(len(own))
        out = np.empty(len(first), np.int64)
        longest = int((end - first).max())
        step = max(1, REGION_WORDS // longest)
        for at in range(0, len(first), step):
            low, high = first[at : at + step, None], end[at : at + step, None]
            place = low + np.arange(longest)
            word = self.local[words[np.minimum(place, len(words) - 1)]]
            word[place >= high] = len(own)
            word[word < 0] = len(own)
            row = np.arange(len(low))[:, None] * (len(own) + 1)
            there = np.bincount((row + word).ravel(), minlength=len(low) * (len(own) + 1)).reshape(len(low), -1)
            out[at : at + step] = np.minimum(there[:, :-1], counts).sum(axis=1)
        self.local[own] = -1
        return out

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, int, int, float, float, float]]]:
        """Per text (item, first word, end word, cosine, share, answer share), the best per
        item."""
        out: list[list] = [[] for _ in texts]
        hashes, bounds = split(self.words, texts)
        window, item, value, starts, of = self.near(hashes, bounds)
        if not len(window):
            return out
        text = of[window]
        first = np.maximum(bounds[text], starts[window] - self.lengths[item])
        end = np.minimum(bounds[text + 1], starts[window] + 2 * BLOCK + self.lengths[item])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        words = np.where(self.vocabulary[place] == hashes, place, len(self.vocabulary))
        # Most candidates have too few of the item's words, so they are told apart together.
        enough = np.zeros(len(item), bool)
        order = np.argsort(item, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            k = int(item[mine[0]])
            enough[mine] = self._overlap(k, words, first[mine], end[mine]) >= PARAPHRASE * self.lengths[k]
        found: dict[tuple[int, int], tuple] = {}
        for n in np.flatnonzero(enough).tolist():
            k, t, low, high = int(item[n]), int(text[n]), int(first[n]), int(end[n])
            got = judge(self.items[k], hashes[low:high].tolist())
            if got and got > found.get((t, k), (0,) * 6)[4:]:
                begin = int(bounds[t])
                found[t, k] = (self.items[k].item_id, low - begin, high - begin, float(value[n]), *got)
        for (t, _), leak in sorted(found.items()):
            out[t].append(leak)
        return out


LEAKS = "doc_id bigint, item_id bigint, first_word int, end_word int, cosine double, common double, answer double"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it: where (words), the cosine, and
    the shares of the item's words and of its last fifth that occur there in order.

    An item is found if VERBATIM of its words occur, or PARAPHRASE of them with ANSWER of
    its last words. Items and documents that are NULL, empty or without words have no
    leaks. Rows of one id are searched each and reported once; a NULL id is reported as
    one. Empty tables give an empty one. Other columns are not read."""
    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    found = None
    for shared in _searchers(own, benchmark, item_column, item_text):
        def run(batches, shared=shared):
            searcher = Searcher(*shared.value)
            for batch in pieces(batches, "text"):
                leaks = searcher.leaks(as_bytes(batch.column("text")))
                rows = [(doc, *leak) for doc, found in zip(batch.column("doc_id").to_pylist(), leaks) for leak in found]
                names = ("doc_id", "item_id", "first_word", "end_word", "cosine", "common", "answer")
                yield dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        part = map_batches(own, run, LEAKS)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], LEAKS)
    best = F.max(F.struct("common", "answer", "cosine", "first_word", "end_word")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.first_word", "m.end_word", "m.cosine", "m.common", "m.answer",
    )


def _searchers(own: DataFrame, benchmark: DataFrame, item_column: str, item_text: str):
    """Broadcast (spaces, items), one for each ITEM_BLOCK or PASS_BYTES of the benchmark."""
    spark = own.sparkSession
    items = benchmark.select(F.col(item_column).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    idf = document_frequencies(own)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["b"] // PASS_BYTES))
    hashed = items.withColumn("text_hash", F.xxhash64("item_id", "text"))
    block = F.pmod(F.col("text_hash"), F.lit(passes))
    for n in sorted(r["b"] for r in hashed.select(block.alias("b")).distinct().collect()):
        mine = hashed.where(block == n)
        rows = sorted((r["item_id"], r["text_hash"], r["text"].encode()) for r in mine.collect())
        hashes, bounds = split(splitter(), [t for _, _, t in rows])
        made = {(i, h): make_item(i, hashes[a:b]) for (i, h, _), a, b in zip(rows, bounds[:-1], bounds[1:]) if b > a}
        if made:
            place = {key: k for k, key in enumerate(made)}
            spaces = []
            for space, owners in latent_spaces(mine, idf, len(rows)):
                space.owner = np.array([place[owners[k]] for k in space.owner])
                spaces.append(space)
            yield spark.sparkContext.broadcast((spaces, list(made.values())))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, all columns as they are."""
    kept = docs
    for shared in _searchers(docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")), benchmark, "item_id", "text"):
        def run(batches, shared=shared):
            searcher = Searcher(*shared.value)
            for batch in pieces(batches, text_column):
                good = batch.filter(pa.array([not found for found in searcher.leaks(as_bytes(batch.column(text_column)))], pa.bool_()))
                if good.num_rows:
                    yield good

        kept = filter_batches(kept, run)
    return kept
