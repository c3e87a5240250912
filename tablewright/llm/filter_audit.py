"""Filter interaction audit: what five filters remove in each order they may run in.

A document has a mask of the filters it fails. Four are settled by its own text, the fifth
(a smaller id has the same text) by radix tries. The texts are cut into ranges by adaptive
prefixes: between two neighbours of a sorted sample, the shortest prefix that tells them
apart. A task first inserts its own documents into a compressed trie with the least id at
each terminal and settles all but the least of each text; what is left, one row per text
and task, moves to its range, where the range's trie holds the least id of all. So a group
of copies crosses the shuffle once per task, however large it is. The masks are then
reduced to counts, which give every order.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SPACES, as_bytes, map_batches, pieces

FILTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
LEAST_WORDS = 200
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
TRIE_BYTES = 48_000_000  # text that a task's own trie holds before it is emptied
RANGE_BYTES = 32_000_000  # text of a range, about
SAMPLED = 16  # sampled texts per range
ROWS = "range int, doc_id bigint, part string, mask int, n bigint, text binary"


class Node:
    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.least = None  # of the texts that end here


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTrie:
    """Texts by their bytes, an edge per run that no text leaves; terminals hold the least key."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, key) -> Node:
        """The terminal of ``text``, after ``key`` came to it."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
            elif not text.startswith(child.label, at):
                k = common(child.label, text, at)
                fork = node.children[text[at]] = Node(child.label[:k])
                fork.children[child.label[k]] = child
                child.label = child.label[k:]
                child = fork
            node, at = child, at + len(child.label)
        if node.least is None or key < node.least:
            node.least = key
        return node


def own_failures(text: bytes, points: int) -> int:
    """Mask of the filters that the text alone decides; ``points``: its code points."""
    words = text.split()
    return (
        A * (len(words) < LEAST_WORDS)
        | B * (100 * len(set(words)) < 50 * len(words))
        | C * (100 * (len(text) - len(text.translate(None, UPPER))) > 2 * points)
        | D * (len(text) != len(text.translate(None, SYMBOLS)))
    )


def text_bounds(docs: DataFrame, text_column: str = "text") -> list[bytes]:
    """Ascending prefixes that begin the second and further ranges.

    Ranges follow the bytes of the table and the shuffle partitions. The sample is the texts
    whose hash is a multiple of a step, each once, so a group of copies counts as one; cuts
    grow while neighbours in the sample are equal as far as cut."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // RANGE_BYTES)
    step, cut = max(1, n // (ranges * SAMPLED)), 64
    while True:
        sample = docs.select(F.xxhash64(text).alias("h"), F.substring(text, 1, cut).alias("cut"), (F.length(text) > cut).alias("more"))
        rows = sample.where(F.pmod("h", F.lit(step)) == 0).distinct().collect()  # SAMPLED per range, about
        texts = sorted((r["cut"].encode(), r["more"]) for r in rows)
        blurred = sum(a[0] == b[0] and a[1] and b[1] for a, b in itertools.pairwise(texts))
        if blurred * ranges <= len(texts):
            break
        cut *= 16
    bounds = set()
    for k in range(1, ranges):
        at = k * len(texts) // ranges
        if at and texts[at - 1][0] != texts[at][0]:
            bounds.add(texts[at][0][: common(texts[at - 1][0], texts[at][0], 0) + 1])
    return sorted(bounds)


def failure_masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """doc_id, part, mask, n: the mask of ``docs``' rows, n rows alike.

    Bit k is set if the row fails filter FILTERS[k]. A NULL text is empty, a NULL part is
    the empty string. A NULL id counts as larger than all others; rows that repeat an id
    and its text do not make each other fail. An empty table gives none. Other columns are
    not read."""
    frame = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"), F.col(text_column).alias("text"))
    bounds = text_bounds(frame)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)  # fewer than the ranges
    key = lambda doc: (doc is None, doc or 0)

    def own(batches):
        cuts = shared.value
        trie, rows, held = RadixTrie(), [], 0

        def settled():
            out: dict[str, list] = {k: [] for k in ("range", "doc_id", "part", "mask", "n", "text")}
            first: dict[tuple, list] = {}  # the rows of a text's least id, by part

            def emit(place, doc, part, mask, n, text):
                for name, value in zip(out, (place, doc, part, mask, n, text)):
                    out[name].append(value)

            for k, (node, doc, part, mask, text) in enumerate(rows):
                if node.least < key(doc):
                    emit(k % (len(cuts) + 1), doc, part, mask | E, 1, None)
                else:
                    first.setdefault((id(node), part), [doc, part, mask, 0, text])[3] += 1
            for doc, part, mask, n, text in first.values():
                emit(bisect_right(cuts, text), doc, part, mask, n, text)
            return {k: pa.array(v, pa.binary()) if k == "text" else v for k, v in out.items()}

        for batch in pieces(batches, "text"):
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            for doc, part, text, n in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), as_bytes(batch.column("text")), points):
                rows.append((trie.insert(text, key(doc)), doc, part, own_failures(text, n), text))
                held += len(text)
            if held > TRIE_BYTES:
                yield settled()
                trie, rows, held = RadixTrie(), [], 0
        if rows:
            yield settled()

    def ranged(batches):
        at, trie, rows = None, RadixTrie(), []

        def settled():
            return {
                "doc_id": [r[1] for r in rows], "part": [r[2] for r in rows], "n": [r[4] for r in rows],
                "mask": [r[3] | E * (r[0] is not None and r[0].least < key(r[1])) for r in rows],
            }

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "doc_id", "part", "mask", "n", "text")]
            for place, doc, part, mask, n, text in zip(*columns):
                if place != at:
                    if rows:
                        yield settled()
                    at, trie, rows = place, RadixTrie(), []
                rows.append((None if text is None else trie.insert(text, key(doc)), doc, part, mask, n))
        if rows:
            yield settled()

    dealt = map_batches(frame, own, ROWS).repartition("range").sortWithinPartitions("range")
    return map_batches(dealt, ranged, "doc_id bigint, part string, mask int, n bigint")


def orders() -> list[tuple]:
    """(mask, filter_order, step, kept, removed, redundant, unique_fails, shapley) of a document
    with that mask, for all masks, orders and steps; shapley: its part in the sum, over all
    orders, of what the step's filter removes."""
    rows = []
    for order in map("".join, itertools.permutations(FILTERS)):
        for mask in range(1 << len(FILTERS)):
            fails = [mask >> FILTERS.index(f) & 1 for f in order]
            hit = fails.index(1) if mask else len(order)
            share = factorial(len(FILTERS)) // max(1, sum(fails))
            for step, fail in enumerate(fails):
                rows.append((mask, order, step + 1, int(hit > step), int(hit == step), int(fail and hit < step), int(fail and sum(fails) == 1), share * fail))
    return rows


COUNTS = ("kept", "removed", "redundant", "unique_fails", "shapley")


def audit(masks: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per part, order of the filters and step: documents kept after it, removed by it, failing
    its filter but gone before (redundant), failing its filter alone, good and toxic ones
    removed, and the filter's Shapley sum.

    A document counts as good or toxic if any of its ids' label rows says so; without a
    label, or with a NULL id, it is neither. Parts without documents have no rows."""
    label = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    alike = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))  # rows of one id, however many, are one
    counts = alike.join(label, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    names = ("mask", "filter_order", "step", *COUNTS)
    types = ("int", "string", "int", *["bigint"] * len(COUNTS))
    table = masks.sparkSession.createDataFrame(orders(), ", ".join(map(" ".join, zip(names, types))))  # 19,200 rows
    joined = counts.join(F.broadcast(table), "mask")
    return joined.groupBy("part", "filter_order", "step").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(c) for c in COUNTS],
        F.sum(F.col("good") * F.col("removed")).alias("good_lost"), F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"),
    )
