"""Jaccard join of word n-gram sets, exact, by partitioning the universe of n-grams.

Two sets of sizes a <= b with Jaccard similarity t differ in at most
H = (a + b)(1 - t)/(1 + t) elements. Sizes fall into bands; in a band the universe is
hashed into segments, the same for all sets, and a set's part of a segment is one key.

* Large sets: more than H + 1 segments, and equal parts. Of any H + 1 segments one is
  untouched by H differences, so a set may search by any H + 1 of its non-empty parts.
* Small sets (and the few large ones with too few non-empty parts): half as many segments
  and their one-deletion neighbourhoods: of (H + 1)/2 segments one has at most a single
  difference, so its part equals the other's, or the other's less one element.

Equal sets share a node (a 63-bit hash of the set), so copies cost nothing further. First,
every key's nodes are compared with one of them only (linear in the rows, combined in
the map tasks), which joins many groups of near copies whole. Nodes that share fewer keys
with any others than similar sets do are left out from there on. Keys that still hold nodes
of different components are counted, and each node gives up its most frequent keys as far
as it has more than it needs (cost-based allocation). Nodes of the keys that stay frequent
are compared with a pivot (the middle of their group), and each other pair of them is looked
for by what sets both apart from the pivot; the few nodes of other keys meet by their key.
All candidates are verified, so every link between sets is found or lies within a component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import SPACE, U64, Words, as_bytes, map_batches, mixed, pieces, unused, window_hashes
from tablewright.llm.graph import components
from tablewright.storage import bucketed, discard, materialize, release

SMALL = 64  # bands up to this size use one-deletion neighbourhoods
RATIO = 1.5  # of a band's bounds
SPARE = 0.12  # further segments, as a share
FREQUENT = 8  # nodes of a key from which it may be given up, or has a pivot
FLUSH = 1_000_000
MOST_SPARE = (1 << 20) - 2
ROWS = "key bigint, node bigint, rep bigint, n int"


def shingle_sets(words: Words, texts: list[bytes], size: int) -> list[np.ndarray]:
    """Distinct n-gram hashes of each text, ascending; fewer words are one n-gram, none
    an empty set. A-Z are lower-cased."""
    hashes, bounds = words([t.lower() for t in texts])
    windows = window_hashes(hashes, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            grams = np.sort(windows[a : b - size + 1])
            new = grams[1:] != grams[:-1]
            out.append(grams if new.all() else np.append(grams[0], grams[1:][new]))
        else:
            out.append(mixed(window_hashes(hashes[a:b], b - a) + U64(b - a)) if b > a else np.empty(0, U64))
    return out


def node_of(grams: np.ndarray) -> int:
    """The set's hash with the lowest bit 0, as a signed number that is not 0."""
    value = int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)
    return (value & ~1) or 2


class Bands:
    """Bounds of the bands and the segments of sets, for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.hi = [1]
        while self.hi[-1] < 2**40:
            self.hi.append(max(self.hi[-1] + 1, int((self.hi[-1] + 1) * RATIO)))

    def difference(self, a, b):
        """Most differing elements of similar sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[int]:
        """Bands in which a set of this size meets its partners: that of the larger set."""
        band = int(np.searchsorted(self.hi, size))
        return [band, band + 1] if size * self.den // self.num > self.hi[band] else [band]

    def needed(self, size: int, band: int) -> int:
        return self.difference(size, min(self.hi[band], size * self.den // self.num)) + 1

    def layout(self, band: int) -> tuple[int, bool]:
        """Number of segments and whether deletions are used; 0: only equal sets link."""
        most = self.difference(self.hi[band], self.hi[band])
        if most == 0:
            return 0, False
        if self.hi[band] <= SMALL:
            return -(-(most + 1) // 2), True
        return most + 1 + max(3, math.ceil(SPARE * (most + 1))), False

    def deletions(self, band: int) -> int:
        return -(-(self.difference(self.hi[band], self.hi[band]) + 1) // 2)


def _keys(content: np.ndarray, segment: np.ndarray, band: int, kind: int) -> np.ndarray:
    place = U64((band * 2 + kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return mixed(mixed(content + place) ^ (segment.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))


def signatures(grams: np.ndarray, bands: Bands) -> list[dict]:
    """For each band of a set: keys, which of them are deletions, non-empty parts beyond
    those needed (``spare``; negative: too few), and whether the band counts equal parts."""
    out, size = [], len(grams)
    spread = mixed(grams ^ U64(0xA5A5A5A5A5A5A5A5))
    for band in bands.of(size):
        m, by_deletion = bands.layout(band)
        if not m:
            continue
        spare = 0
        if not by_deletion:
            segment = (spread >> U64(17)) % U64(m)
            order = np.argsort(segment, kind="stable")
            held, at = np.unique(segment[order], return_index=True)
            content = np.add.reduceat(spread[order], at)
            spare = len(held) - bands.needed(size, band)
            out.append({"band": band, "keys": _keys(content, held, band, 0), "deleted": np.zeros(len(held), bool), "spare": spare, "parts": True})
        if by_deletion or spare < 0:
            m = bands.deletions(band)
            segment = ((spread >> U64(17)) % U64(m)).astype(np.int64)
            content = np.zeros(m, U64)
            np.add.at(content, segment, spread)
            keys = np.concatenate([
                _keys(content, np.arange(m), band, 1), _keys(content[segment] - spread, segment, band, 1),
            ])
            out.append({"band": band, "keys": keys, "deleted": np.arange(len(keys)) >= m, "spare": 0, "parts": False})
    return out


def least_shared(grams: np.ndarray, bands: Bands) -> int:
    """Keys that a set shares with any similar one, at least: parts beyond those that may
    differ, or one where deletions are used."""
    out, spread = MOST_SPARE, None
    for band in bands.of(len(grams)):
        m, by_deletion = bands.layout(band)
        if not m:
            continue
        if by_deletion:
            return 1
        if spread is None:
            spread = mixed(grams ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(17)
        held = np.count_nonzero(np.bincount((spread % U64(m)).astype(np.int64)))
        out = min(out, max(held - bands.needed(len(grams), band), 0) + 1)
    return out


def document_sets(docs: DataFrame, size: int, bands: Bands, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (NULL for an empty set) of every row, and the keys
    that the node shares with any similar one at least."""

    def run(batches):
        words = Words()
        for batch in pieces(batches, "text"):
            n, nodes, least = [], [], []
            for grams in shingle_sets(words, as_bytes(batch.column("text")), size):
                n.append(len(grams))
                nodes.append(node_of(grams) if len(grams) else None)
                least.append(least_shared(grams, bands) if len(grams) else None)
            yield {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": n, "node": nodes, "least": least}

    schema = "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, least int"
    return map_batches(_rows(docs, id_column, text_column), run, schema)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))


def _pairs_of(rep: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((node, rep))
    rep, node = rep[order], node[order]
    new = np.ones(len(rep), bool)
    new[1:] = (rep[1:] != rep[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(new)
    return rep[at], node[at], np.diff(np.append(at, len(rep))).astype(np.int32)


def _starred(keys: np.ndarray, nodes: np.ndarray):
    """Rows sorted by (key, deletion, node), as (forwarded rows, pairs with the first whole
    part of their key). Rows of a key without a whole part are all forwarded."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    head = nodes[starts][np.cumsum(new) - 1]
    follows = ~new & ((head & 1) == 0)
    pairs = head[follows], nodes[follows] & ~1
    return ~follows, pairs


def _signature_rows(docs: DataFrame, size: int, bands: Bands, id_column: str, text_column: str) -> DataFrame:
    """Key rows (rep 0) and, for nodes that meet in one task, pairs (rep, node, n)."""

    def run(batches):
        words, seen = Words(), set()
        keys, nodes, held = [], [], 0

        def flush():
            key, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
            order = np.lexsort((node, node & 1, key))
            key, node = key[order], node[order]
            forward, (rep, other) = _starred(key, node)
            rep, other, n = _pairs_of(rep[rep != other], other[rep != other])
            spread = mixed(other.view(U64)).view(np.int64)  # pairs are dealt by node
            zero = np.zeros(int(forward.sum()), np.int64)
            return {
                "key": np.concatenate([key[forward], spread]), "node": np.concatenate([node[forward], other]),
                "rep": np.concatenate([zero, rep]), "n": np.concatenate([zero.astype(np.int32), n]),
            }

        for batch in pieces(batches, "text"):
            for grams in shingle_sets(words, as_bytes(batch.column("text")), size):
                if not len(grams) or (node := node_of(grams)) in seen:
                    continue
                seen.add(node)
                for s in signatures(grams, bands):
                    keys.append(s["keys"])
                    nodes.append(np.int64(node) | s["deleted"].astype(np.int64))
                    held += len(s["keys"])
            if held > FLUSH:
                yield flush()
                keys, nodes, held = [], [], 0
        if held:
            yield flush()

    return map_batches(docs.select(F.col(text_column).alias("text")), run, ROWS)


def _star_pairs(rows: DataFrame) -> DataFrame:
    """(rep, node, n): each node with the first one of its keys; n keys in common."""

    def run(batches):
        rep, node, n, held = [], [], [], 0
        last_key, last_head = None, 0

        def flush():
            r, o, k = np.concatenate(rep), np.concatenate(node), np.concatenate(n)
            order = np.lexsort((o, r))
            r, o, k = r[order], o[order], k[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1])
            at = np.flatnonzero(new)
            return {"rep": r[at], "node": o[at], "n": np.add.reduceat(k, at).astype(np.int64)}

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "node", "rep", "n")}
            ready = c["rep"] != 0
            if ready.any():
                rep.append(c["rep"][ready]), node.append(c["node"][ready]), n.append(c["n"][ready].astype(np.int64))
                held += int(ready.sum())
            keys, nodes = c["key"][~ready], c["node"][~ready]
            if len(keys):
                if last_key is not None and keys[0] == last_key:
                    keys, nodes = np.append(last_key, keys), np.append(last_head, nodes)
                _, (r, o) = _starred(keys, nodes)
                last_key = keys[-1]
                last_head = nodes[np.searchsorted(keys, last_key)]
                differ = r != o
                if differ.any():
                    rep.append(r[differ]), node.append(o[differ]), n.append(np.ones(int(differ.sum()), np.int64))
                    held += int(differ.sum())
            if held > FLUSH:
                yield flush()
                rep, node, n, held = [], [], [], 0
        if held:
            yield flush()

    dealt = rows.repartition("key").sortWithinPartitions("key", F.col("node").bitwiseAND(F.lit(1)), "node")
    return map_batches(dealt, run, "rep bigint, node bigint, n bigint").groupBy("rep", "node").agg(F.sum("n").alias("n"))


def _sets_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(node, size, grams) for ``nodes``, from one document of each, in buckets of the node:
    the joins with it move pairs, not sets."""
    carrier = (
        sets.where("node IS NOT NULL").join(nodes, "node", "left_semi").groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))).alias("c"))
        .select(F.col("c.d").alias("d"), F.col("c.h").alias("h")).distinct()
    )
    rows = _rows(docs, id_column, text_column)
    texts = rows.join(carrier, rows["doc_id"].eqNullSafe(carrier["d"]) & (rows["text_hash"] == carrier["h"])).select("text")

    def run(batches):
        words, seen = Words(), set()
        for batch in pieces(batches, "text"):
            found = {node_of(g): g for g in shingle_sets(words, as_bytes(batch.column("text")), size) if len(g)}
            new = [k for k in found if k not in seen]
            seen.update(new)
            yield {"node": new, "size": [len(found[k]) for k in new], "grams": pa.array([found[k].tobytes() for k in new], pa.binary())}

    return bucketed(map_batches(texts, run, "node bigint, size int, grams binary"), "node", "grams")


def verify(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, exactly."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("a_grams")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("b_grams")), "b")
        .select("a", "b", "a_grams", "b_grams")
    )

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_grams"), batch.column("b_grams")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bands.den * shared >= bands.num * (len(x) + len(y) - shared))
            mask = pa.array(good, pa.bool_())
            yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

    return map_batches(both, run, "a bigint, b bigint")


def _shared_keys(sets: DataFrame, roots: DataFrame, star: DataFrame, bands: Bands) -> DataFrame:
    """(key, node, root, deleted, probe, size) of the keys that nodes of different components
    share, less those that the nodes give up.

    A set has ``spare`` parts more than may differ from any partner's. So it shares more than
    ``spare`` parts with a similar one, and of the parts that both have in common at least one
    is left when each gives up its ``spare`` most frequent ones, by one order of all keys."""
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    joined = star.join(root("rep"), "rep", "left").join(root("node"), "node", "left").select(
        F.coalesce("rep_root", "rep").alias("r"), F.coalesce("node_root", "node").alias("o"),
    ).where("r <> o")
    touched = joined.select(F.col("r").alias("root")).unionAll(joined.select("o")).distinct()
    rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rooted.join(touched, "root", "left_semi").select("node", "root", "grams")

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "node", "root", "info")}
            for node, component, grams in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), batch.column("grams")):
                grams = np.frombuffer(grams.as_buffer(), U64)
                for s in signatures(grams, bands):
                    k = len(s["keys"])
                    out["key"].append(s["keys"].view(np.int64))
                    out["node"].append(np.full(k, node, np.int64))
                    out["root"].append(np.full(k, component, np.int64))
                    # Size, band, whether it is an equal part, whether a deletion, parts to spare.
                    spare = min(max(s["spare"], -1), MOST_SPARE) + 1
                    out["info"].append((len(grams) << 9 | s["band"] << 2 | s["parts"] << 1 | s["deleted"].astype(np.int64)) << 20 | spare)
            if out["key"]:
                yield {k: np.concatenate(v) for k, v in out.items()}

    keyed = map_batches(rows, run, "key bigint, node bigint, root bigint, info bigint")
    # One shuffle of the keys; what a key holds is known where its rows lie.
    same_key = Window.partitionBy("key")
    bits = lambda at, n: F.shiftright("info", at).bitwiseAND(F.lit((1 << n) - 1))
    deleted = bits(20, 1).cast("int")
    shared = (
        keyed.withColumns({
            "n": F.count("*").over(same_key), "lo": F.min("root").over(same_key), "hi": F.max("root").over(same_key),
            "none": F.min(deleted).over(same_key),
        })
        .where("lo <> hi AND none = 0")
        .select(
            "key", "node", "root", "n", (deleted == 1).alias("deleted"), (bits(21, 1) == 1).alias("parts"), bits(22, 7).alias("band"),
            bits(29, 34).cast("int").alias("size"), (bits(0, 20) - 1).alias("spare"),
        )
    )
    own = Window.partitionBy("node", "band", "parts")
    enough = ~F.col("parts") | (F.count("*").over(own) > F.col("spare"))
    order = F.row_number().over(own.orderBy(F.col("n").desc(), "key"))
    given_up = F.col("parts") & (F.col("n") >= FREQUENT) & (order <= F.col("spare"))
    kept = shared.withColumns({"enough": enough, "given_up": given_up}).where("enough AND NOT given_up")
    return materialize(kept.select("key", "node", "root", "deleted", (F.col("spare") >= 0).alias("probe"), "size"), "shared-keys")


def _pivots(known: DataFrame) -> DataFrame:
    """(key, pivot, pivot_root, many): of a key's nodes the one that meets most others in all
    its keys, the middle of a group of copies; any would do for a right result. ``many``:
    whether the key is frequent."""
    count = known.groupBy("key").agg(F.count("*").alias("n"))
    meets = known.join(count, "key").groupBy("node").agg(F.sum("n").alias("meets"))
    lead = F.max_by(F.struct("node", "root"), F.struct("meets", "node")).alias("lead")
    leads = known.join(meets, "node").groupBy("key").agg(lead, (F.count("*") >= FREQUENT).alias("many"))
    return leads.select("key", F.col("lead.node").alias("pivot"), F.col("lead.root").alias("pivot_root"), "many")


def _apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with ``apart``, the elements that only one of node and pivot has, and
    their number."""
    grams = lambda name: sets.select(F.col("node").alias(name), F.col("grams").alias(f"{name}_grams"))
    both = members.join(grams("node"), "node").join(grams("pivot"), "pivot")
    names = ("node", "root", "size", "pivot", "pivot_root")

    def run(batches):
        for batch in batches:
            apart, sizes = [], []
            for x, p in zip(batch.column("node_grams"), batch.column("pivot_grams")):
                x, p = np.frombuffer(x.as_buffer(), U64), np.frombuffer(p.as_buffer(), U64)
                apart.append(np.setxor1d(x, p, assume_unique=True).view(np.int64))
                sizes.append(len(p))
            n = np.fromiter(map(len, apart), np.int64, len(apart))
            yield {
                **{c: batch.column(c) for c in names}, "pivot_size": sizes, "far": n.astype(np.int32),
                "apart": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate(apart) if len(apart) else np.empty(0, np.int64))),
            }

    schema = "node bigint, root bigint, size int, pivot bigint, pivot_root bigint, pivot_size int, far int, apart array<bigint>"
    return materialize(map_batches(both, run, schema), "apart")


def _across(sets: DataFrame, roots: DataFrame, star: DataFrame, bands: Bands) -> DataFrame:
    """Candidate pairs (a, b) between components.

    Nodes of a key that is not frequent meet by the key: few rows each. Those of a frequent
    one meet by its pivot. Let x and y lie ``far`` elements from it; they differ in at least
    far(x) + far(y) less twice what sets both apart from the pivot. If far(x) + far(y) is not
    more than similar sets may differ in, both are similar to the pivot, and these links are
    found here. So of all other pairs, similar ones share elements apart from the pivot,
    half of what far(x) + far(y) is too much, and are looked for by the rarest of these."""
    spark = sets.sparkSession
    known = _shared_keys(sets, roots, star, bands)
    release(spark)
    leads = materialize(_pivots(known), "pivots")
    release(spark)
    members = known.join(leads.where("many"), "key").where("node <> pivot").select("node", "root", "size", "pivot", "pivot_root").distinct()
    apart = _apart(members, sets)
    release(spark)
    num, den = bands.num, bands.den
    alike = f"p.root <> q.root AND p.node < q.node AND least(p.size, q.size) * {den} >= greatest(p.size, q.size) * {num}"
    differ = lambda a, b: f"((bigint({a}) + {b}) * {den - num} div {den + num})"
    near = apart.where(f"root <> pivot_root AND far <= {differ('size', 'pivot_size')}")
    joined = materialize(components(near.select(F.col("root").alias("a"), F.col("pivot_root").alias("b"))), "roots")
    renamed = joined.select(F.col("node").alias("root"), F.col("root").alias("joined"))
    later = lambda df: df.join(renamed, "root", "left").withColumn("root", F.coalesce("joined", "root")).drop("joined")
    few = later(known.join(leads.where("NOT many").select("key"), "key", "left_semi"))
    p, q = few.alias("p"), few.alias("q")
    direct = p.join(q, F.col("p.key") == F.col("q.key")).where(f"{alike} AND NOT (p.deleted AND q.deleted) AND (p.probe OR q.probe)")
    element = later(apart).select("node", "root", "size", "pivot", "far", F.explode("apart").alias("e"))
    same = Window.partitionBy("pivot", "e")
    found = element.withColumns({"n": F.count("*").over(same), "lo": F.min("root").over(same), "hi": F.max("root").over(same)}).where("lo <> hi")
    # If similar sets share k of these elements, the rarest of the k has rank k or more in both.
    rank = F.row_number().over(Window.partitionBy("pivot", "node").orderBy(F.col("n").desc(), "e"))
    least = F.expr(f"far - {differ('size', f'(bigint(size) * {den} div {num})')}")
    searched = materialize(found.withColumn("rank", rank).where(F.col("rank") >= least).select("node", "root", "size", "pivot", "far", "rank", "e"), "elements")
    release(spark)
    p, q = searched.alias("p"), searched.alias("q")
    shared = f"2 * least(p.rank, q.rank) >= p.far + q.far - {differ('p.size', 'q.size')}"
    by_pivot = p.join(q, (F.col("p.pivot") == F.col("q.pivot")) & (F.col("p.e") == F.col("q.e"))).where(f"{alike} AND {shared}")
    to_pivot = near.select(F.least("node", "pivot"), F.greatest("node", "pivot"))
    both = direct.select("p.node", "q.node").unionAll(by_pivot.select("p.node", "q.node")).unionAll(to_pivot).toDF("a", "b")
    pairs = materialize(both.distinct(), "pairs")
    discard(known, leads, apart, joined, searched)
    release(spark)
    return pairs


def jaccard_components(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id per row; ``size`` words, similarity num/den.

    Links are exact up to clashes of 64-bit hashes of words, n-grams and sets. component_id
    is the least doc_id of all rows reachable by links, itself included. Empty and NULL
    texts have no n-grams and link with nothing; rows of one id are linked by their own
    texts; a NULL id is never a component_id unless its component has no other. An empty
    table gives an empty one; other columns are not read."""
    return _join(docs, size, num, den, id_column, text_column)[0]


def _join(docs, size, num, den, id_column="doc_id", text_column="text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The result, the verified links (a, b) between nodes, and each row's component."""
    g = math.gcd(num, den)
    bands = Bands(num // g, den // g)
    sets = materialize(document_sets(docs, size, bands, id_column, text_column), "sets")
    spark = docs.sparkSession
    star = materialize(_star_pairs(_signature_rows(docs, size, bands, id_column, text_column)), "star-pairs")
    release(spark)  # the shuffled keys, the largest step
    shared = star.select("node", "n").unionAll(star.select("rep", "n")).groupBy("node").agg(F.sum("n").alias("shared"))
    nodes = sets.join(shared, "node").where("shared >= least").select("node").distinct()
    grams = _sets_of(docs, sets, nodes, size, id_column, text_column)
    release(spark)
    best = star.groupBy("node").agg(F.max(F.struct("n", "rep")).alias("m")).select(F.least("node", "m.rep").alias("a"), F.greatest("node", "m.rep").alias("b")).distinct()
    links = materialize(verify(best, grams, bands), "links")
    release(spark)
    roots = materialize(components(links), "roots")
    pairs = _across(grams, roots, star, bands)
    more = materialize(verify(pairs, grams, bands), "links")
    discard(star, grams, pairs)
    release(spark)
    links = links.unionAll(more)
    roots = components(links)
    rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("doc_id", "text_hash", "n_shingles", "root")
    rooted = materialize(rooted, "rooted")
    discard(sets)
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out, links, rooted


def without_duplicates(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with one document of each group left, all columns as they are.

    The document with the least id stays (a NULL id last); of equal rows of one id and
    text one stays. Rows without words link with nothing and all stay."""
    parts = _join(docs, size, num, den, id_column, text_column)[2]
    # One text per component: that of the least id.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("m")
    first = parts.where("root IS NOT NULL").groupBy("root").agg(least).select("m.doc_id", "m.text_hash")
    wordless = parts.where("root IS NULL").select("doc_id", "text_hash").distinct()
    here, text_hash, number = unused(docs, "_id_here", "_text_hash", "_number")
    chosen = first.unionAll(wordless).toDF("_keep_id", "_keep_hash")
    marked = docs.withColumns({here: F.col(id_column).cast("bigint"), text_hash: F.xxhash64(text_column)})
    kept = marked.join(chosen.alias("c"), F.col(here).eqNullSafe(F.col("c._keep_id")) & (F.col(text_hash) == F.col("c._keep_hash")), "left_semi")
    repeated = first.join(parts.groupBy("doc_id", "text_hash").count().where("count > 1"), ["text_hash"], "left_semi")
    if not repeated.isEmpty():  # equal rows are copies, too
        one = Window.partitionBy(here, text_hash).orderBy(F.xxhash64(*docs.columns))
        words = F.coalesce(F.col(text_column).rlike(f"[^{SPACE}]"), F.lit(False))
        once = kept.where(words).withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).drop(number)
        kept = kept.where(~words).unionAll(once)
    return kept.select(*docs.columns)
