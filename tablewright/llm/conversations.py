"""Prefix trie of conversations, by sorted matrices of turn ids.

A conversation is one row: its path, UNIT bytes per turn (digest of role and text, then the
text's length in bytes). Paths are range-partitioned by (path, conv_id). A task numbers its
turns densely, sorts its rows by padded matrices of turn ids (numpy lexsort, WIDTH columns
at a time, from the last block to the first) and ORs the change masks of the columns from
left to right: a node of depth d starts where column d or one before it changed. reduceat
over these starts gives every count of a depth, and over the children those of subtrees.

Only the nodes on the path of a task's first and of its last row can have members in
another task. They are written as parts; the driver, which gets two paths per task, joins
equal ones into one node, and the nodes below learn their parent's id by a join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import map_batches
from tablewright.storage import materialize

UNIT, DIGEST = 20, 16
WIDTH = 16
SHARED, FAMILY, SHIFT = 9, 5, 8  # heads have h = crc32 mod 9 turns, of the conversation c - c % 5
SHARD_TURNS = 500_000
END_CHUNK = 50_000  # ids of a chunk whose hash is taken across tasks
INNER, EDGE, ENDS = 0, 1, 2
MEASURES = "conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
FOUND = f"kind int, shard int, side int, parent_side int, parent_conv_id bigint, {MEASURES}, ends_sha256 string, unit binary, n_ends bigint, ends string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(
    turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """conv_id, path of every conversation: the first h turns of conversation c - c % 5, then
    its own after its first h; h = crc32(c as text) % 9.

    Turns are ordered by turn (NULL first), then role, then digest; repeated rows are turns
    each. NULL roles and texts are empty. The remainder takes the sign of c. Rows without a
    conv_id belong to no conversation. An empty table gives none. Other columns are not read."""
    role, text = F.coalesce(F.col(role_column), F.lit("")), F.coalesce(F.col(text_column), F.lit(""))
    conv = F.col(id_column).cast("bigint")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    unit = F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 2 * (UNIT - DIGEST), "0"))
    rows = turns.where(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % FAMILY).alias("base"), F.struct(F.col(turn_column).alias("turn"), role.alias("role"), unit.alias("unit")).alias("t"),
    )
    # One shuffle: a family, FAMILY rows (twice as many around zero), meets in one partition.
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("base", "conv_id", F.unhex(F.array_join(F.col("t.unit"), "")).alias("path"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("path", 1, (SHARED - 1) * UNIT))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    return own.withColumns({"head": F.coalesce(head, F.lit(b"")), "h": h}).select(
        "conv_id", F.expr(f"concat(substring(head, 1, {UNIT} * h), substring(path, {UNIT} * h + 1, length(path)))").alias("path")
    )


def _matrix(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    """Columns block * WIDTH and on of ``rows``, 0 beyond a row's end."""
    column = block * WIDTH + np.arange(WIDTH)
    inside = column < lengths[rows, None]
    return np.where(inside, ids[np.where(inside, starts[rows, None] + column, 0)], 0)


def _order(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Rows by turn ids, a prefix before what it begins, then by conversation."""
    rank = np.zeros(len(conv), np.int64)  # of what follows a block; 0: nothing
    for block in reversed(range(-(-int(lengths.max()) // WIDTH))):
        rows = np.flatnonzero(lengths > block * WIDTH)
        matrix = _matrix(ids, starts, lengths, rows, block)
        order = np.lexsort((rank[rows], *matrix.T[::-1]))
        matrix, after = matrix[order], rank[rows][order]
        new = np.ones(len(rows), bool)
        new[1:] = (matrix[1:] != matrix[:-1]).any(axis=1) | (after[1:] != after[:-1])
        rank[rows[order]] = np.cumsum(new)
    return np.lexsort((conv, rank))


def _starts(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """For each depth from 1: the sorted rows that reach it, and which of them start a node."""
    changed = np.zeros(len(lengths), bool)
    changed[0] = True
    for block in range(-(-int(lengths.max()) // WIDTH)):
        rows = np.flatnonzero(lengths > block * WIDTH)
        matrix = _matrix(ids, starts, lengths, rows, block)
        differs = np.ones(matrix.shape, bool)
        differs[1:] = (matrix[1:] != matrix[:-1]) | (np.diff(rows) > 1)[:, None]
        mask = np.logical_or.accumulate(differs, axis=1) | changed[rows, None]
        for k in range(min(WIDTH, int(lengths.max()) - block * WIDTH)):
            reach = lengths[rows] > block * WIDTH + k
            yield rows[reach], mask[reach, k]
        changed[rows] |= mask[:, -1]


def _by_parent(values: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Sums of the children's values; ``parent`` ascends."""
    out = np.zeros(n, np.int64)
    if len(parent):
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        out[parent[first]] = np.add.reduceat(values, first)
    return out


def shard_nodes(conv: np.ndarray, starts: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> list[dict]:
    """Per depth from 0: arrays over the nodes of one shard, in order.

    ``units``: the turns of all paths, UNIT bytes each; ``starts``: where a path's begin. An
    edge node (``side`` 0: of the first row, 1: of the last row alone) counts its inner
    children only, and leaves and savings of the inner nodes below it."""
    if len(units):
        high, low = (np.ascontiguousarray(units[:, a : a + 8]).view(">u8").reshape(-1) for a in (0, 8))
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        ids = np.empty(len(order), np.int64)
        ids[order] = np.cumsum(new)
        size = np.ascontiguousarray(units[:, DIGEST:]).view(">u4").reshape(-1).astype(np.int64)
    else:
        ids = size = np.zeros(0, np.int64)
    order = _order(ids, starts, lengths, conv)
    conv, starts, lengths = conv[order], starts[order], lengths[order]
    last = len(conv) - 1
    everyone = np.arange(len(conv))
    depths: list[dict] = []
    node_of = np.zeros(len(conv), np.int64)  # of each row, one depth up
    first = np.zeros(len(conv), bool)
    first[0] = True
    for depth, (rows, new) in enumerate([(everyone, first), *_starts(ids, starts, lengths)]):
        at = np.flatnonzero(new)
        n_convs = np.diff(np.append(at, len(rows)))
        side = np.full(len(at), -1, np.int64)
        if rows[-1] == last:
            side[-1] = 1
        if rows[0] == 0:
            side[0] = 0
        ended = lengths[rows] == depth
        turn = starts[rows[at]] + depth - 1
        depths.append({
            "conv_id": np.minimum.reduceat(conv[rows], at), "n_convs": n_convs, "side": side, "parent": node_of[rows[at]],
            "turn": turn, "size": size[turn] if depth else np.zeros(1, np.int64), "n_ends": np.add.reduceat(ended.astype(np.int64), at),
            "ends_at": rows[at], "ends": conv,
        })
        node_of[rows] = np.cumsum(new) - 1
    for depth in range(len(depths) - 1, -1, -1):
        d, below = depths[depth], depths[depth + 1] if depth + 1 < len(depths) else None
        n, inner = len(d["side"]), d["side"] < 0
        children = below["side"] < 0 if below else None
        d["n_children"] = _by_parent(children.astype(np.int64), below["parent"], n) if below else np.zeros(n, np.int64)
        d["n_leaves"] = np.where(inner & (d["n_children"] == 0), 1, 0)
        d["saved_tokens"] = np.where(inner, (d["n_convs"] - 1) * d["size"], 0)
        if below:
            for c in ("n_leaves", "saved_tokens"):
                d[c] = d[c] + _by_parent(below[c], below["parent"], n)
    return depths


def _ids(conv: np.ndarray) -> str:
    return ",".join(map(str, conv.tolist()))


def _shards(batches):
    """The nodes of a partition, its edge nodes and the ids that end in these."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    conv = np.concatenate([b.column("conv_id").to_numpy() for b in found])
    paths = [np.frombuffer(p.as_buffer(), np.uint8) for b in found for p in b.column("path")]
    lengths = np.fromiter(map(len, paths), np.int64, len(paths)) // UNIT
    units = np.concatenate(paths).reshape(-1, UNIT)
    starts = np.cumsum(lengths) - lengths
    del paths
    above = None
    for depth, d in enumerate(shard_nodes(conv, starts, lengths, units)):
        n, side = len(d["side"]), d["side"]
        inner, whole = side < 0, d["ends"]
        sha = [NO_ENDS] * n
        for k in np.flatnonzero(inner & (d["n_ends"] > 0)).tolist():
            a = int(d["ends_at"][k])
            sha[k] = hashlib.sha256(_ids(whole[a : a + int(d["n_ends"][k])]).encode()).hexdigest()
        parent_side = above["side"][d["parent"]] if above else np.full(n, -1)
        yield {
            "kind": np.where(inner, INNER, EDGE).astype(np.int32), "shard": np.full(n, shard, np.int32), "side": side.astype(np.int32),
            "parent_side": parent_side.astype(np.int32),
            "parent_conv_id": above["conv_id"][d["parent"]] if above else pa.nulls(n, pa.int64()),
            "depth": np.full(n, depth, np.int64), "ends_sha256": sha, "n_ends": d["n_ends"],
            "unit": pa.array([units[t].tobytes() if e and depth else None for t, e in zip(d["turn"].tolist(), ~inner)], pa.binary()),
            "ends": pa.nulls(n, pa.string()), **{c: d[c] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")},
        }
        for k in np.flatnonzero(~inner & (d["n_ends"] > 0)).tolist():
            a, b = int(d["ends_at"][k]), int(d["ends_at"][k] + d["n_ends"][k])
            for at in range(a, b, END_CHUNK):
                chunk = whole[at : min(at + END_CHUNK, b)]
                yield {
                    "kind": [ENDS], "shard": [shard], "side": [int(side[k])], "parent_side": [-1], "parent_conv_id": [None], "conv_id": [int(chunk[0])],
                    "depth": [depth], "n_convs": [0], "n_children": [0], "n_leaves": [0], "saved_tokens": [0], "ends_sha256": [None],
                    "unit": [None], "n_ends": [len(chunk)], "ends": [_ids(chunk)],
                }
        above = d


def _joined(edges: list) -> tuple[list[dict], dict[tuple, int]]:
    """Whole edge nodes of all shards (parents before children), and which one a part is of.

    ``edges``: parts by shard, side and depth: at most two paths per shard."""
    nodes: list[dict] = []
    known: dict[tuple, int] = {}  # (parent, unit)
    part_of: dict[tuple, int] = {}
    for e in edges:
        up = None
        if e["depth"]:
            up = part_of.get((e["shard"], e["side"], e["depth"] - 1))
            if up is None:  # the last row's path leaves the first row's
                up = part_of[e["shard"], 0, e["depth"] - 1]
        unit = None if e["unit"] is None else bytes(e["unit"])
        k = known.setdefault((up, unit), len(nodes))
        if k == len(nodes):
            nodes.append({"parent": up, "depth": e["depth"], "size": int.from_bytes(unit[DIGEST:], "big") if unit else 0,
                          "conv_id": e["conv_id"], **dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"), 0)})
            if up is not None:
                nodes[up]["n_children"] += 1
        node = nodes[k]
        node["conv_id"] = min(node["conv_id"], e["conv_id"])
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"):
            node[c] += e[c]
        part_of[e["shard"], e["side"], e["depth"]] = k
    own = [[int(n["n_children"] == 0), (n["n_convs"] - 1) * n["size"]] for n in nodes]  # of edge nodes in the subtree
    for k in range(len(nodes) - 1, -1, -1):
        if (up := nodes[k]["parent"]) is not None:
            own[up] = [a + b for a, b in zip(own[up], own[k])]
        nodes[k]["n_leaves"] += own[k][0]
        nodes[k]["saved_tokens"] += own[k][1]
    return nodes, part_of


def _end_hashes(chunks: DataFrame) -> dict[int, str]:
    """SHA-256 of the ids that end in each edge node, streamed in the order of the shards."""

    def run(batches):
        at, digest = None, None
        for batch in batches:
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node != at:
                    if at is not None:
                        yield {"node": [at], "sha": [digest.hexdigest()]}
                    at, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.encode())
        if at is not None:
            yield {"node": [at], "sha": [digest.hexdigest()]}

    dealt = chunks.repartition("node").sortWithinPartitions("node", "conv_id")
    return {r["node"]: r["sha"] for r in map_batches(dealt.select("node", "ends"), run, "node bigint, sha string").collect()}


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The nodes of the conversations ``paths`` (conv_id, path), one row each.

    conv_id (the least member), depth, parent_conv_id (NULL for the root), n_convs,
    n_children, n_leaves and saved_tokens (of the subtree), ends_sha256 (of the ids of the
    conversations that end here, ascending). Without conversations there is no root.
    A conversation's path is one row: UNIT bytes a turn. Distinct turns are told apart by
    128 bits."""
    spark = paths.sparkSession
    paths = materialize(paths, "conversation-paths")
    turns = paths.agg(F.sum(F.length("path"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // (UNIT * SHARD_TURNS) + 1)
    found = materialize(map_batches(paths.repartitionByRange(shards, "path", "conv_id"), _shards, FOUND), "trie-nodes")
    # Two paths per shard: bounded by the number of shards, not by the data.
    edges = found.where(F.col("kind") == EDGE).drop("ends", "ends_sha256", "parent_conv_id").collect()
    nodes, part_of = _joined(sorted(edges, key=lambda e: (e["shard"], e["side"], e["depth"])))
    parts = spark.createDataFrame(
        [(*k, node, nodes[node]["conv_id"]) for k, node in part_of.items()],
        "shard int, parent_side int, up bigint, node bigint, whole_conv_id bigint",
    )
    chunks = found.where(F.col("kind") == ENDS).join(
        parts.select("shard", F.col("parent_side").alias("side"), F.col("up").alias("depth"), "node"), ["shard", "side", "depth"]
    )
    sha = _end_hashes(chunks)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    whole = spark.createDataFrame(
        [
            (n["conv_id"], n["depth"], None if n["parent"] is None else nodes[n["parent"]]["conv_id"], n["n_convs"], n["n_children"],
             n["n_leaves"], n["saved_tokens"], sha.get(k, NO_ENDS))
            for k, n in enumerate(nodes)
        ],
        "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    )
    inner = found.where(F.col("kind") == INNER)
    below_edge = inner.where("parent_side >= 0").withColumn("up", F.col("depth") - 1).join(parts, ["shard", "parent_side", "up"])
    return (
        inner.where("parent_side < 0").select(*names)
        .unionAll(below_edge.withColumn("parent_conv_id", F.col("whole_conv_id")).select(*names))
        .unionAll(whole)
    )
