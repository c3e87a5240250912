"""Conversation tries against plain dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest

from tablewright.llm import conversations

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(paths):
    """paths: {conv_id: tuple of (role, text)}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((
        min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(c for c in who if len(paths[c]) == len(p))).encode()).hexdigest(),
    ) for p, who in members.items()) if members else []


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(own.get(base, [])[:h] + ts[h:])
    return out


def nodes(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=lambda r: (r[0], r[1]))


def some_rows(seed, n, turns, words):
    rng = random.Random(seed)
    rows = []
    for c in range(-n // 4, n):
        for t in range(rng.randrange(turns)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "", None]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,turns,words", [(1, 60, 6, ["a", "b"]), (2, 30, 40, ["a"]), (3, 40, 20, ["é", "", None, "long " * 50]), (4, 3, 2, ["x"])])
def test_against_plain_code(spark, monkeypatch, seed, n, turns, words):
    monkeypatch.setattr(conversations, "END_CHUNK", 3)
    rows = some_rows(seed, n, turns, words) + [(None, 1, "user", "lost"), (7, 1, "user", "a"), (7, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", "'x' AS path", "1 AS base", "2 AS t", "3 AS h", "4 AS depth").repartition(5)
    paths = conversations.rebuilt(df)
    want = plain_rebuilt(rows)
    assert {r.conv_id: len(r.path) // conversations.UNIT for r in paths.collect()} == {c: len(p) for c, p in want.items()}
    assert nodes(conversations.prefix_trie(paths)) == plain_trie(want)


def test_hot_conversation_over_many_shards(spark):
    """A third of the conversations are equal, more share their first turn."""
    rows = [(c, t, "user", f"hot {t}" if c % 3 == 0 or t == 0 else f"{c} {t}") for c in range(0, 900, 1) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert nodes(conversations.prefix_trie(conversations.rebuilt(df))) == plain_trie(plain_rebuilt(rows))


def test_long_conversations(spark):
    """Hundreds of equal turns, then a fork; more columns than a block of the matrix."""
    rows = [(c, t, "user", f"{t if t < 200 + c else -c}") for c in (0, 1, 2, 5) for t in range(230)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert nodes(conversations.prefix_trie(conversations.rebuilt(df))) == plain_trie(plain_rebuilt(rows))


def test_no_conversation(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.prefix_trie(conversations.rebuilt(none)).collect() == []
    lost = spark.createDataFrame([(None, 1, "a", "b")], none.schema)
    assert conversations.prefix_trie(conversations.rebuilt(lost)).collect() == []
