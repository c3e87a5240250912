"""Filter audit against plain loops over documents and orders."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tablewright.llm import filter_audit
from tablewright.llm.filter_audit import RadixTrie, audit, failure_masks


def plain_audit(rows, good, toxic):
    """rows: (doc_id, part, text)."""
    big = float("inf")
    least = {}
    for doc, _, text in rows:
        doc = big if doc is None else doc
        least[text or ""] = min(least.get(text or "", big), doc)
    masks = []
    for doc, part, text in rows:
        t = text or ""
        words = t.encode().split()
        masks.append((doc, part or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": least[t] < (big if doc is None else doc),
        }))
    out, names = {}, ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    shapley = Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for doc, part, fails in masks:
            hit = next((k for k, f in enumerate(order) if fails[f]), 9)
            for k, f in enumerate(order):
                row = out.setdefault((part, order, k + 1), Counter())
                row["kept"] += hit > k
                row["removed"] += hit == k
                row["redundant"] += fails[f] and hit < k
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                row["good_lost"] += hit == k and doc in good
                row["toxic_lost"] += hit == k and doc in toxic
                shapley[part, f] += hit == k
    return sorted((*k, *(row[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


def result(masks, labels):
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r[n] for n in names) for r in audit(masks, labels).collect())


def test_audit_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 3_000)  # several tries per task
    extra = [(100 + k, "hot copy " * (k % 3), "a") for k in range(200)] + [(1, "Loud TEXT $", "b"), (None, "hot copy ", None)]
    docs = odd.select("doc_id", "text", "source", "n_chars").unionAll(spark.createDataFrame(extra, "doc_id bigint, text string, source string").withColumn("n", F.lit(1)))
    docs = docs.withColumns({"mask": F.lit("x"), "n": F.lit(3.5), "part": F.lit(None), "range": F.lit(1), "least": F.lit(2)})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (100, 1, 1), (100, 1, 1), (101, None, 1), (None, 1, 1), (5555, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    want = plain_audit(rows, {1, 100}, {2, 100, 101})
    for parts in (1, 7):
        assert result(failure_masks(docs.repartition(parts)), labels) == want


def test_nothing(nothing, odd):
    assert failure_masks(nothing).collect() == []
    assert audit(failure_masks(nothing), odd.selectExpr("doc_id", "1 AS quality", "1 AS toxic")).collect() == []
    no_labels = nothing.selectExpr("doc_id", "1 AS quality", "1 AS toxic")
    assert len(audit(failure_masks(odd), no_labels).collect()) == 600 * odd.selectExpr("coalesce(source, '')").distinct().count()


def test_bounds_follow_shared_prefixes(spark):
    head = "the same beginning of every text " * 40  # longer than the first cuts
    docs = spark.createDataFrame([(k, f"{head}{k * 7919 % 5000:05d}") for k in range(3_000)], "doc_id bigint, text string")
    bounds = filter_audit.text_bounds(docs)
    assert len(bounds) > 20 and bounds == sorted(set(bounds))
    texts = sorted(r.text.encode() for r in docs.collect())
    places = Counter(filter_audit.bisect_right(bounds, t) for t in texts)
    assert max(places.values()) < 0.2 * len(texts)


def test_trie_holds_least_keys():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(2_000)]
    trie, least, nodes = RadixTrie(), {}, []
    for k, t in enumerate(texts):
        key = rng.randrange(10_000)
        nodes.append(trie.insert(t, key))
        least[t] = min(least.get(t, key), key)
    assert all(n.least == least[t] for n, t in zip(nodes, texts))

    def walk(node, so_far):
        so_far += node.label
        if node.least is not None:
            yield so_far, node.least
        assert len(node.children) != 1 or node.least is not None or node is trie.root  # compressed
        for child in node.children.values():
            yield from walk(child, so_far)

    assert dict(walk(trie.root, b"")) == least


def test_long_chain_of_prefixes():
    trie = RadixTrie()
    for n in range(3_000, 0, -1):
        trie.insert(b"x" * n, n)
    assert trie.insert(b"x" * 1_500, 9_999).least == 1_500
