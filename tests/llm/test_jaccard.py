"""The Jaccard join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tablewright.llm import jaccard
from tablewright.llm.common import Words


def word_sets(rows, size=5):
    out = []
    for _, text in rows:
        w = tuple((text or "").encode().lower().split())
        out.append(frozenset(w[i : i + size] for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([w] if w else []))
    return out


def plain(rows, num=80, den=100):
    sets, parent = word_sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for gram in s:
            for j in holders[gram]:
                shared[j] += 1
            holders[gram].append(i)
        for j, k in shared.items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=repr)


def spark_components(docs, **options):
    return sorted([tuple(r) for r in jaccard.jaccard_components(docs, **options).collect()], key=repr)


def near_copies(seed, n=500):
    rng = random.Random(seed)
    words, rows = [f"w{k}" for k in range(40)], []
    while len(rows) < n:
        base = rng.choices(words, k=rng.choice([0, 1, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 66, 70, 80, 150, 300]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1]))
            if rng.random() < 0.3:
                w += [f"p{k}" for k in range(25)]  # a passage that many hold
            rows.append((len(rows), " ".join(w) if w else None))
    return rows


@pytest.mark.parametrize("seed, num, n", [(1, 80, 400), (3, 60, 150)])
def test_near_copies(spark, seed, num, n):
    rows = near_copies(seed, n)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert spark_components(docs, num=num, den=100) == plain(rows, num)


def test_odd_rows(odd):
    assert spark_components(odd) == plain([(r.doc_id, r.text) for r in odd.collect()])


def test_empty_table(nothing):
    assert spark_components(nothing) == []
    assert jaccard.without_duplicates(nothing).collect() == []


def test_one_of_each_group(odd):
    kept = jaccard.without_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    components = plain([(r.doc_id, r.text) for r in odd.collect()])
    assert {i for i in ids if i is not None} == {c for d, n, c in components if n and c is not None} | {6, 7, 8}
    assert 2 not in ids and 5 not in ids and ids.count(10) == 1


def test_similar_sets_share_a_key():
    """The pigeonhole: any two sets at the threshold meet, by parts or by deletions."""
    rng = np.random.default_rng(0)
    bands = jaccard.Bands(4, 5)
    for _ in range(400):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = a.copy()
        while True:  # change one element after another while the sets stay similar
            kind = rng.integers(0, 2)
            c = np.delete(b, rng.integers(0, len(b))) if kind and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 2**63, 1, dtype=np.uint64)))
            shared = len(np.intersect1d(a, c))
            if 5 * shared < 4 * (len(a) + len(c) - shared):
                break
            b = c
        if len(a) == len(b) and (a == b).all():
            continue
        met = False
        for x in jaccard.signatures(a, bands):
            for y in jaccard.signatures(b, bands):
                if x["band"] == y["band"] and x["parts"] == y["parts"]:
                    for key in np.intersect1d(x["keys"], y["keys"]):
                        met |= not (x["deleted"][x["keys"] == key].all() and y["deleted"][y["keys"] == key].all())
        assert met, (len(a), len(b))


def test_words_of_many_texts(monkeypatch):
    """Same words, same hashes, wherever the buffer is cut; bounds as bytes.split has them."""
    rng, words, seen = random.Random(0), Words(), {}
    parts = [b"a", b"b", b"ab", b" ", b"\n", b"\t", b"  ", b"\xc3\xa9", b"\x0b"]
    for _ in range(200):
        texts = [b"".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(rng.randint(1, 6))]
        monkeypatch.setattr(Words, "CHUNK", rng.choice([1, 2, 3, 7, 1000]))
        hashes, bounds = words(texts)
        for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
            assert b - a == len(text.split())
            for word, value in zip(text.split(), hashes[a:b].tolist()):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_clashing_names_survive(spark):
    rows = [(i, PAIR[i % 2], "x", 7, "h") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __id string, _id_here int, _text_hash string")
    kept = jaccard.without_duplicates(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(rows[:2])


def test_loose_members_of_a_group(spark):
    """Copies of one text with 0 to 60 % of their words replaced: links as by all pairs, and
    few candidates among those that are no copies."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([0, 2, 4, 8, 20, 30, 45, 60, 90])):
            words[at] = f"{i}-{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs, real = [], jaccard._across

    def seen(*args):
        out = real(*args)
        pairs.append(out.count())
        return out

    jaccard._across = seen
    try:
        assert spark_components(docs) == plain(rows)
    finally:
        jaccard._across = real
    assert pairs[0] < 160 * 159 / 2 / 10


def test_few_candidates_in_a_large_group(spark, monkeypatch):
    """Copies of one text with one to three or eight words replaced: candidates in proportion
    to the copies, not to their pairs."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 1, 2, 2, 3, 8, 8])):
            words[at] = f"{i}-{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    pairs, real = [], jaccard._across

    def seen(*args):
        out = real(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_across", seen)
    assert spark_components(docs) == plain(rows)
    assert pairs[0] < 4 * len(rows)


def test_similar_sets_share_enough_keys():
    """No set with a similar one is left out for sharing too few keys."""
    rng = np.random.default_rng(5)
    bands = jaccard.Bands(4, 5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 600)), dtype=np.uint64))
        b = a[rng.permutation(len(a))[: -(-len(a) * 4 // 5)]]
        if rng.random() < 0.5:  # replaced, not removed
            b = np.unique(np.append(rng.permutation(a)[: -(-len(a) * 8 // 9)], rng.integers(0, 2**63, len(a) // 9, dtype=np.uint64)))
        b, shared = np.sort(b), len(np.intersect1d(a, b))
        if 5 * shared < 4 * (len(a) + len(b) - shared) or np.array_equal(a, b):
            continue
        keys = lambda grams: np.unique(np.concatenate([s["keys"] for s in jaccard.signatures(grams, bands)]))
        common = len(np.intersect1d(keys(a), keys(b)))
        assert common >= max(jaccard.least_shared(a, bands), jaccard.least_shared(b, bands))


PAIR = [" ".join(f"{c}{k}" for k in range(40)) for c in "ab"]
