"""Mixing, secret scans, decontamination and the pipeline against plain code."""

import hashlib
import random

import numpy as np
import re
import string
from collections import Counter

import pytest

import corpus_pipeline
from tablewright.llm import decontaminate, mixing, secrets
from tablewright.llm.queries import QUERIES


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        share = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else weight[s] * share for s in names}
        full |= over


def test_targets(spark):
    rng = random.Random(2)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 5000, 100000]) for i in range(40)} | {None: 7, "": 9, "Z": 3, "é": 1}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_of_odd_rows(odd, nothing):
    counts = mixing.mix_counts(odd).collect()
    assert len(counts) == odd.count()
    assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in counts)
    words = Counter({None: 0})
    for r in odd.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert sorted(r.target for r in counts) == pytest.approx(sorted(plain_targets(words)[r.source] for r in odd.collect()))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in counts)
    assert sorted(mixing.mix_counts(odd.repartition(5)).collect(), key=repr) == sorted(counts, key=repr)
    assert mixing.mix_counts(nothing).collect() == [] and mixing.mix(nothing).collect() == []


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(8000)]
    got = mixing.mix_counts(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    for r in got.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.05)


ASSIGN = r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def base_columns(text):
    spans = plain_spans(text)
    joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def secret_text(rng):
    parts = [
        "Password", "tokEN", "api_key", "APIKEY", "ſecret", "secret", ":", "=", " ", '"', "'", "abc", "abcdef", "x1-/_.=", "AKIA", "ABCDEFGH12345678",
        "0123456789abcdef01234567", "é", "\n", "word", "  ", "token=token:abcdefgh",
    ]
    return "".join(rng.choices(parts, k=rng.randint(0, 25)))


def test_base_spans(spark, odd):
    rng = random.Random(4)
    rows = [(i, secret_text(rng)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionAll(odd.select("doc_id", "text"))
    got = secrets.scan_secrets(docs).collect()
    texts = docs.collect()
    assert sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], key=repr) == sorted([(r.doc_id, *base_columns(r.text)) for r in texts], key=repr)
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert Counter(kinds)["grammar"] == r.n_grammar and len(kinds) == r.n_assign + r.n_access + r.n_hex + r.n_grammar


def test_no_secrets(nothing):
    assert secrets.scan_secrets(nothing).collect() == []


def test_automaton_learns_a_format():
    rng = random.Random(0)
    strings = Counter("U" * 4 + "x" * 16 + "-" + "l" * rng.randint(3, 6) for _ in range(500))
    learned = secrets.Automaton(strings)
    assert len(learned.states) < 40
    good, other = learned.score("UUUU" + "x" * 16 + "-llll"), learned.score("llllllllllllllllllll")
    assert good > other + 1


def test_frequent_class_strings_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE", 20)
    for k in range(10):
        often = "U" * 6 + "-" * (k + 1) + "x" * 8
        rows = [(0, "x" * (10 + i % 20) + "l" * (i // 20 + 1), 1) for i in range(400)] + [(0, often, 200)]
        learned = secrets.infer_automata(spark.createDataFrame(rows, "kind int, classes string, count bigint"))
        assert learned[0].passes[0]["U"] == 200


def test_grammar_spans_find_the_format(spark):
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = [(i, f"words and more words token = {hexes(40)} plainordinarylongword extraordinarilylongwordshere") for i in range(300)]
    rows.append((1000, "unlabelled " + hexes(20) + "A" + hexes(19) + " here, internationalisation too"))
    found = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1000].n_grammar == 1 and found[1000].n_hex == 0
    assert sum(r.n_grammar for r in found.values()) == 1


def test_grammar_spans_of_letters_and_of_short_values(spark):
    rng = random.Random(6)
    mixed = lambda n, letters=string.ascii_letters + string.digits: "".join(rng.choices(letters, k=n))
    prose = "The international committee described several ordinary developments because another government considered them. "
    rows = [(i, prose * 3 + f"password = {mixed(20 if i % 2 else 10)} Understanding") for i in range(600)]
    rows += [(1000 + i, prose + mixed(20, string.ascii_letters) + " " + prose) for i in range(40)]
    rows += [(2000 + i, prose + mixed(10) + " " + prose) for i in range(40)]
    rows += [(3000, prose * 5 + "Responsibilities INTERNATIONALISATION misunderstanding")]
    found = {r.doc_id: r.n_grammar for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(found[1000 + i] == 1 for i in range(40)) >= 36
    assert sum(found[2000 + i] == 1 for i in range(40)) >= 32
    assert sum(n for d, n in found.items() if d < 1000) == 0


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = rng.choices(b"abcd", k=rng.randint(1, 30)), rng.choices(b"abcd", k=rng.randint(0, 40))
        a, b = [bytes([x]) for x in a], [bytes([x]) for x in b]
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        assert decontaminate.common_subsequence(a, b) == row[-1]


def test_leaks_against_plain_search(spark):
    """Whole items planted anywhere, and paraphrases: found, and nothing else."""
    sf = "/root/testdata/sf0.01"
    rng = random.Random(9)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400").select("doc_id", "text").collect()
    rows, planted = [], set()
    for k, r in enumerate(texts):
        text = r.text
        if k % 4 == 0:
            item = rng.choice(items)
            words = item.text.split()
            if k % 8 == 0 and len(words) >= 10:  # one word of ten changed
                for at in rng.sample(range(len(words)), len(words) // 10):
                    words[at] = "changed"
            cut = text.split(" ")
            at = rng.randint(0, len(cut))
            text = " ".join([*cut[:at], *words, *cut[at:]])
            planted.add((r.doc_id, item.item_id))
        rows.append((r.doc_id, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    exact = {(d, i.item_id) for d, t in rows for i in items if i.text in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert len((planted | exact) & got) >= 0.98 * len(planted | exact)
    assert len(got - planted - exact) <= 1
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_randomised_svd_follows_the_energy():
    rng = np.random.default_rng(3)
    low = rng.normal(size=(100, 12)) @ rng.normal(size=(12, 700)) + 0.01 * rng.normal(size=(100, 700))
    basis = decontaminate.randomised_svd(low, 0.97, rng)
    assert basis.shape[1] <= 12 and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert ((low @ basis) ** 2).sum() >= 0.969 * (low**2).sum()
    exact = np.linalg.svd(low)[2][: basis.shape[1]]
    assert np.linalg.svd(exact @ basis)[1].min() > 0.999  # the same space
    wide = rng.normal(size=(40, 900))
    assert decontaminate.randomised_svd(wide, 0.97, rng).shape[1] > 30
    assert decontaminate.randomised_svd(np.zeros((3, 5)), 0.97, rng).shape[0] == 5


def test_leaks_of_a_large_benchmark(spark):
    """1000 items, a third of 15 words; 0 to 45 % of their words replaced, the last fifth kept."""
    rng = random.Random(12)
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 2000").collect()]
    spans = []
    for k in range(1000):
        text, n = rng.choice(texts), 15 if k % 3 == 0 else rng.randint(16, 59)
        at = rng.randint(0, len(text) - n)
        spans.append(text[at : at + n])
    hashes, bounds = decontaminate.split(decontaminate.splitter(), [" ".join(s).encode() for s in spans])
    items = [decontaminate.make_item(k, hashes[a:b]) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    rows, planted = [], set()
    for k in range(0, 1000, 2):
        words, keep = list(spans[k]), max(1, len(spans[k]) // 5)
        for at in rng.sample(range(len(words) - keep), int(rng.choice([0, 0.2, 0.4, 0.45]) * len(words))):
            words[at] = rng.choice(rng.choice(texts))
        around = rng.choice(texts)
        at = rng.randint(0, len(around))
        text = [*around[max(0, at - 120) : at], *words, *around[at : at + 120]]
        rows.append((k, " ".join(text)))
        found, _ = decontaminate.split(decontaminate.splitter(), [" ".join(words).encode()])
        if decontaminate.judge(items[k], found.tolist()):
            planted.add((k, k))
    assert len(planted) > 450
    benchmark = spark.createDataFrame([(k, " ".join(s)) for k, s in enumerate(spans)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark).collect()}
    assert len(planted & got) >= 0.99 * len(planted)


def test_leaks_of_odd_rows(spark, odd, nothing):
    benchmark = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (None, "x"), (3, ""), (4, "zz yy xx")], "item_id bigint, text string")
    got = decontaminate.find_leaks(odd, benchmark).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}, key=repr) == [(1, 1), (2, 1), (3, 1), (None, 1)]
    assert decontaminate.find_leaks(nothing, benchmark).collect() == []
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).collect() == []
    kept = decontaminate.without_leaks(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = corpus_pipeline.good_quality(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert good.columns == docs.columns
    clean = labels.where("quality = 1").join(docs, "doc_id").count()
    assert good.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * clean
    tokens = QUERIES["op8_token_files"](spark, sf)
    got = corpus_pipeline.run(spark, sf)
    assert set(got.columns) >= set(tokens.columns)
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_judged_are_only_candidates_with_enough_words(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 30, k)) for k in (12, 40, 25, 9)]
    hashes, bounds = decontaminate.split(decontaminate.splitter(), [t.encode() for t in texts])
    items = [decontaminate.make_item(k, hashes[a:b]) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    idf = np.ones(decontaminate.FEATURES, np.float32)
    passages = [p for k in items for p in decontaminate._tfidf(decontaminate.features(np.array(k.words, np.uint64)), idf)]
    owner = [k.item_id for k in items for _ in decontaminate._tfidf(decontaminate.features(np.array(k.words, np.uint64)), idf)]
    searcher = decontaminate.Searcher([decontaminate.latent_space(passages, owner, idf)], items)
    judged, judge = [], decontaminate.judge

    def watched(item, region):
        there = Counter(region)
        judged.append(sum(min(n, there[w]) for w, n in item.counts.items()) / len(item.words))
        return judge(item, region)

    monkeypatch.setattr(decontaminate, "judge", watched)
    monkeypatch.setattr(decontaminate, "REGION_WORDS", 100)
    docs = [" ".join(f"w{n}" for n in rng.integers(0, 45, 200)).encode() for _ in range(30)]
    docs += [b" ".join([d, t.encode(), d]) for d, t in zip(docs, texts)] + [b"w1 w2 " * 3, b"", texts[3].encode()]
    got = searcher.leaks(docs)
    assert {k for leaks in got[30:34] for k, *_ in leaks} >= {0, 1, 2, 3}
    assert judged and min(judged) >= decontaminate.PARAPHRASE
    # Every candidate, one by one.
    words, at = decontaminate.split(searcher.words, docs)
    window, item, value, starts, of = searcher.near(words, at)
    found: list[dict] = [{} for _ in docs]
    for w, k, v in zip(window, item, value):
        n, t = len(items[k].words), of[w]
        low, high = max(at[t], starts[w] - n), min(at[t + 1], starts[w] + 2 * decontaminate.BLOCK + n)
        one = judge(items[k], words[low:high].tolist())
        if one and one > found[t].get(k, (0,) * 6)[4:]:
            found[t][k] = (items[k].item_id, low - at[t], high - at[t], float(v), *one)
    assert got == [[leaks[k] for k in sorted(leaks)] for leaks in found]
    assert searcher.leaks([]) == [] and searcher.leaks([b""]) == [[]]
