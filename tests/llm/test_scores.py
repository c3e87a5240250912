"""Language model, language identification, quality classifier and rules."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import common, language, lattice, quality, quality_rules
from tablewright.llm.common import held_out
from tablewright.llm.queries import QUERIES, quality_labels


def brute_marginal(vocabulary, word):
    place = {p: i for i, p in enumerate(vocabulary.pieces)}
    text = "▁" + word
    total = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            sub = text[start:end]
            if sub in place:
                weight = vocabulary.log_p[place[sub]]
            elif len(sub) == 1:
                weight = sum(vocabulary.log_p[len(place) + b] for b in sub.encode())
            else:
                continue
            total[end] = np.logaddexp(total[end], total[start] + weight)
    return total[-1]


def test_lattice_sums_all_segmentations(piece_model):
    vocabulary = lattice.Vocabulary.load(piece_model)
    assert np.exp(vocabulary.log_p).sum() == pytest.approx(1)
    words = ["the", "hello", "日本語", "a", "éèà", "x" * 60, "𝄞q", 'token="24be', "", "internationalization"]
    logs, expected = lattice.Lattice(vocabulary, vocabulary.log_p).marginals(words, np.ones(len(words)))
    assert logs == pytest.approx([brute_marginal(vocabulary, w) for w in words])
    # Expected pieces of a word spell all of its characters.
    spelt = [len(p) for p in vocabulary.pieces]
    known = lattice.Lattice(vocabulary, vocabulary.log_p).marginals(["hello"], np.ones(1))[1]
    assert known[: len(spelt)] @ spelt == pytest.approx(len("▁hello"))
    assert expected.sum() > 0


def plain_base(rows):
    words = lambda t: [*(t or "").encode().lower().split(), None]
    learn = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    counts = Counter(w for d, t in rows if learn(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(
        [(d, not learn(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 3)) for d, t in rows],
        key=repr,
    )


@pytest.mark.parametrize("frequent", [0, 20])
def test_base_scores(spark, odd, piece_model, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = lattice.lm_scores(spark, odd, piece_model).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got], key=repr) == plain_base(rows)
    assert all(r.score < 0 for r in got)


def test_score_is_the_same_for_any_table_of_frequent_words(spark, odd, piece_model, monkeypatch):
    scores = []
    for frequent in (0, 300_000):
        monkeypatch.setattr(lattice, "FREQUENT", frequent)
        scores.append(sorted((r.n_tokens, round(r.score, 4)) for r in lattice.lm_scores(spark, odd, piece_model).collect()))
    assert scores[0] == scores[1]


def test_lm_of_nothing(spark, nothing, piece_model):
    assert lattice.lm_scores(spark, nothing, piece_model).collect() == []


def test_language_accuracy(spark):
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97


def test_language_of_odd_rows(odd, nothing):
    langs, counts = language.count_languages(odd)
    assert langs == ["en", "fr"]
    got = language.identify(odd, langs, language.log_matrix(counts)).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 for d in (6, 7, 8, 13))
    assert all(0 <= r.score <= 1 for r in got)
    none, empty = language.count_languages(nothing)
    assert none == [] and language.identify(nothing, none, empty).collect() == []
    assert {r.lang_pred for r in language.identify(odd, none, empty).collect()} == {"und"}


def test_long_text_is_scored_whole():
    text = "abc " * 400_000
    assert sum(len(p) for p in language._parts(text)) == len(text)
    assert len(language._parts("x" * 1_200_000)) == 3


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 300
    right = lambda q: np.mean([r.predicted == q for r in rows if r.quality == q])
    assert right(1) >= 0.98 and right(0) >= 0.8


def test_quality_of_odd_rows(odd, nothing):
    labels = odd.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    table, net = quality.train(odd, quality_labels(labels))
    got = quality.score(odd, table, net, keep=("lang",)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.keep_good(odd, table, net)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)
    table, net = quality.train(nothing, nothing.select("doc_id", "label"))
    assert quality.score(nothing, table, net).collect() == []
    assert {round(r.score, 6) for r in quality.score(odd, table, net).collect()} == {0.5}


def test_filter_gives_back_memory_when_it_ends(spark, monkeypatch):
    """Its Python worker may wait long for another task."""
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("given back"))
    batch = pa.RecordBatch.from_pydict({"text": ["some words", None]})

    class Docs:  # what a task would run
        sparkSession, schema = spark, None
        mapInArrow = staticmethod(lambda run, schema: run)

    net = quality.fit_network(np.empty((0, 5 * quality.DIMS)), np.empty(0))
    run = quality.keep_good(Docs(), np.zeros((quality.UNITS, 2 * quality.DIMS), np.float32), net)
    for got in run(iter([batch])):
        seen.append(got.num_rows)
    assert seen[-2:] == [2, "given back"]


def test_context_vectors_do_not_depend_on_partitions(odd):
    index = quality.index_vectors()
    one = quality.context_vectors(odd.coalesce(1), index)
    assert (one == quality.context_vectors(odd.repartition(7), index)).all() and one.any()


def plain_rules(text):
    words = (text or "").encode().split()
    repeat = set()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    for i, w in enumerate(windows):
        if often[w] > 1:
            repeat.update(range(i, i + 8))
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    n = len(words)
    return (
        n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat),
        n < 20 or 100 * len(repeat) > 30 * n,
    )


def test_rule_counts(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    trusted = docs.where("doc_id % 3 = 0")
    got = quality_rules.quality_rules(docs, trusted).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r.doc_id, *(r[n] for n in names)) for r in got], key=repr) == sorted([(r.doc_id, *plain_rules(r.text)) for r in docs.collect()], key=repr)
    assert all(not r.kept for r in got if r.base_failed)


def test_rule_verdict_recomputed(spark, odd):
    """Scores, threshold and verdict of a bounded target by plain counting."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(odd.selectExpr("doc_id + 9000000", "text"))
    rows = docs.where("doc_id IS NOT NULL").collect()
    bound = 40
    chosen = {int(i) for i in quality_rules.trusted_sample(docs.where("doc_id % 3 = 0"), bound)}
    assert len(chosen) == bound and all(i % 3 == 0 for i in chosen)
    words = quality_rules.Words()

    def buckets(text):
        hashes, bounds = words([(text or "").encode()])
        return [int(b) for part in quality_rules.grams(hashes, bounds) for b in part]

    raw, target = Counter(), Counter()
    for r in docs.collect():
        raw.update(buckets(r.text))
        target.update(buckets(r.text) if r.doc_id in chosen else ())
    n, t = sum(raw.values()) + quality_rules.BUCKETS, sum(target.values()) + quality_rules.BUCKETS
    score = lambda text: np.mean([np.log((target[b] + 1) / t) - np.log((raw[b] + 1) / n) for b in buckets(text)] or [0])
    plain = {(r.doc_id, r.text): score(r.text) for r in rows}
    got = quality_rules.quality_rules(docs, docs.where("doc_id % 3 = 0"), bound).join(docs.where("doc_id <> 9000009").distinct(), "doc_id").collect()
    assert len(got) > 200 and max(abs(r.score - plain[r.doc_id, r.text]) for r in got) < 1e-4
    reach = sorted(plain[r.doc_id, r.text] for r in rows if r.doc_id in chosen and not plain_rules(r.text)[-1])
    least = got[0].threshold
    assert sum(x >= least - 1e-4 for x in reach) >= quality_rules.KEPT * len(reach)
    assert sum(x >= least + 2e-4 for x in reach) < quality_rules.KEPT * len(reach)
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in got)


def test_rule_target_is_every_trusted_document(spark):
    """A word that few trusted documents hold counts, however many others there are."""
    texts = [(i, " ".join(f"w{(i * 7 + j) % 500}" for j in range(25)) + (f" rare{i}" if i % 1000 == 0 else "")) for i in range(30_000)]
    docs = spark.createDataFrame([*texts, (None, texts[0][1])], "doc_id bigint, text string")
    target, raw = quality_rules.count_grams(quality_rules.marked(docs, docs.select("doc_id").where("doc_id IS NOT NULL")).select("text", "trusted"))
    assert target.sum() == sum(2 * len(t.split()) - 1 for _, t in texts)
    assert raw.sum() == target.sum() + 2 * len(texts[0][1].split()) - 1
    one = quality_rules.quality_rules(docs, docs.select("doc_id"))
    all_scores = sorted((r.score for r in one.collect() if r.doc_id is not None and not r.base_failed), reverse=True)
    least = one.first().threshold
    assert sum(x >= least for x in all_scores) >= quality_rules.KEPT * len(all_scores)
    bounded = quality_rules.quality_rules(docs, docs.select("doc_id"), 20_000).first()
    assert bounded.score != one.where(f"doc_id = {bounded.doc_id}").first().score


def test_rules_without_trusted(odd, nothing):
    got = quality_rules.quality_rules(odd, nothing.select("doc_id")).collect()
    assert len(got) == odd.count() and all(r.kept != r.base_failed for r in got)
    assert quality_rules.quality_rules(nothing, odd.select("doc_id")).collect() == []


def test_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    assert np.mean(clean) >= 0.98


def test_rules_reject_toxic_and_poor_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    rejected = lambda q, t: np.mean([not r.kept for r in got if (r.quality, r.toxic) in [(q, x) for x in t]])
    assert rejected(1, [0]) <= 0.015
    assert rejected(1, [1]) >= 0.75
    assert rejected(0, [0, 1]) >= 0.99


def test_held_out_of_null_id(odd):
    rows = odd.select("doc_id", held_out("doc_id", 5, 0).alias("h")).where("doc_id IS NULL").collect()
    assert all(r.h for r in rows)
