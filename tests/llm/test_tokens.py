"""Token files: round trips and the tokenizer's own ids."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewright.llm import common, token_files


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32])
def test_segment_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    data = token_files.encode_segment([7, None], [n // 3, n - n // 3], ids, 3, 11)
    part, start, docs, lengths, out = token_files.decode_segment(memoryview(data))
    assert (part, start, docs, lengths.tolist()) == (3, 11, [7, None], [n // 3, n - n // 3])
    assert (out == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(256, 9, np.uint32)
    ids[[3, 200]] = 50_000
    small = len(token_files.encode_segment([1], [256], ids))
    wide = len(token_files.encode_segment([1], [256], np.arange(256, dtype=np.uint32) * 190))
    assert small < wide / 4


@pytest.fixture(scope="module")
def both(bpe):
    plain = Tokenizer.from_file(bpe)
    with open(bpe, encoding="utf-8") as f:
        return token_files.Encoder(f.read()), plain


PARTS = ["a", "B", "'s", " ", "\n", "1", "é", "\t", " x", "!", "日", "'", "  ", "\n\n", "ll", "<|endoftext|>", "\r", " \n", " ", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_words_give_the_ids_of_the_text(both, parts):
    own, plain = both
    text = "".join(parts)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_those_of_the_library(both):
    own, plain = both
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x<|endoftext|>\n\ny"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def expected(rows, tokenizer):
    out, start = [], 0
    for d, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_of_a_table(spark, bpe, both):
    rng = random.Random(1)
    rows = [(d, "".join(rng.choices(PARTS, k=rng.randint(0, 60))) if d % 7 else None) for d in range(300)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string").repartition(4)
    got = sorted(tuple(r) for r in token_files.token_files(docs, bpe).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(rows, both[1])


def test_odd_rows(odd, bpe, both):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = token_files.token_files(odd, bpe).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((d, n, c) for d, _, n, c in expected(rows, both[1])), key=repr)
    by_start = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    assert [r.start for r in by_start] == [sum(x.n_tokens for x in by_start[:k]) for k in range(len(by_start))]


def test_empty_table(nothing, bpe):
    assert token_files.token_files(nothing, bpe).collect() == []


def test_ids_come_back(spark, bpe, folder, both):
    docs = spark.createDataFrame([(2, "two words"), (1, "one")], "doc_id bigint, text string")
    token_files.write_token_files(docs, f"{folder}/t", bpe, end_id=5)
    rows = {r.doc_id: r.ids for r in token_files.read_token_files(spark, f"{folder}/t", with_ids=True).collect()}
    assert rows == {d: [*both[1].encode(t, add_special_tokens=False).ids, 5] for d, t in [(1, "one"), (2, "two words")]}


def test_marks_are_cut_off_words(both):
    own, plain = both
    texts = ["Tea, cake; it's a.b@c-d (x) e...\nÜber*** 'll!! ñ? ×, ½. ª! ſ- ʰ~ 日,", "a" + "!" * 9, ",,a,,", "x'- y'", "_a_", "1,000.5, 2nd"]
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    own.units.clear(), own.units.older.clear()
    own.encode([" ".join(f"word{mark}" for mark in ("", ",", "***", "@@", "?!", ".com"))])
    assert set(own.units) == {"word", " word", ",", "***", "@@", "?!", ".", "com", ".com"}


def test_a_unit_of_many_texts_is_looked_up_once(both):
    own, plain = both
    asked = []

    class Asked(token_files.Units):
        def __getitem__(self, unit):
            asked.append(unit)
            return super().__getitem__(unit)

    texts = ["", "tea and tea, and\0tea", "tea\nand " * 40 + "x", "", "ȁ,é.×!÷? ɏ; ɐ; \0 ,tea", "  kept whole", "tea and é"]
    units, own.units = own.units, Asked(own._unit, 10)
    try:
        got = own.encode(texts)
    finally:
        own.units = units
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count(" tea") == asked.count("\n") == 1


def test_files_are_read_once(spark, bpe, folder, monkeypatch):
    docs = spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    token_files.write_token_files(docs, f"{folder}/once", bpe)
    kept = []
    monkeypatch.setattr(token_files, "materialize", lambda df, label: kept.append(label) or df.localCheckpoint())
    rows = token_files.read_token_files(spark, f"{folder}/once")
    assert kept == ["token-rows"] and "binaryFile" not in rows._jdf.queryExecution().toString()
    assert [r.start for r in rows.orderBy("doc_id").collect()][1:3] == [rows.where("doc_id = 0").first().n_tokens, rows.where("doc_id < 2").groupBy().sum("n_tokens").first()[0]]


def test_a_task_gives_back_what_earlier_ones_freed(monkeypatch):
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    held = [np.ones(12_000) for _ in range(1000)]  # 96 MB in blocks of the C library
    guard = np.ones(12_000)  # lies above them, so they are not returned when freed
    before = resident()
    held.clear()
    assert list(common.pieces([], "text")) == []
    assert resident() < before - 60 and guard.all()


def test_a_task_gives_back_what_it_freed_when_it_ends(spark, monkeypatch):
    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append("given back"))

    def fn(batches):
        yield {"x": [1, 2]}
        done.append("worked")

    run = common.map_batches(Frame(), fn, "x bigint")
    assert [b.num_rows for b in run([])] == [2] and done == ["given back", "worked", "given back"]
    assert list(common.map_batches(Frame(), lambda batches: iter(()), "x bigint")([])) == []
