"""Harmonic packing against an exact round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm import packing


def padding(length, capacity=1024):
    return 0 if length & (length - 1) == 0 else capacity - length


def test_classes_leave_little_of_a_bin():
    lengths = packing.class_lengths(1024)
    assert lengths[:6] == [1024, 512, 341, 256, 146, 128] and lengths[-1] == 1
    assert all(1024 - 1024 // n * n <= packing.SLACK for n in lengths)
    assert packing.class_lengths(1024, 0) == [1 << k for k in range(10, -1, -1)]


@pytest.mark.parametrize("capacity,slack", [(1024, 2), (1024, 0), (64, 2), (48, 3), (1, 0)])
def test_packer_round_trip(capacity, slack):
    rng = random.Random(capacity)
    docs = [np.array([rng.randrange(50_000) for _ in range(rng.choice([1, 1, 3, 40, 341, 1023, 1024, 1025, 5000]))], "<u4") for _ in range(150)]
    packer = packing.Packer(capacity, slack)
    for k, ids in enumerate(docs):
        packer.add(k, ids.tobytes())
    packer.finish()
    pieces, bins = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset, ids in packer.take():
        assert zlib.crc32(ids) == crc and total == len(docs[doc]) and len(ids) == 4 * length
        pieces[doc].append((start, ids))
        bins[sequence].append((offset, length))
    for k, ids in enumerate(docs):
        at = 0
        for start, part in sorted(pieces[k]):
            assert start == at
            at += len(part) // 4
        assert b"".join(p for _, p in sorted(pieces[k])) == ids.tobytes()
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and (capacity & (capacity - 1) or padding(at, capacity) <= slack)


def test_query_rows(spark, odd, nothing, bpe):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionAll(odd.selectExpr("doc_id + 9000000", "text"))
    tokenizer = Tokenizer.from_file(bpe)
    tokenizer.no_truncation()
    plain = defaultdict(list)
    for r in docs.collect():
        plain[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])
    got = packing.pack_documents(docs.repartition(5), bpe, with_ids=True).collect()
    of_doc, of_bin = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        of_doc[r.doc_id].append(r)
        of_bin[r.sequence_id].append((r.offset, r.length))
    assert set(of_doc) == set(plain)
    for doc, rows in of_doc.items():
        if len(plain[doc]) == 1:
            rows.sort(key=lambda r: r.start)
            assert [i for r in rows for i in r.ids] == plain[doc][0]
            assert all(r.doc_tokens == len(plain[doc][0]) for r in rows)
            assert [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        else:  # one id, several texts
            assert sorted(i for r in rows for i in r.ids) == sorted(i for ids in plain[doc] for i in ids)
    empty = 0
    for held in of_bin.values():
        ends = np.cumsum([0, *(n for _, n in sorted(held))])
        assert [o for o, _ in sorted(held)] == ends[:-1].tolist() and ends[-1] <= 1024
        empty += padding(int(ends[-1]))
    assert empty <= 0.003 * sum(r.length for r in got)
    assert packing.pack_documents(nothing, bpe).collect() == []
    again = packing.pack_documents(docs.repartition(5), bpe).collect()
    assert sorted((r[:7] for r in again), key=repr) == sorted((r[:7] for r in got), key=repr)
