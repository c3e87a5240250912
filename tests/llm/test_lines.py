"""Line deduplication against plain code."""

import hashlib
import random
from collections import defaultdict

from tablewright.llm import line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def plain(rows, min_chars, min_docs):
    low = lambda d: float("-inf") if d is None else d
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or low(d) == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def spark_lines(docs, **options):
    out = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, **options))
    return sorted([tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=repr)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = spark_lines(odd)
    assert got == plain(rows, 40, 5)
    assert sum(r[2] for r in got) == 5
    assert spark_lines(odd, min_chars=3, min_docs=2) == plain(rows, 3, 2)


def test_empty_table(nothing):
    assert spark_lines(nothing) == []


def test_hot_lines_over_many_partitions(spark):
    """Lines that most documents hold cross the borders of the range partitions."""
    rng = random.Random(5)
    lines = ["hot line one", "hot line two", *(f"line {i}" for i in range(40))]
    rows = [(d, "\n".join(rng.choices(lines, [30, 20, *[1] * 40], k=rng.randint(1, 9)))) for d in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert spark_lines(docs, min_chars=4, min_docs=5) == plain(rows, 4, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmap_of_every_document(odd):
    rows = {r.doc: r for r in line_dedup.keep_bitmaps(odd).collect()}
    assert line_dedup.kept_lines(b"a\nb\nc", 3, __import__("zlib").compress(bytes([0b10100000]))) == b"a\nc"
    assert rows[17].n_lines == 2 and rows[17].n_dropped == 2


def test_texts_are_not_sorted(odd):
    """Sorted texts filled an executor's memory; they meet a hash table of bitmaps."""
    joined = line_dedup.with_kept_text(odd, line_dedup.keep_bitmaps(odd))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin [doc") == 1
    assert joined.count() == odd.count()
