"""Hot keys: segment borders, sliding blocks, chunks and global indexes against
plain windows and brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import aggregates, buckets, relate, segments, windows


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; some values are NULL; one time is far off."""
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{i % 7}", (i * 37) % 5000, None if i % 5 == 0 else rng.randint(0, 99))
            for i in range(3000)]
    rows.append((3000, "hot", -10**9, 1))
    return spark.createDataFrame(rows, "id bigint, k string, t bigint, v int").cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select("id", *columns).collect()), key=lambda r: r[0])


def key_order():
    return Window.partitionBy("k").orderBy("t", "id")


@pytest.mark.parametrize("count", [None, 1, 2, 13, 400])
def test_running_crosses_segments(hot, count):
    got = segments.running(hot, ["k"], ["t", "id"], {
        "s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "lo": ("min", F.col("v")),
        "hi": ("max", F.col("v")), "p": ("lag", F.col("v")), "all": ("total_sum", F.col("v")),
    }, segments=count)
    run = key_order().rowsBetween(Window.unboundedPreceding, 0)
    want = hot.select(
        "id", F.sum("v").over(run).alias("s"), F.count("*").over(run).alias("n"), F.min("v").over(run).alias("lo"),
        F.max("v").over(run).alias("hi"), F.lag("v").over(key_order()).alias("p"), F.sum("v").over(Window.partitionBy("k")).alias("all"),
    )
    assert rows_of(got, "s", "n", "lo", "hi", "p", "all") == rows_of(want, "s", "n", "lo", "hi", "p", "all")


def test_segments_stay_even_with_a_far_off_value(hot):
    number = segments.segment_of(hot, ["t"], rows=20)
    sizes = hot.withColumn("_pos", F.col("t")).groupBy(number.alias("s")).count().collect()
    assert len(sizes) >= 100 and max(r["count"] for r in sizes) <= 60


@pytest.fixture(scope="module")
def tied(spark):
    """A third of the rows share key and time; only the id tells them apart."""
    rows = [(i, "hot", 500 if i % 3 == 0 else (i * 7) % 1000, i % 10) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, k string, t bigint, v int").cache()


@pytest.mark.parametrize("one_time", [False, True])
def test_ties_are_cut_along_the_second_column(tied, one_time):
    df = tied.withColumn("t", F.lit(5).cast("bigint")) if one_time else tied
    number = segments.segment_of(df, ["t", "id"], rows=30)
    cut = df.withColumns({"_pos": F.col("t"), "_tie": F.col("id")}).withColumn("s", number)
    assert max(r["count"] for r in cut.groupBy("s").count().collect()) <= 120
    # Segments rise in (t, id) order.
    ends = cut.groupBy("s").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).orderBy("s").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(ends, ends[1:]))
    got = segments.running(df, ["k"], ["t", "id"], {"s": ("sum", F.col("v")), "p": ("lag", F.col("v"))}, segments=70)
    want = df.select("id", F.sum("v").over(key_order().rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(key_order()).alias("p"))
    assert rows_of(got, "s", "p") == rows_of(want, "s", "p")


def test_lookup_without_order_and_copies(spark):
    foreign = spark.range(5000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("v"))
    left = spark.createDataFrame([(1, "hot")], "n int, k string")
    out = relate.lookup(left, foreign, "k", "k", "m", size=100).collect()
    assert max(len(r["m"]) for r in out) <= 200
    values = sorted(m["v"] for r in out for m in r["m"])
    assert values == [7] * 4000 + list(range(4000, 5000))


def test_segment_join_reuses_the_window_partitioning(spark, hot):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = segments.running(hot, ["k"], ["t", "id"], {"s": ("sum", F.col("v"))}, segments=9)
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows, summary by segment, summary by key, summary back by segment
    assert text.count("Exchange hashpartitioning") == 4 and "SortMergeJoin" in text


@pytest.mark.parametrize("count", [None, 1, 9])
def test_nearest_both_ways(hot, count):
    seen = F.col("v").isNotNull()
    got = segments.nearest(hot, ["k"], ["t", "id"], {"b": (["v"], seen, False), "a": (["v"], seen, True)}, count)
    want = hot.select(
        "id", F.last("v", True).over(key_order().rowsBetween(Window.unboundedPreceding, 0)).alias("x"),
        F.first("v", True).over(key_order().rowsBetween(0, Window.unboundedFollowing)).alias("y"),
    )
    assert rows_of(got, "b.v", "a.v") == rows_of(want, "x", "y")


@pytest.mark.parametrize("frame", [(-3, 2), (0, 4), (-5, 0), (2, 2)])
def test_sliding_frames(hot, frame):
    placed = segments.running(hot, ["k"], ["t", "id"], {"place": ("count", F.lit(1))}, 11)
    got = segments.sliding(placed, ["k"], F.col("place"), *frame, {"s": F.sum("v")}, width=7)
    want = hot.select("id", F.sum("v").over(key_order().rowsBetween(*frame)).alias("s"))
    assert rows_of(got, "s") == rows_of(want, "s")


def test_sliding_range(hot):
    got = segments.sliding(hot, ["k"], F.col("t"), -50, 20, {"s": F.sum("v")}, width=70)
    want = hot.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("t").rangeBetween(-50, 20)).alias("s"))
    assert rows_of(got, "s") == rows_of(want, "s")


@pytest.mark.parametrize("parts", [1, 5, 32])
def test_running_index(hot, parts):
    got = segments.with_running_index(hot, ["k", F.col("t").desc(), "id"], "i", parts)
    listed = hot.orderBy("k", F.col("t").desc(), "id").collect()
    want = sorted((r["id"], i) for i, r in enumerate(listed))
    assert rows_of(got, "i") == want


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(100)], "x int, w int")
    got = {r["x"]: r["b"] for r in segments.with_running_total(df, ["x"], "w", "b", 6).collect()}
    assert got == {i: sum(j % 5 + 1 for j in range(i)) for i in range(100)}


def test_push_chunks_lose_nothing(hot):
    chunks = aggregates.push_chunks(hot, ["k"], F.col("id"), ["t", "id"], "ids", size=50).collect()
    assert max(len(r["ids"]) for r in chunks) <= 50
    joined = [i for r in sorted(chunks, key=lambda r: (r["k"], r["chunk"])) if r["k"] == "hot" for i in r["ids"]]
    assert joined == [r["id"] for r in hot.where("k = 'hot'").orderBy("t", "id").collect()]


def test_small_groups_come_whole(hot):
    chunks = aggregates.push_chunks(hot, ["k"], F.col("id"), ["t", "id"], "ids").collect()
    got = {r["k"]: r["ids"] for r in chunks}
    assert len(chunks) == len(got) == 8 and {r["chunk"] for r in chunks} == {0}
    assert got["hot"] == [r["id"] for r in hot.where("k = 'hot'").orderBy("t", "id").collect()]


def test_push_by_text_order(hot):
    df = hot.withColumn("name", F.lpad(F.col("id").cast("string"), 6, "0"))
    chunks = aggregates.push_chunks(df, ["k"], F.col("id"), ["name"], "ids", size=100).where("k = 'hot'").orderBy("chunk").collect()
    assert [i for r in chunks for i in r["ids"]] == sorted(r["id"] for r in hot.where("k = 'hot'").collect())


def test_group_with_push_and_set(hot):
    out = aggregates.group(hot, "$k", {
        "n": {"$count": {}}, "ids": {"$push": {"input": "$id", "sortBy": {"t": 1, "id": 1}}}, "vs": {"$addToSet": "$v"},
    }, size=64)
    rows = out.where("_id = 'hot'").collect()
    assert sum(len(r["ids"] or []) for r in rows) == rows[0]["n"]
    values = [v for r in rows for v in (r["vs"] or [])]
    assert sorted(values) == sorted({r["v"] for r in hot.where("k = 'hot' AND v IS NOT NULL").collect()})


def test_lookup_keeps_every_match_of_a_hot_key(spark, hot):
    left = spark.createDataFrame([(1, "hot"), (2, "k1"), (3, "none"), (4, None)], "n int, k string")
    foreign = hot.select("k", "id").unionAll(spark.createDataFrame([(None, 77)], "k string, id bigint"))
    out = relate.lookup(left, foreign, "k", "k", "m", ["id"], size=100)
    sizes = {r["n"]: (r["total"], r["top"]) for r in out.groupBy("n").agg(F.sum(F.size("m")).alias("total"), F.max(F.size("m")).alias("top")).collect()}
    count = hot.where("k = 'hot'").count()
    assert sizes[1] == (count, 100) and sizes[3] == (0, 0) and sizes[4] == (1, 1)


def test_bucket_auto_keeps_equal_values_together(hot):
    out = buckets.bucket_auto(hot.withColumn("x", F.least(F.col("t"), F.lit(100))), "$x", 4, partitions=3).collect()
    assert sum(r["count"] for r in out) == 3001
    assert [r["max"] for r in out][:-1] == [r["min"] for r in out][1:]


def test_graph_lookup_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src int, dst int")
    starts = spark.createDataFrame([("a", 1), ("b", 9)], "s string, v int")
    found = relate.graph_lookup(starts, edges, "dst", "src")
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 9, 0)]
    near = relate.graph_lookup(starts, edges, "dst", "src", max_depth=1)
    assert sorted(tuple(r) for r in near.collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 9, 0)]


def test_densify_bounds_and_blocks(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 6, 2.0), ("b", 2, 3.0)], "k string, x bigint, v double")
    full = windows.densify(df, "x", 2, ["k"], "full", block=2)
    assert sorted((r["k"], r["x"]) for r in full.collect()) == [(k, x) for k in "ab" for x in (0, 2, 4, 6)]
    part = windows.densify(df, "x", 2, ["k"], "partition")
    assert sorted((r["k"], r["x"]) for r in part.collect()) == [("a", 0), ("a", 2), ("a", 4), ("a", 6), ("b", 2)]


def test_fill_methods(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 2, None), (3, 4, 4.0), (4, 5, None)], "id int, x int, v double")
    out = windows.fill(
        df.select("id", "x", F.col("v").alias("a"), F.col("v").alias("b"), F.col("v").alias("c")),
        {"a": {"value": 0.0}, "b": {"method": "locf"}, "c": {"method": "linear"}}, None, ["x"], segments=3,
    )
    assert rows_of(out, "a", "b", "c") == [(1, 1.0, 1.0, 1.0), (2, 0.0, 1.0, 2.0), (3, 4.0, 4.0, 4.0), (4, 0.0, 4.0, None)]


def test_rates_reset_and_stall(spark):
    df = spark.createDataFrame(
        [(1, "h", "2024-01-01 00:00:00", 10.0), (2, "h", "2024-01-01 00:00:10", 30.0), (3, "h", "2024-01-01 00:00:20", 5.0),
         (4, "h", "2024-01-01 00:00:20", 9.0)], "id int, s string, at string, v double",
    ).withColumn("at", F.col("at").cast("timestamp"))
    out = windows.rate_counters(df, ["s"], "at", "v", ["at", "id"], segments=4)
    assert rows_of(out, "rate") == [(1, None), (2, 2.0), (3, 0.0), (4, 0.0)]
