"""One result for every size: each limit lowered against the plain answer."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregates, fields, filters, generate, paging, relate, search, segments, transfer, windows
from tablewright.sources.readers import glob_match


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("values", [[1, 5, None], [7], [None], [2, 2, 9]])
def test_lists_of_any_length(spark, monkeypatch, values):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i) for i in range(12)], "id int, v int")
    short = got(filters.filter_in_list(df, "v", values))
    monkeypatch.setattr(filters, "INLINE_LIST", 0)
    assert got(filters.filter_in_list(df, "v", values)) == short


@pytest.mark.parametrize("order", [["name"], ["digits"], ["at", "id"]])
def test_keys_beyond_one_task(spark, monkeypatch, order):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else "cold", f"x{rng.randint(0, 9999)}-{i}", f"{rng.randint(1, 10**6)}{i:04d}", rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, name string, digits string, at double")
    aggs = {"run": ("sum", F.col("id")), "prev": ("lag", F.col("id")), "n": ("total_count", F.lit(1))}
    filled = {"v": (["id"], F.col("id") % 5 == 0, False), "w": (["id"], F.col("id") % 5 == 0, True)}
    plain = got(segments.running(df, ["k"], order, aggs)), got(segments.nearest(df, ["k"], order, filled))
    monkeypatch.setattr(segments, "ONE_TASK_ROWS", 10)
    monkeypatch.setattr(segments, "ROWS_PER_SEGMENT", 30)
    assert (got(segments.running(df, ["k"], order, aggs)), got(segments.nearest(df, ["k"], order, filled))) == plain


@pytest.mark.parametrize("sort_by", [{"at": 1, "id": 1}, {"at": -1, "id": 1}, {"name": -1}])
def test_windows_beyond_one_task(spark, monkeypatch, sort_by):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else "cold", f"n{rng.randint(0, 999):03d}{i:03d}", rng.randint(0, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, name string, at int")
    output = {
        "no": {"$documentNumber": {}}, "run": {"$sum": "$id", "window": {"documents": ["unbounded", "current"]}},
        "near": {"$max": "$id", "window": {"documents": [-2, 1]}}, "prev": {"$shift": {"output": "$id", "by": -1}}, "all": {"$avg": "$id"},
    }
    plain = got(windows.set_window_fields(df, "$k", sort_by, output).select("id", *output))
    monkeypatch.setattr(segments, "ONE_TASK_ROWS", 10)
    monkeypatch.setattr(segments, "ROWS_PER_SEGMENT", 30)
    assert got(windows.set_window_fields(df, "$k", sort_by, output).select("id", *output)) == plain


def test_top_of_any_length(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"), "id").repartition(7)
    plain = got(aggregates.top_per_group(df, ["k"], [F.desc("v")], 40))
    monkeypatch.setattr(aggregates, "SPARK_CUTS", 5)
    assert got(aggregates.top_per_group(df, ["k"], [F.desc("v")], 40)) == plain


def test_pages_of_any_depth(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v")).repartition(6)
    pages = [got(paging.page_offset(df, 20, at, ["k"])) for at in (0, 40, 280)]
    monkeypatch.setattr(paging, "DEEP_PAGE", 10)
    assert [got(paging.page_offset(df, 20, at, ["k"])) for at in (0, 40, 280)] == pages


def test_lookup_has_one_row_per_document(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    foreign = spark.range(25_000).select(F.lit(1).alias("k"), "id")
    out = relate.lookup(left, foreign, "k", "k", "m")
    assert {r.k: len(r.m) for r in out.collect()} == {1: 25_000, 2: 0, None: 0}


def test_every_chunk_has_the_plain_values(spark):
    df = spark.createDataFrame([(1, i, i % 2) for i in range(10)], "k int, a int, b int")
    out = aggregates.group(df, "$k", {
        "set": {"$addToSet": "$a"}, "n": {"$count": {}}, "odd": {"$push": {"input": "$b", "sortBy": {"a": 1}}},
        "top": {"$topN": {"n": 1, "output": "$a", "sortBy": {"a": -1}}},
    }, size=4)
    assert sorted((r.chunk, r.n, r.top) for r in out.collect()) == [(0, 10, [9]), (1, 10, [9]), (2, 10, [9])]


def test_graphs_and_fields_of_any_depth(spark):
    chain = spark.range(80).select("id", (F.col("id") + 1).alias("next"))
    starts = spark.createDataFrame([(0, 0)], "start bigint, value bigint")
    assert relate.graph_lookup(starts, chain, "next", "id").count() == 80
    deep = '{"a":' * 40 + "1" + "}" * 40
    assert fields.flatten_fields(spark.createDataFrame([(deep,)], "d string"), "d").count() == 40


def test_digit_runs_of_any_length(spark):
    names = ["a9", "a1" + "0" * 20, "a2" + "0" * 20, "a3" + "0" * 20, "a007", "a10", "b" + "1" * 300, "b" + "2" * 299]
    df = spark.createDataFrame([(n,) for n in random.Random(3).sample(names, len(names))], "v string")
    want = ["a007", "a9", "a10", "a1" + "0" * 20, "a2" + "0" * 20, "a3" + "0" * 20, "b" + "2" * 299, "b" + "1" * 300]
    assert [r.v for r in paging.sort_natural(df, "v").collect()] == want
    assert [r.v for r in paging.sort_natural(df, "v", index="at").orderBy("at").collect()] == want


def test_sums_of_any_magnitude(spark):
    small = spark.createDataFrame([(1e-7,), (2e-7,)], "v double")
    assert aggregates.selection_summary(small).first()["sum"] == pytest.approx(3e-7)
    large = spark.createDataFrame([("1e25",), ("x",)], "v string")
    assert aggregates.selection_summary(large).first()["sum"] == pytest.approx(1e25)


def test_queries_from_a_table_in_passes(spark, monkeypatch):
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    data = spark.createDataFrame([(i, vector()) for i in range(80)], "vec_id bigint, embedding array<double>")
    queries = [(q, vector()) for q in range(9)]
    whole = [(*r[:3], round(r[3], 9)) for r in got(paging.vector_topk(data, queries, 3))]
    monkeypatch.setattr(paging, "QUERY_CELLS", 12)
    monkeypatch.setattr(paging, "SCORE_CELLS", 20)
    frame = spark.createDataFrame(queries, "id bigint, v array<double>")
    assert [(*r[:3], round(r[3], 9)) for r in got(paging.vector_topk(data, frame, 3))] == whole
    assert paging.vector_topk(data, frame.limit(0), 3).count() == 0


def test_repeated_keys_need_a_sequence(spark):
    source = spark.createDataFrame([(1, 9, 1), (1, 2, 2)], "k int, v int, seq int")
    target = spark.createDataFrame([(1, 0, 0)], "k int, v int, seq int")
    with pytest.raises(ValueError, match="Duplicate"):
        transfer.transfer_upsert(source, target, ["k"])
    assert got(transfer.transfer_upsert(source, target, ["k"], "seq")) == [(1, 2, 2)]


def test_inserting_upsert_applies_all_operators(spark):
    df = spark.createDataFrame([(1, [1], 2)], "k int, tags array<int>, n int")
    out = transfer.upsert_document(df, {"k": 5}, {"$push": {"tags": 3}, "$mul": {"n": 4}, "$setOnInsert": {"n": 6}})
    assert got(out) == [(1, [1], 2), (5, [3], 24)]


def test_push_positions_and_sorts(spark):
    df = spark.createDataFrame([(1, [5, 6, 7])], "k int, v array<int>")
    out = transfer.update_documents(df, {}, {"$push": {"v": {"$each": [1, 2], "$position": -1}}})
    assert out.first()["v"] == [5, 6, 1, 2, 7]


def test_search_of_blank_terms_and_composite_keys(spark):
    df = spark.createDataFrame([("a|b", "c", "x"), ("a", "b|c", "x"), (None, "c", "x")], "k string, l string, v string")
    assert search.search_database({"t": (df, ["k", "l"])}, "  ").count() == 0
    keys = [r.key for r in search.search_database({"t": (df, ["k", "l"])}, "x").collect()]
    assert len(set(keys)) == 3 and '{"k":null,"l":"c"}' in keys


@pytest.mark.parametrize("glob, yes, no", [
    ("user:[0-9]*", "user:42", "user:x"), ("h[^e]llo", "hallo", "hello"), (r"a\*b", "a*b", "axb"), ("x[a]", "xa", "xb"), ("a[b", "a[b", "ab"),
])
def test_key_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "k string")
    assert [r.k for r in df.where(glob_match(F.col("k"), glob)).collect()] == [yes]


def test_foreign_keys_of_an_empty_parent(spark):
    out = generate.with_foreign_key(spark.range(3), "id", "p", spark.range(0).withColumnRenamed("id", "k"), "k")
    assert [r.p for r in out.collect()] == [None] * 3


# One plain column name for each name pattern, in order.
NAMES = (
    "e_mail phone passport bank_card driver_license fname surname nickname gender town country postcode street "
    "website ip ipv6 mac guid company dept colour position remark status upc sku product kind size weight dir "
    "filename ext host ver locale currency slug keyword tier creator"
).split()


@pytest.mark.parametrize("name, pattern", list(zip(NAMES, generate.NAME_PATTERNS, strict=True)))
def test_every_name_pattern(name, pattern):
    assert re.search(pattern[0], name, re.I)
    first = next(key for regex, key in generate.NAME_PATTERNS if re.search(regex, name, re.I))
    assert generate.guess_generator(name, "varchar", False) == first  # an earlier pattern may win


def test_checksum_query_deals_rows_by_size(spark, small):
    from tablewright.plans import load

    plan = load()[0]["table_equal_checksum"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RebalancePartitions") == 2
    assert "Repartition " not in plan  # so many tasks for any size


@pytest.mark.parametrize("keep_empty", [True, False])
@pytest.mark.parametrize("most", [1, 7, 100])
def test_lookup_rows_of_heavy_keys(spark, keep_empty, most):
    left = spark.createDataFrame([(i, None if i % 5 == 0 else i % 4) for i in range(60)] + [(99, 77)], "id int, k int").repartition(3)
    foreign = spark.createDataFrame([(100 + i, None if i % 6 == 0 else i % 3) for i in range(70)] + [(999, 50)], "fid int, f int")
    plain = got(relate.lookup_rows(left, foreign, "k", "f", "x", keep_empty))
    cut = relate.lookup_rows(left, foreign, "k", "f", "x", keep_empty, most)
    assert got(cut) == plain
    # The output of a key is dealt to many tasks: its left rows meet copies of its foreign rows.
    assert "_piece" in cut._jdf.queryExecution().optimizedPlan().toString()
    arrays = left.groupBy("id").agg(F.array(F.first("k"), F.lit(2), F.lit(None).cast("int")).alias("k"))
    assert got(relate.lookup_rows(arrays, foreign, "k", "f", "x", False, most)) == got(relate.lookup_rows(arrays, foreign, "k", "f", "x", False))


@pytest.mark.parametrize("here, there, most", [(3, 4000, 8000), (4000, 3, 8000), (400, 300, 14_000)])
@pytest.mark.parametrize("keep_empty", [True, False])
def test_copies_of_heavy_keys_grow_with_the_sides(spark, here, there, most, keep_empty):
    left = spark.range(here + 5, numPartitions=3).selectExpr("id", f"IF(id < {here}, 1, IF(id % 2 = 0, NULL, 2)) AS k")
    foreign = spark.range(there, numPartitions=2).selectExpr("id AS _id", "1 AS f")
    cut = relate.lookup_rows(left, foreign, "k", "f", "x", keep_empty, 1)
    sums = F.sum(F.xxhash64("id", "x") % 1000), F.count("*"), F.count("x")
    assert cut.agg(*sums).first() == relate.lookup_rows(left, foreign, "k", "f", "x", keep_empty).agg(*sums).first()
    assert cut.count() == here * there + (5 if keep_empty else 0)
    # Rows of both sides that reach the join: they were as many as the output where that was very large.
    plan = cut._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    reach = sum(type(cut)(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().apply(i)), spark).count() for i in (0, 1))
    assert reach <= most
