"""Comparison by checksums against the whole join."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import checksums, diff
from tablewright.plans.diffing import perturbed


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("range_rows", [20, 100, 1_000_000])
def test_same_rows_as_the_join(tables, range_rows):
    target = perturbed(tables.orders)
    assert rows(checksums.diff_rows(tables.orders, target, ["o_orderkey"], range_rows=range_rows)) == rows(
        diff.diff_rows(tables.orders, target, ["o_orderkey"])
    )
    assert rows(checksums.diff_summary(tables.orders, target, ["o_orderkey"], range_rows=range_rows)) == rows(
        diff.diff_summary(tables.orders, target, ["o_orderkey"])
    )


SCHEMA = "k int, t string, at timestamp_ntz, x double, a array<string>, m map<string,int>, s struct<p:string,q:string>"


def table(spark, seed, n):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    return spark.createDataFrame([
        (None if i == 7 else i, pick("a", None, "b"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), pick(None, 0.0, -0.0, float("nan"), 1.5),
         pick(["x", None], [None, "x"], None, []), pick({"a": 1, "b": None}, {"b": None, "a": 1}, {}), pick(("p", None), (None, "p"), None))
        for i in range(n)
    ], SCHEMA)


@pytest.mark.parametrize("keys", [["k"], ["at"], ["t", "k"], ["x", "k"], ["s", "k"]])
def test_odd_values_and_keys(spark, keys):
    source, target = table(spark, 1, 400), table(spark, 2, 410).withColumn("k", F.col("k").cast("bigint"))
    want = diff.diff_rows(source, target, keys, checked=False).drop("changes")
    assert rows(checksums.diff_rows(source, target, keys, checked=False, range_rows=25).drop("changes")) == rows(want)
    same = checksums.differing(source, source.repartition(3), keys, range_rows=25)
    assert [df.count() for df in same] == [0, 0]


def test_nulls_are_not_skipped_by_the_hash(spark):
    a = spark.createDataFrame([(1, None, "x", [None, "y"])], "k int, p string, q string, a array<string>")
    b = spark.createDataFrame([(1, "x", None, ["y", None])], a.schema)
    assert checksums.diff_rows(a, b, ["k"]).first()["changed_columns"] == "p,q,a"
    assert checksums.table_equal(a, b).first()[0] == "different"


def test_bags(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    once = spark.createDataFrame([(1, "x"), (2, None), (2, None)], a.schema)
    assert checksums.table_equal(a, a.repartition(2)).first()[0] == "same"
    assert checksums.table_equal(a, once).first()[0] == "different"
    assert checksums.table_equal(a.limit(0), a.limit(0)).first()[0] == "same"


def test_empty_and_repeated(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    none = a.limit(0)
    assert checksums.diff_summary(none, none, ["k"]).first()[:4] == (0, 0, 0, "same")
    assert checksums.diff_summary(a, none, ["k"]).first()[:3] == (2, 0, 0)
    with pytest.raises(diff.DuplicateKeyError):
        checksums.diff_rows(a.unionAll(a), a, ["k"])
    with pytest.raises(ValueError):
        checksums.diff_rows(a, a, [])


def below(node, name):
    """Names of the nodes under each node called ``name``."""
    children = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "AdaptiveSparkPlan":
        children = [node.initialPlan()]
    found = []
    for child in children:
        found += below(child, name)
    if name in node.nodeName():
        found.append(node.toString())
    return found


def test_equal_ranges_are_never_shuffled(spark, folder):
    """One part of the key range differs; the rest is filtered in the scan, below every exchange."""
    spark.range(40_000).select("id", (F.col("id") * 7 % 1000).alias("v")).repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(f"{folder}/a")
    a = spark.read.parquet(f"{folder}/a")
    b = a.withColumn("v", F.when(F.col("id").between(9_000, 9_040), -1).otherwise(F.col("v")))
    left, right = checksums.differing(a, b, ["id"], range_rows=1000)
    assert 41 <= left.count() <= 1_000 and right.count() == left.count()
    result = checksums.diff_rows(a, b, ["id"], checked=False, range_rows=1000)
    assert result.count() == 41
    plan = result._jdf.queryExecution().executedPlan()
    exchanges = [e for e in below(plan, "Exchange") if "hashpartitioning" in e and "FileScan" in e]
    assert exchanges
    for text in exchanges:
        assert "BroadcastHashJoin" in text and "LeftSemi" in text  # only rows of leaves that differ
        assert "GreaterThanOrEqual(id," in text  # and the scan skips other keys
