"""Keyed diff, sync and changesets on tiny frames."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import changeset, diff, sync

SCHEMA = "id bigint, name string, active boolean"


@pytest.fixture(scope="module")
def sides(spark):
    source = spark.createDataFrame([(1, "Ada", True), (2, "Bob", False), (4, "Dora", True)], SCHEMA)
    target = spark.createDataFrame([(1, "Ada", True), (2, "Bobby", False), (3, "Cara", True)], SCHEMA)
    return source, target


def test_statuses_and_changes(sides):
    rows = {r["id"]: r for r in diff.diff_rows(*sides, ["id"]).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {4: "added", 3: "removed", 2: "modified"}
    assert [tuple(c) for c in rows[2]["changes"]] == [("name", "Bob", "Bobby")]
    assert rows[4]["changes"] == [] and rows[4]["s_name"] == "Dora"


def test_null_keys_and_null_cells_are_equal(spark):
    a = spark.createDataFrame([(None, "x", 1.0), (1, None, float("nan"))], "k int, v string, d double")
    b = spark.createDataFrame([(None, "y", 1.0), (1, None, None)], "k int, v string, d double")
    rows = diff.diff_rows(a, b, ["k"]).collect()
    assert [(r["k"], r["status"], r["changed_columns"]) for r in rows] == [(None, "modified", "v")]


def test_composite_key(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "a int, b int, v string")
    b = spark.createDataFrame([(1, 1, "x"), (2, 2, "x")], "a int, b int, v string")
    rows = diff.diff_rows(a, b, ["a", "b"]).collect()
    assert sorted((r["status"], r["a"], r["b"]) for r in rows) == [("added", 1, 2), ("removed", 2, 2)]


def test_duplicate_key_names_the_side(sides):
    source, target = sides
    with pytest.raises(diff.DuplicateKeyError, match="Duplicate source key: id=1"):
        diff.diff_rows(source.unionAll(source.where("id = 1")), target, ["id"])


def test_keys_are_required(sides):
    with pytest.raises(ValueError, match="at least one key"):
        diff.diff_rows(*sides, [])


def test_table_equal_as_bags(sides):
    source, _ = sides
    twice = source.unionAll(source)
    assert diff.table_equal(twice, twice).first()[0] == "same"
    assert diff.table_equal(twice, source).first()[0] == "different"
    assert diff.table_equal(source, source, ["id"]).first()[0] == "same"


def test_missing_target_indexes_rows(sides):
    rows = diff.diff_missing_target(sides[0]).collect()
    assert len({r["row_index"] for r in rows}) == 3 and {r["status"] for r in rows} == {"added"}


def test_sync_plan_ignores_generated_columns(sides):
    plan = sync.sync_plan(*sides, ["id"], generated=["name"]).first()
    assert (plan["inserts"], plan["updates"], plan["deletes"], plan["statements"]) == (1, 0, 1, 2)
    assert sync.sync_plan(*sides, ["id"]).first()["updates"] == 1


def test_statements(sides):
    text = {r["id"]: r["statement"] for r in sync.sync_statements(*sides, ["id"], "people").collect()}
    assert text == {
        4: """INSERT INTO "people" ("id", "name", "active") VALUES (4, 'Dora', TRUE);""",
        2: """UPDATE "people" SET "name" = 'Bob' WHERE "id" = 2;""",
        3: """DELETE FROM "people" WHERE "id" = 3;""",
    }


def test_generated_columns_leave_the_statements(sides):
    rows = sync.sync_statements(*sides, ["id"], "p", generated=["name"]).collect()
    assert [r["step"] for r in sorted(rows)] == [1, 3]
    every = sync.sync_statements(*sides, ["id"], "p", generated=["id", "name", "active"]).where("step = 1").first()
    assert every["statement"] == 'INSERT INTO "p" DEFAULT VALUES;'


def test_update_batch_uses_case(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, n int")
    b = spark.createDataFrame([(1, "x", 1), (2, "y", 9)], "id int, v string, n int")
    rows = sync.sync_update_batches(a, b, ["id"], "t").collect()
    assert [r["statement"] for r in rows] == [
        """UPDATE "t" SET "v" = CASE WHEN "id" = 1 THEN 'a' WHEN "id" = 2 THEN 'b' ELSE "v" END, """
        """"n" = CASE WHEN "id" = 2 THEN 2 ELSE "n" END WHERE ("id" = 1) OR ("id" = 2);"""
    ]


def test_apply_choices(sides):
    def after(**kw):
        return sorted((r["id"], r["name"]) for r in sync.sync_apply(*sides, ["id"], **kw).collect())

    assert after() == [(1, "Ada"), (2, "Bob"), (4, "Dora")]
    assert after(delete=False) == [(1, "Ada"), (2, "Bob"), (3, "Cara"), (4, "Dora")]
    assert after(update=False, insert=False) == [(1, "Ada"), (2, "Bobby")]


def test_apply_keeps_target_only_columns(spark, sides):
    source, target = sides
    wide = target.withColumn("extra", F.col("id") * 10)
    rows = sync.sync_apply(source, wide, ["id"]).collect()
    assert sorted((r["id"], r["extra"]) for r in rows) == [(1, 10), (2, 20), (4, None)]


CHANGES = "op string, id int, column string, value string, seq int"


def test_changeset_and_its_inverse(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, v string, n double")
    changes = spark.createDataFrame([
        ("update", 1, "v", "z", 1), ("update", 1, "v", "zz", 2), ("update", 2, "n", None, 3),
        ("delete", 3, None, None, 4), ("insert", 9, "v", "new", 5),
    ], CHANGES)
    done = changeset.changeset_apply(base, changes, ["id"], {"n": "7"})
    assert sorted(tuple(r) for r in done.collect()) == [(1, "zz", 1.0), (2, "b", None), (9, "new", 7.0)]
    undo = changeset.changeset_rollback(base, changes, ["id"]).withColumn("seq", F.lit(1))
    back = changeset.changeset_apply(done, undo, ["id"])
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in base.collect())


def test_changeset_refuses_null_keys_and_skips_generated(spark):
    bad = spark.createDataFrame([("update", None, "v", "z", 1)], CHANGES)
    schema = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType(), True, {"generated": True}),
    ])
    base = spark.createDataFrame([(1, "a")], schema)
    with pytest.raises(changeset.InvalidChangeset):
        changeset.changeset_apply(base, bad, ["id"])
    edit = spark.createDataFrame([("update", 1, "v", "z", 1)], CHANGES)
    assert changeset.changeset_apply(base, edit, ["id"]).first()["v"] == "a"
