"""Rewritten stage lists give the rows of the lists as they stand, without arrays of hot keys."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import stages
from tablewright.operators.stage_plan import rewrite

LOOKUP = {"$lookup": {"from": "items", "localField": "k", "foreignField": "k", "as": "found"}}
PUSH = {"$group": {"_id": "$g", "all": {"$push": {"input": "$v", "sortBy": {"v": 1}}}, "total": {"$sum": "$v"}}}
LISTS = {
    "count": [LOOKUP, {"$count": "n"}],
    "match first": [LOOKUP, {"$match": {"v": {"$gt": 5}}}, {"$project": {"v": 1, "n": {"$size": "$found"}}}],
    "size": [LOOKUP, {"$addFields": {"n": {"$size": "$found"}}}, {"$match": {"n": {"$gt": 1}}}, {"$project": {"found": 0}}],
    "size in group": [LOOKUP, {"$group": {"_id": "$g", "most": {"$max": {"$size": "$found"}}}}],
    "unread": [LOOKUP, {"$group": {"_id": "$g", "n": {"$sum": 1}}}],
    "read": [LOOKUP, {"$addFields": {"n": {"$size": "$found"}}}, {"$sort": {"v": 1}}],
    "push then count": [PUSH, {"$count": "groups"}],
    "push then size": [PUSH, {"$project": {"_id": 1, "total": 1, "n": {"$size": "$all"}}}],
    "push then unwind": [PUSH, {"$unwind": "$all"}],
    "set unread": [{"$group": {"_id": "$g", "s": {"$addToSet": "$v"}, "m": {"$max": "$v"}}}, {"$project": {"s": 0}}],
    "push kept": [PUSH, {"$match": {"total": {"$gt": 3}}}],
}


@pytest.fixture(scope="module")
def data(spark):
    left = spark.createDataFrame([(i, None if i % 9 == 0 else i % 4, "ab"[i % 2] if i % 7 else None) for i in range(40)], "v int, k int, g string")
    items = spark.createDataFrame([(None if i % 5 == 0 else i % 6, f"x{i}") for i in range(30)], "k int, name string")
    return left, {"items": items}


def rows(df):
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items())}
        return sorted((plain(v) for v in x), key=repr) if isinstance(x, list) else x

    return sorted((json.dumps(plain(json.loads(r[0]))) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()))


@pytest.mark.parametrize("name", list(LISTS))
def test_same_rows(data, name, monkeypatch):
    got = rows(stages.apply_stages(data[0], LISTS[name], data[1]))
    monkeypatch.setattr(stages, "rewrite", lambda x: x)
    assert got == rows(stages.apply_stages(data[0], LISTS[name], data[1])) and got


@pytest.mark.parametrize("name", [n for n in LISTS if n not in ("read", "push kept")])
def test_no_array_is_built(data, name):
    plan = stages.apply_stages(data[0], LISTS[name], data[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_a_group_is_one_document_at_any_size(spark):
    df = spark.range(10_050).selectExpr("1 AS g", "id AS v")
    push = {"$group": {"_id": "$g", "all": {"$push": {"input": "$v", "sortBy": {"v": 1}}}}}
    assert stages.apply_stages(df, [push, {"$count": "n"}]).collect()[0]["n"] == 1
    whole = stages.apply_stages(df, [push]).collect()
    assert len(whole) == 1 and whole[0]["all"] == list(range(10_050)) and set(whole[0].asDict()) == {"_id", "all"}


def test_rules():
    assert rewrite([LOOKUP, {"$match": {"found.name": "x"}}])[0] == LOOKUP
    assert [next(iter(s)) for s in rewrite([LOOKUP, {"$match": {"v": 1}}, {"$count": "n"}])] == ["$match", "$count"]
    assert rewrite([LOOKUP, {"$project": {"x": "$$ROOT"}}])[0] == LOOKUP
    assert rewrite([PUSH, {"$sort": {"all": 1}}])[0] == PUSH
    assert rewrite([]) == []


def test_set_of_nothing_is_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (2, None)], "g int, v int")
    out = stages.apply_stages(df, [{"$group": {"_id": "$g", "s": {"$addToSet": "$v"}}}])
    assert {r["_id"]: r["s"] for r in out.collect()} == {1: [], 2: [3]}


def test_dotted_paths(spark):
    df = spark.createDataFrame(
        [(1, ("p", [1, 2]), [("a", 1), ("b", 2)]), (2, None, [])], "id int, s struct<x:string,l:array<int>>, items array<struct<n:string,q:int>>"
    )
    run = lambda *s: stages.apply_stages(df, list(s)).orderBy("id")
    assert run({"$project": {"s.x": 0, "items.q": 0}}).first().asDict(True) == {"id": 1, "s": {"l": [1, 2]}, "items": [{"n": "a"}, {"n": "b"}]}
    made = run({"$addFields": {"s.z": "$id", "t.u.v": {"$add": ["$id", 1]}, "items.q": 7}})
    assert made.columns == ["id", "s", "items", "t"]
    first, second = (r.asDict(True) for r in made.collect())
    assert first == {"id": 1, "s": {"x": "p", "l": [1, 2], "z": 1}, "items": [{"n": "a", "q": 7}, {"n": "b", "q": 7}], "t": {"u": {"v": 2}}}
    assert second["s"] == {"x": None, "l": None, "z": 2}
    unwound = run({"$unwind": "$s.l"}).collect()
    assert [r["s"].asDict() for r in unwound] == [{"x": "p", "l": 1}, {"x": "p", "l": 2}]
    assert stages.apply_stages(df, [{"$unwind": {"path": "$s.l", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}}]).count() == 3


def test_arrays_and_paths_in_lookups(spark):
    left = spark.createDataFrame([(1, ["a", "b"], ("a",)), (2, ["z", None], ("q",)), (3, [], (None,))], "id int, tags array<string>, s struct<t:string>")
    there = spark.createDataFrame([(10, ["a", "b"], "a"), (11, ["b", "b"], None), (12, None, "z")], "fid int, labels array<string>, one string")
    look = lambda local, foreign: {"$lookup": {"from": "f", "localField": local, "foreignField": foreign, "as": "m"}}

    def found(local, foreign, *more):
        df = stages.apply_stages(left, [look(local, foreign), *more], {"f": there})
        return {r["id"]: sorted(m["fid"] for m in r["m"]) for r in df.collect()}

    assert found("tags", "labels") == {1: [10, 11], 2: [], 3: []}
    assert found("s.t", "labels") == {1: [10], 2: [], 3: [12]}  # a missing value finds a missing one
    assert found("tags", "one") == {1: [10], 2: [12], 3: []}
    for local, foreign in (("tags", "labels"), ("s.t", "labels"), ("tags", "one"), ("s.t", "one")):
        sizes = stages.apply_stages(left, [look(local, foreign), {"$project": {"id": 1, "n": {"$size": "$m"}}}], {"f": there})
        assert {r["id"]: r["n"] for r in sizes.collect()} == {k: len(v) for k, v in found(local, foreign).items()}
