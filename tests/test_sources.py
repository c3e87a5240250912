"""Files, exports, snapshots, search, metadata and logs."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import logs, metadata, search
from tablewright.sources import readers, writers


def put(folder, name, text, encoding="utf-8"):
    path = f"{folder}/{name}"
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def got(df):
    return [tuple(r) for r in df.collect()]


def test_delimited_header_and_quotes(spark, folder):
    path = put(folder, "a.csv", '﻿id, ,name\n1,x,"a ""b"", c"\n007,,\n')
    df = readers.read_delimited(spark, path, empty_as_null=True)
    assert df.columns == ["id", "column_2", "name"]
    assert got(df) == [("1", "x", 'a "b", c'), ("007", None, None)]


def test_delimited_without_header_trimmed(spark, folder):
    path = put(folder, "a.tsv", " 1\tx \n2\ty\n")
    df = readers.read_delimited(spark, path, sep="\t", header=False, trim=True)
    assert df.columns == ["column_1", "column_2"] and got(df) == [("1", "x"), ("2", "y")]


def test_delimited_rows(spark, folder):
    path = put(folder, "a.csv", "junk\nid,v\nskip,skip\n1,a\n2,b\n3,c\n")
    df = readers.read_delimited(spark, path, title_row=2, first_row=4, last_row=5)
    assert df.columns == ["id", "v"] and sorted(got(df)) == [("1", "a"), ("2", "b")]
    with pytest.raises(ValueError, match="last row"):
        readers.read_delimited(spark, path, first_row=5, last_row=3)
    with pytest.raises(ValueError, match="one byte"):
        readers.read_delimited(spark, path, sep="||")


def test_delimited_encoding(spark, folder):
    path = put(folder, "g.csv", "名,v\n值,1\n", "gbk")
    df = readers.read_delimited(spark, path, encoding="GBK")
    assert df.columns == ["名", "v"] and got(df) == [("值", "1")]
    ranged = readers.read_delimited(spark, path, encoding="GBK", first_row=2)
    assert ranged.columns == ["名", "v"] and got(ranged) == [("值", "1")]


def test_json_shapes(spark, folder):
    objects = put(folder, "o.json", '[{"a": 1}, {"b": {"x": 2}, "a": null}]')
    df = readers.read_json_rows(spark, objects)
    assert df.columns == ["a", "b"] and sorted(got(df), key=repr) == [("1", None), (None, '{"x":2}')]
    arrays = put(folder, "r.json", '[[1, "x"], [2], [3, "y", true]]')
    df = readers.read_json_rows(spark, arrays)
    assert df.columns == ["column_1", "column_2", "column_3"] and ("2", None, None) in got(df)
    with pytest.raises(ValueError, match="all objects or all arrays"):
        readers.read_json_rows(spark, put(folder, "m.json", "[[1], {}]"))


def test_preview_dispatch(spark, folder):
    assert readers.preview(spark, put(folder, "x.csv", "a,b\n1,2\n3,4\n"), 1).count() == 1
    assert readers.preview(spark, "x.bin") is None


def test_export_lines(spark):
    df = spark.createDataFrame([(1, 'a"b|c\nd', None, [1])], "i int, s string, n string, a array<int>")
    assert got(writers.csv_lines(df)) == [('"1","a""b|c\nd",,"[1]"',)]
    assert got(writers.csv_lines(df, '""')) == [('"1","a""b|c\nd","","[1]"',)]
    assert got(writers.tsv_lines(df)) == [('1\t"a""b|c\nd"\t\t[1]',)]
    assert got(writers.markdown_lines(df)) == [('| 1 | a"b\\|c<br>d | NULL | [1] |',)]
    assert got(writers.json_lines(df)) == [('{"i":1,"s":"a\\"b|c\\nd","n":null,"a":[1]}',)]


def test_csv_parts_join_to_one_file(spark, folder):
    import glob
    writers.write_csv(spark.range(50).repartition(4), f"{folder}/out")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{folder}/out/part-*")))
    lines = text.splitlines()
    assert lines[0] == "id" and sorted(int(x.strip('"')) for x in lines[1:]) == list(range(50))


def test_insert_batches(spark):
    rows = writers.insert_lines(spark.range(250), "t", ["id"]).orderBy("batch_no").collect()
    assert [r["statement"].count("(") - 1 for r in rows] == [100, 100, 50]
    assert rows[0]["statement"].startswith('INSERT INTO "t" ("id") VALUES\n(0),\n(1)')


def test_replace_table_from_itself(spark, folder):
    path = f"{folder}/t"
    spark.range(5).write.parquet(path)
    for _ in range(2):
        writers.replace_table(spark.read.parquet(path).select((F.col("id") + 1).alias("id")), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3, 4, 5, 6]


def test_table_patterns():
    names = ["db.public.users", "db.public.orders", "db.audit.log"]
    assert writers.selected_tables(names, ["public.*"], ["*users"]) == ["db.public.orders"]
    assert writers.selected_tables(names, [], ["db.audit.*"]) == names[:2]
    assert writers.selected_tables(names, ["log"], []) == names[2:]


def test_search_term_rules(spark):
    df = spark.createDataFrame([(1, "50% off", 7, bytearray(b"7")), (7, "a_b", 5, None)], "id int, t string, n int, b binary")
    hits = lambda term: got(search.search_table(df, "t", ["id"], term).select("key", "matched_columns").orderBy("key"))
    assert hits("7") == [("1", "n"), ("7", "id")] and hits("%") == [("1", "t")] and hits(" A_ ") == [("7", "t")]


def test_locator(spark):
    df = spark.createDataFrame([(1, None, "hit"), (2, "hit", "hit")], "id int, a string, b string")
    keyed = got(search.search_hit_locator(df, ["id", "a"], "hit").select("locator").orderBy("id"))
    assert keyed == [('"id" = 1 AND "a" IS NULL',), ('"id" = 2 AND "a" = \'hit\'',)]


def test_header_search():
    assert search.search_headers(["id", "UserName", "name"], "NAME") == [(1, "UserName"), (2, "name")]


def test_identifier_mentions(spark):
    df = spark.createDataFrame([("select user_id from t",), ('x "user_id"',), ("my_user_id",), ("user_id2",), ("[USER_ID]",), ("$user_id",)], "s string")
    assert [r[0] for r in df.select(metadata.mentions(F.col("s"), "user_id")).collect()] == [True, True, False, False, True, False]


def test_lineage_of_a_whole_catalog(spark):
    """One index of all statements gives what a search per column gives."""
    columns = [("users", "email"), ("Users", "ID"), ("T_A#5", "two words"), ("t_a#5", "a.b"), ("x$y", "email"), ("é", "caf\\E.*"), (None, "id"), ("orders", None)]
    views = spark.createDataFrame([
        ("s", "v1", 'SELECT "Email" FROM users'), ("s", "v2", "select emails, id from t_A#5 where [two words] = 1"), (None, "v3", "a.b + A.bc `T_A#5`"),
        ("s", "v4", None), ("s", "v5", "caf\\E.* id$ x$y"), ("s", "v6", "aa.b two words T_A#55 email"),
    ], "schema_name string, name string, ddl string")
    history = spark.createDataFrame([(1, "update USERS set EMAIL = 1", "2024"), (2, "email_id; id", "2024"), (3, "", "2024")], "id int, sql_text string, executed_at string")
    targets = spark.createDataFrame(columns, "table_name string, name string")
    got = metadata.lineage_references(targets.unionAll(targets), views, history)
    want = []
    for table, name in columns:
        if table and name:
            for r in metadata.lineage_column(table, name, views=views, history=history).collect():
                want.append((table.lower(), name.lower(), r["kind"], r["confidence"], r["schema_name"], r["ref"]))
    assert sorted({(*r,) for r in got.collect()}, key=repr) == sorted(set(want), key=repr) and got.count() == len(set(want)) >= 12
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_lineage_rows_cross_no_shuffle(spark):
    """Targets times statements rows come out; only the statements and the targets are shuffled."""
    targets = spark.range(40).selectExpr("concat('t', id % 20) AS table_name", "concat('c', id DIV 4) AS name")
    views = spark.range(50).selectExpr(
        "'s' AS schema_name", "IF(id = 7, NULL, concat('v', id)) AS name", "concat_ws(' ', transform(sequence(0, 9), i -> concat('C', i)), concat('t', id % 20), repeat('\\n', 3)) AS ddl")
    history = spark.createDataFrame([(1, None), (2, "c1\nT1"), (3, "$c1 c1x é")], "id int, sql_text string")
    out = metadata.lineage_references(targets, views, history)
    rows = got(out)
    assert len(rows) == 50 * 40 + 4 and len(set(rows)) == len(rows)
    assert sum(r[3] == "likely" for r in rows) == sum((id % 20) == v % 20 for id in range(40) for v in range(50))
    assert sorted(r[:4] for r in rows if r[5] == "2") == [(f"t{i}", "c1", "historyReference", "possible") for i in (4, 5, 6, 7)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert plan.index("BroadcastHashJoin") < plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
    parts = metadata.lineage_references(targets, views, history, most=7)
    assert sorted(got(parts), key=repr) == sorted(rows, key=repr)
    final = parts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("- Exchange hashpartitioning") == 1 < final.count("ReusedExchange")  # of the statements, for all parts


def test_lineage_of_names_with_line_ends(spark):
    views = spark.createDataFrame([("v", "a id b"), ("w", "a id\nb")], "name string, ddl string")
    targets = spark.createDataFrame([("a", "id\n"), ("b\n", "id")], "table_name string, name string")
    assert sorted((r.tc, r.confidence, r.ref) for r in metadata.lineage_references(targets, views).collect()) == [
        ("id", "possible", "v"), ("id", "possible", "w")]  # "id\n" is followed by a word in w
    views = views.withColumn("ddl", F.concat("ddl", F.lit(" id\n b\n")))
    assert sorted((r.tc, r.confidence, r.ref) for r in metadata.lineage_references(targets, views, most=1).collect()) == [
        ("id", "likely", "v"), ("id", "likely", "w"), ("id\n", "likely", "v"), ("id\n", "likely", "w")]


def test_lineage(spark):
    columns = spark.createDataFrame([("s", "orders", "user_id"), ("s", "users", "email"), ("s", "subscribers", "email")], "schema_name string, table_name string, name string")
    fks = spark.createDataFrame([("s", "orders", "fk", "user_id", "users", "id")], "schema_name string, table_name string, name string, column_name string, ref_table string, ref_column string")
    views = spark.createDataFrame([("s", "v", "select email from users"), ("s", "w", "select email from x")], "schema_name string, name string, ddl string")
    history = spark.createDataFrame([("1", "select u.email from users u", 5)], "id string, sql_text string, executed_at int")
    out = metadata.lineage_column("users", "email", "s", columns, fks, views, history)
    assert sorted((r["kind"], r["confidence"], r["ref"] or r["table_name"]) for r in out.collect()) == [
        ("historyReference", "likely", "1"), ("sameName", "possible", "subscribers"), ("viewReference", "likely", "v"), ("viewReference", "possible", "w")]
    assert tuple(metadata.lineage_counts(out).first()) == (0, 2, 2)
    into = metadata.lineage_column("users", "id", None, columns, fks)
    assert [(r["direction"], r["table_name"], r["column_name"]) for r in into.collect()] == [("incoming", "orders", "user_id")]


def test_fk_order():
    names = ["items", "orders", "users", "x", "y"]
    fks = [("items", "orders"), ("orders", "users"), ("x", "y"), ("y", "x"), ("users", "users")]
    assert metadata.fk_table_order(names, fks) == ["users", "orders", "items", "x", "y"]
    assert metadata.fk_table_order(names, fks, parents_first=False) == ["items", "orders", "users", "x", "y"]


@pytest.mark.parametrize("sql, want", [
    ("select 1", "query"), ("-- drop\nselect 1", "query"), ("select 1; drop table t", "schema_change"), ("insert into t select 1; alter table x add y int", "schema_change"),
    ("/* x */ update t set a = 1", "data_change"), ("updated_at = 3", "query"), ("# note\ntruncate t", "data_change"),
])
def test_activity(spark, sql, want):
    assert spark.createDataFrame([(sql,)], "s string").select(logs.activity_classify(F.col("s"))).first()[0] == want


def test_log_pages_survive_equal_times(spark):
    rows = [(i, f"2024-01-01 00:00:{i // 10:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, executed_at string").withColumn("executed_at", F.col("executed_at").cast("timestamp_ntz"))
    seen, cursor = [], None
    while True:
        page = logs.log_search_page(df, 7, cursor).collect()
        seen += [r["id"] for r in page]
        assert all(r["total"] == 60 for r in page)
        if not page[-1]["has_more"]:
            break
        cursor = (page[-1]["executed_at"], page[-1]["id"])
    assert seen == list(range(59, -1, -1))


def test_range_of_lines_spans_ordered_files(spark, monkeypatch):
    from tablewright.plans import load, moving

    write, parts = moving.writers.write_lines, []

    def counted(lines, path, *rest):
        parts.append(lines.rdd.getNumPartitions())
        write(lines, path, *rest)

    monkeypatch.setattr(moving.writers, "write_lines", counted)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many files as partitions
    try:
        rows = load()[0]["read_delimited_range"](spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert parts[0] > 1
    assert sorted(int(r.id) for r in rows) == list(range(50, 150))
