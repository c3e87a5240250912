"""Source, sink, transfer, import, update and formatter queries."""

from pyspark.sql import functions as F

from tablewright.functions import formatters, literals, temporal, typemap
from tablewright.operators import infer, stages, transfer
from tablewright.plans.registry import query
from tablewright.sources import readers, writers
from tablewright.storage import work_path


@query("scan_preview", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM (FROM orders LIMIT 1000)")
def scan_preview(t):
    assert readers.preview(t.spark, "notes.unknown") is None
    df = readers.preview(t.spark, f"{t.path}/orders.parquet")
    return df.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


RAW_SQL = """raw AS (SELECT c_custkey::VARCHAR AS id, ' ' || c_name || ' ' AS name,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_acctbal::VARCHAR END AS bal,
  strftime(TIMESTAMP '2020-01-01' + to_days((c_custkey % 900)::INT), '%Y/%m/%d') AS joined,
  CASE WHEN c_custkey % 5 = 0 THEN 'say "hi", ' || c_mktsegment ELSE c_mktsegment END AS note,
  lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS code FROM customer)"""


def raw_text(t):
    return t.customer.selectExpr(
        "CAST(c_custkey AS STRING) AS id", "concat(' ', c_name, ' ') AS name",
        "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_acctbal AS STRING) END AS bal",
        "date_format(date_add(DATE '2020-01-01', CAST(c_custkey % 900 AS INT)), 'yyyy/MM/dd') AS joined",
        "CASE WHEN c_custkey % 5 = 0 THEN concat('say \"hi\", ', c_mktsegment) ELSE c_mktsegment END AS note",
        "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') AS code",
    )


@query("read_delimited", f"""WITH {RAW_SQL}
SELECT id, trim(name) AS name, nullif(bal, '') AS bal, joined, note, code FROM raw""")
def read_delimited(t):
    path = work_path(t.spark, "delimited")
    raw_text(t).write.csv(path, header=True, sep=";", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
                          ignoreTrailingWhiteSpace=False)
    return readers.read_delimited(t.spark, path, sep=";", trim=True, empty_as_null=True)


@query("read_delimited_range", f"""WITH {RAW_SQL}
SELECT id, bal, code FROM raw WHERE id::BIGINT BETWEEN 50 AND 149""")
def read_delimited_range(t):
    path = work_path(t.spark, "ranged")
    lines = writers.csv_lines(raw_text(t).select("id", "bal", "code"))
    body = lines.withColumn("n", F.regexp_extract("line", '^"(\\d+)"', 1).cast("bigint")).repartitionByRange("n").sortWithinPartitions("n")
    writers.write_lines(body.select("line"), path)
    # No title row: data lines 51 to 150 are the customers 50 to 149.
    df = readers.read_delimited(t.spark, path, header=False, title_row=1, first_row=51, last_row=150)
    return df.toDF("id", "bal", "code")


@query("read_json_rows", """
SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 2 = 0 THEN p_name END AS name, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR END AS size FROM part""")
def read_json_rows(t):
    path = work_path(t.spark, "json")
    docs = t.part.selectExpr("p_partkey AS id", "CASE WHEN p_size % 2 = 0 THEN p_name END AS name",
                             "CASE WHEN p_size % 3 = 0 THEN p_size END AS size")
    docs.write.json(path)  # NULL fields are left out, so keys differ per row
    return readers.read_json_rows(t.spark, path, multi_line=False).select("id", "name", "size")


@query("read_documents", """
SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN event_type END AS tag FROM events""")
def read_documents(t):
    docs = t.events.select(F.concat(
        F.lit('{"event_id": '), "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "tag": "'), "event_type", F.lit('"'))).otherwise(""),
        F.lit(", "), F.substring("props", 2, 1000),
    ).alias("doc"))
    return readers.read_documents(docs, "doc").select("event_id", "k", "tag")


@query("write_csv", """
SELECT concat_ws(',', '"' || o_orderkey || '"', CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '"' || o_orderstatus || '"' END,
  '"' || o_totalprice || '"', '"' || replace('say "' || o_orderpriority || '"', '"', '""') || '"') AS line FROM orders""")
def write_csv(t):
    rows = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS st", "o_totalprice",
                               "concat('say \"', o_orderpriority, '\"') AS note")
    return writers.round_trip(writers.csv_lines(rows), "csv")


@query("write_tsv", """
SELECT concat_ws(chr(9), c_custkey::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN '"a' || chr(9) || c_name || '"' ELSE c_name END,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END) AS line FROM customer""")
def write_tsv(t):
    rows = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN concat('a\\t', c_name) ELSE c_name END AS n",
                                 "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS s")
    return writers.round_trip(writers.tsv_lines(rows), "tsv")


@query("write_json", """
SELECT '{"c_custkey":' || c_custkey || ',"name":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_name || '"' END
  || ',"tags":["' || c_mktsegment || '"]}' AS line FROM customer""")
def write_json(t):
    rows = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name", "array(c_mktsegment) AS tags")
    path = work_path(t.spark, "jsonl")
    writers.write_json(rows, path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("write_markdown", r"""
SELECT '| ' || c_custkey || ' | ' || replace('a|b' || c_name, '|', '\|') || ' | ' ||
  CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE 'x<br>' || c_mktsegment END || ' |' AS line FROM customer""")
def write_markdown(t):
    rows = t.customer.selectExpr("c_custkey", "concat('a|b', c_name) AS n", "CASE WHEN c_custkey % 3 <> 0 THEN concat('x\\n', c_mktsegment) END AS s")
    return writers.round_trip(writers.markdown_lines(rows), "md")


@query("write_sql_inserts", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer)
SELECT rn // 100 AS batch_no, 'INSERT INTO "customer" ("c_custkey", "c_name", "c_acctbal") VALUES' || chr(10) ||
  string_agg('(' || c_custkey || ', ''O''''' || c_name || ''', ' || c_acctbal || ')', ',' || chr(10) ORDER BY rn) || ';' AS statement
FROM r GROUP BY 1""")
def write_sql_inserts(t):
    rows = t.customer.selectExpr("c_custkey", "concat('O\\'', c_name) AS c_name", "c_acctbal")
    return writers.insert_lines(rows, "customer", ["c_custkey"])


@query("export_filtered", """
SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS o_orderdate, o_totalprice FROM orders
WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""")
def export_filtered(t):
    return writers.export_filtered(
        t.orders, ["o_orderkey", "o_orderdate", "o_totalprice"], "o_orderstatus = 'F'",
        [F.desc("o_totalprice"), "o_orderkey"], 500, "DD.MM.YYYY HH:mm",
    )


@query("snapshot_tables", """
SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'nation', count(*) FROM nation""")
def snapshot_tables(t):
    root = work_path(t.spark, "snapshots")
    tables = {f"db.main.{n}": getattr(t, n) for n in ("customer", "orders", "nation", "region", "supplier")}
    names = writers.snapshot_tables(tables, root, "s1", ["main.*"], ["*region", "db.main.supp*"])
    counts = [writers.read_snapshot(t.spark, root, "s1", n).agg(F.lit(n.split(".")[-1]).alias("name"), F.count("*").alias("n")) for n in names]
    return writers.union_all(counts)


@query("snapshot_prune", """
WITH runs AS (SELECT event_id AS run_id, user_id AS schedule_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status, ts FROM events)
SELECT run_id, schedule_id FROM runs WHERE status = 'success'
QUALIFY row_number() OVER (PARTITION BY schedule_id ORDER BY ts DESC, run_id DESC) > 7""")
def snapshot_prune(t):
    runs = t.events.selectExpr("event_id AS run_id", "user_id AS schedule_id", "CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status", "ts AS started_at")
    return writers.snapshot_prune(runs, 7).select("run_id", "schedule_id")


@query("literal_rows", """
SELECT v.code, v.label, count(*) AS orders FROM (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) v(code, label)
JOIN orders ON o_orderstatus = code GROUP BY ALL""")
def literal_rows(t):
    names = [{"code": "F", "label": "finished"}, {"code": "O", "label": "open"}, {"code": "P", "label": "pending"}]
    v = stages.literal_rows(t.spark, names, "code string, label string")
    return t.orders.join(v, F.col("o_orderstatus") == F.col("code")).groupBy("code", "label").agg(F.count("*").alias("orders"))


@query("copy_table", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def copy_table(t):
    path = work_path(t.spark, "copy")
    writers.copy_table(t.orders, path, ["o_orderkey", "o_totalprice"])
    writers.copy_table(t.orders.where("o_orderstatus = 'F'"), path, ["o_orderkey", "o_totalprice"])
    return t.spark.read.parquet(path)


@query("copy_structure", "SELECT column_name AS name, 0 AS n FROM (DESCRIBE orders)")
def copy_structure(t):
    path = work_path(t.spark, "structure")
    writers.copy_structure(t.orders, path)
    empty = t.spark.read.parquet(path)
    return empty.agg(F.count("*").cast("int").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in empty.columns])).alias("name"), "n")


# --- transfer ------------------------------------------------------------------

CHANGES_SQL = """src AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, 'MOVED' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT s_suppkey + 70000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier)"""


def changes(t):
    moved = t.customer.where("c_custkey % 3 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 100, "c_mktsegment": F.lit("MOVED")})
    added = t.supplier.selectExpr("s_suppkey + 70000000 AS c_custkey", "s_name AS c_name", "s_nationkey AS c_nationkey", "s_acctbal AS c_acctbal", "'SUPPLIER' AS c_mktsegment")
    return moved.unionByName(added)


@query("transfer_append", f"WITH {CHANGES_SQL} SELECT * FROM customer UNION ALL SELECT * FROM src")
def transfer_append(t):
    path = work_path(t.spark, "append")
    t.customer.write.parquet(path)
    transfer.append_files(changes(t), path)
    return t.spark.read.parquet(path)


@query("transfer_overwrite", f"WITH {CHANGES_SQL} SELECT * FROM src")
def transfer_overwrite(t):
    path = work_path(t.spark, "overwrite")
    t.customer.write.parquet(path)
    target = t.spark.read.parquet(path)
    writers.replace_table(transfer.transfer_overwrite(changes(t), target), path)
    return t.spark.read.parquet(path)


@query("transfer_upsert", """
WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT c_custkey AS id, coalesce(event_type, c_mktsegment) AS tag, coalesce(value, c_acctbal) AS amount FROM customer LEFT JOIN last ON c_custkey = user_id
UNION ALL SELECT user_id, event_type, value FROM last WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def transfer_upsert(t):
    target = t.customer.selectExpr("c_custkey AS id", "c_mktsegment AS tag", "c_acctbal AS amount")
    source = t.events.selectExpr("user_id AS id", "event_type AS tag", "value AS amount", "struct(ts, event_id) AS seq")
    return transfer.transfer_upsert(source, target, ["id"], "seq")


@query("transfer_docs", """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS c_name, c_acctbal FROM customer""")
def transfer_docs(t):
    rows = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS c_name", "c_acctbal")
    return transfer.docs_to_rows(transfer.transfer_docs(rows), "document", rows.schema)


@query("merge_into", f"""WITH {CHANGES_SQL}, s AS (SELECT c_custkey, c_acctbal FROM src)
SELECT 'merge' AS mode, c.c_custkey, c_name, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN s USING (c_custkey)
UNION ALL SELECT 'merge', c_custkey, NULL, c_acctbal FROM s WHERE c_custkey >= 70000000
UNION ALL SELECT 'keep', c_custkey, c_name, c_acctbal FROM customer
UNION ALL SELECT 'replace', c.c_custkey, CASE WHEN s.c_custkey IS NULL THEN c_name END, coalesce(s.c_acctbal, c.c_acctbal) FROM customer c LEFT JOIN s USING (c_custkey)
UNION ALL SELECT 'replace', c_custkey, NULL, c_acctbal FROM s WHERE c_custkey >= 70000000""")
def merge_into(t):
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    source = changes(t).select("c_custkey", "c_acctbal")
    key = ["c_custkey"]
    parts = {
        "merge": transfer.merge_into(source, target, key, "merge"),
        "keep": transfer.merge_into(source, target, key, "keepExisting", "discard"),
        "replace": transfer.merge_into(source, target, key, "replace"),
    }
    return writers.union_all([d.select(F.lit(m).alias("mode"), "*") for m, d in parts.items()])


@query("update_documents", """
WITH p AS (SELECT *, string_split(p_name, ' ') AS w, p_size > 20 AS hit FROM part)
SELECT p_partkey, CASE WHEN hit THEN 'Set' ELSE p_type END AS p_type, CASE WHEN hit THEN p_size + 5 ELSE p_size END AS p_size,
  CASE WHEN hit THEN greatest(p_retailprice, 1000.0) ELSE p_retailprice END AS p_retailprice,
  CASE WHEN hit THEN NULL ELSE p_brand END AS p_brand, CASE WHEN hit THEN p_brand END AS label,
  array_to_string(CASE WHEN hit THEN list_sort(list_concat(w, ['a', 'z']))[1:3] ELSE w END, ',') AS pushed,
  array_to_string(CASE WHEN hit AND NOT list_contains(w, 'red') THEN list_append(w, 'red') ELSE w END, ',') AS added,
  array_to_string(CASE WHEN hit THEN w[1:1] ELSE w END, ',') AS popped,
  array_to_string(CASE WHEN hit THEN list_filter(w, lambda x: x <> 'ring') ELSE w END, ',') AS pulled,
  CASE WHEN hit THEN p_partkey & 7 ELSE p_partkey END AS bits
FROM p""")
def update_documents(t):
    p = t.part
    for name in ("pushed", "added", "popped", "pulled"):
        p = p.withColumn(name, F.split("p_name", " "))
    p = p.withColumn("bits", F.col("p_partkey"))
    out = transfer.update_documents(p, {"p_size": {"$gt": 20}}, {
        "$set": {"p_type": "Set"}, "$inc": {"p_size": 5}, "$max": {"p_retailprice": 1000.0},
        "$rename": {"p_brand": "label"}, "$push": {"pushed": {"$each": ["a", "z"], "$sort": 1, "$slice": 3}},
        "$addToSet": {"added": "red"}, "$pop": {"popped": 1}, "$pull": {"pulled": "ring"},
        "$bit": {"bits": {"and": 7}},
    })
    joined = {c: F.array_join(c, ",") for c in ("pushed", "added", "popped", "pulled")}
    return out.withColumns(joined).drop("p_name")


# --- import --------------------------------------------------------------------

@query("import_infer", """
SELECT * FROM (VALUES ('id', 0, 'integer', 'bigint'), ('name', 1, 'text', 'string'), ('bal', 2, 'text', 'string'),
  ('joined', 3, 'date', 'date'), ('code', 4, 'text', 'string'), ('price', 5, 'decimal', 'double'),
  ('mixed', 6, 'decimal', 'double'), ('seen', 7, 'timestamp', 'timestamp_ntz'), ('empty', 8, 'text', 'string'),
  ('key', 9, 'integer', 'bigint')) v("column", position, type, data_type)
WHERE (SELECT count(*) FROM customer) > 0""")
def import_infer(t):
    raw = raw_text(t).select(
        "id", "name", "bal", "joined", "code", F.concat("id", F.lit(".5")).alias("price"),
        F.when(F.col("id").cast("int") % 2 == 0, F.col("id")).otherwise(F.lit("1.5e3")).alias("mixed"),
        F.when(F.col("id").cast("int") % 2 == 0, F.col("joined")).otherwise(F.lit("2024-01-02T03:04:05Z")).alias("seen"),
        F.lit(None).cast("string").alias("empty"), F.col("id").cast("bigint").alias("key"),
    )
    return infer.import_infer(raw)


@query("project_cast_map", f"""WITH {RAW_SQL}
SELECT id::BIGINT AS customer_id, try_cast(bal AS DOUBLE) AS balance, strftime(strptime(joined, '%Y/%m/%d'), '%Y-%m-%d') AS since, code::INT AS code_no,
  try_cast(trim(name) AS DOUBLE) AS wrong FROM raw""")
def project_cast_map(t):
    out = infer.project_cast_map(raw_text(t), [
        ("id", "customer_id", "bigint"), ("bal", "balance", "double"), ("joined", "since", "date"),
        ("code", "code_no", "int"), ("name", "wrong", "double"),
    ])
    return out.withColumn("since", F.col("since").cast("string"))


@query("import_table", f"""WITH {RAW_SQL},
r AS (SELECT *, CASE WHEN id::BIGINT % 11 = 0 THEN 'n/a' ELSE bal END AS b FROM raw)
SELECT 'good' AS part, id::BIGINT AS id, strftime(strptime(joined, '%Y/%m/%d'), '%Y-%m-%d') AS joined, try_cast(b AS DOUBLE) AS bal, NULL AS bad FROM r WHERE b <> 'n/a'
UNION ALL SELECT 'rejected', id::BIGINT, joined, NULL, 'bal' FROM r WHERE b = 'n/a'""")
def import_table(t):
    raw = raw_text(t).withColumn("bal", F.when(F.col("id").cast("int") % 11 == 0, "n/a").otherwise(F.col("bal")))
    mapping = [("id", "id", "bigint"), ("joined", "joined", "date"), ("bal", "bal", "double")]
    good, bad = infer.import_table(raw, mapping)
    good = good.selectExpr("'good' AS part", "id", "CAST(joined AS STRING) AS joined", "bal", "CAST(NULL AS STRING) AS bad")
    bad = bad.selectExpr("'rejected' AS part", "CAST(id AS BIGINT) AS id", "joined", "CAST(NULL AS DOUBLE) AS bal", "bad_columns AS bad")
    return good.unionAll(bad)


@query("import_preview", "SELECT count(*) AS shown, (SELECT count(*) FROM customer) AS total FROM (FROM customer LIMIT 50)")
def import_preview(t):
    rows, total = infer.import_preview(raw_text(t))
    return rows.agg(F.count("*").alias("shown")).withColumn("total", F.lit(total.first()["total"]))


# --- formatters and literals -----------------------------------------------------

@query("fn_json_path", """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'broken {' WHEN 1 THEN '{"k": null}' WHEN 2 THEN '{"a": [{"k": "x"}, 7]}'
  WHEN 3 THEN NULL ELSE props END AS doc, props FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'broken {' WHEN 1 THEN 'NULL' WHEN 2 THEN '' WHEN 3 THEN 'NULL' ELSE props::JSON ->> 'k' END AS k,
  CASE event_id % 5 WHEN 0 THEN 'broken {' WHEN 2 THEN 'x' WHEN 3 THEN 'NULL' ELSE '' END AS nested,
  CASE event_id % 5 WHEN 0 THEN 'broken {' WHEN 2 THEN '[{"k":"x"},7]' WHEN 3 THEN 'NULL' ELSE '' END AS whole FROM e""")
def fn_json_path(t):
    e = t.events.selectExpr("event_id", """CASE event_id % 5 WHEN 0 THEN 'broken {' WHEN 1 THEN '{"k": null}'
        WHEN 2 THEN '{"a": [{"k": "x"}, 7]}' WHEN 3 THEN NULL ELSE props END AS doc""")
    path = lambda p: formatters.json_path(F.col("doc"), p)
    return e.select("event_id", path("$.k").alias("k"), path("$.a[0].k").alias("nested"), path("$.a").alias("whole"))


@query("fn_mask", """
SELECT c_custkey, left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) AS masked,
  CASE WHEN length(c_mktsegment) <= 9 THEN repeat('*', length(c_mktsegment)) ELSE left(c_mktsegment, 4) || repeat('*', length(c_mktsegment) - 9) || right(c_mktsegment, 5) END AS short,
  CASE WHEN c_custkey % 2 = 0 THEN 'NULL' ELSE repeat('*', length(c_name)) END AS hidden FROM customer""")
def fn_mask(t):
    return t.customer.select(
        "c_custkey", formatters.mask(F.col("c_name"), 3, 4).alias("masked"),
        formatters.mask(F.col("c_mktsegment"), 4, 5).alias("short"),
        formatters.mask(F.when(F.col("c_custkey") % 2 != 0, F.col("c_name"))).alias("hidden"),
    )


@query("fn_template", """
SELECT c_custkey, c_name || ' / ' || upper(c_name) || ' / ' || lower(c_name) || ' / ' || length(c_name) || ' ${other}' AS shown FROM customer""")
def fn_template(t):
    return t.customer.select("c_custkey", formatters.template(F.col("c_name"), "${value} / ${upper} / ${lower} / ${length} ${other}").alias("shown"))


@query("fn_epoch_auto", """
WITH e AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN (epoch_us(ts) // 1000000)::VARCHAR WHEN 1 THEN (epoch_us(ts) // 1000)::VARCHAR
  WHEN 2 THEN '12345' WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '2022-01-33' END AS raw FROM events)
SELECT event_id, CASE event_id % 5 WHEN 2 THEN '12345' WHEN 4 THEN '2022-01-33' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc,
  CASE event_id % 5 WHEN 2 THEN '12345' WHEN 4 THEN '2022-01-33' WHEN 3 THEN strftime(ts, '%d/%m %H:%M') ELSE strftime(ts + INTERVAL 8 HOUR, '%d/%m %H:%M') END AS shanghai FROM e""")
def fn_epoch_auto(t):
    e = t.events.selectExpr("event_id", """CASE event_id % 5
        WHEN 0 THEN CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', ts) AS STRING)
        WHEN 1 THEN CAST(timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', ts) AS STRING)
        WHEN 2 THEN '12345' WHEN 3 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE '2022-01-33' END AS raw""")
    return e.select(
        "event_id", temporal.epoch_format(F.col("raw")).alias("utc"),
        temporal.epoch_format(F.col("raw"), pattern="DD/MM HH:mm", zone="Asia/Shanghai").alias("shanghai"),
    )


TEXTS = """CASE event_id % 6 WHEN 0 THEN date_format(ts, 'yyyy/M/d H:m:s') WHEN 1 THEN date_format(ts, 'yyyy-MM-dd')
  WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'") WHEN 3 THEN date_format(ts, 'HH:mm:ss')
  WHEN 4 THEN 'not a date' ELSE date_format(ts, 'dd.MM.yyyy HH:mm:ss') END"""


@query("fn_temporal_normalize", """
SELECT event_id,
  CASE event_id % 6 WHEN 3 THEN strftime(ts, '%H:%M:%S') WHEN 4 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d') END AS as_date,
  CASE event_id % 6 WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN 'not a date' WHEN 2 THEN strftime(ts, '%H:%M:%S')
    || CASE WHEN strftime(ts, '%g') = '000' THEN '' ELSE '.' || strftime(ts, '%g') END ELSE strftime(ts, '%H:%M:%S') END AS as_time,
  CASE event_id % 6 WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 3 THEN strftime(ts, '%H:%M:%S') WHEN 4 THEN 'not a date'
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%g') = '000' THEN '' ELSE '.' || strftime(ts, '%g') END || '+02:00'
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS as_zoned
FROM events""")
def fn_temporal_normalize(t):
    e = t.events.selectExpr("event_id", f"{TEXTS} AS raw")
    raw = F.col("raw")
    # Casting 'dd.MM.yyyy' needs the preferred pattern; the others fall back to the known ones.
    norm = lambda kind: temporal.normalize(raw, kind, "DD.MM.YYYY HH:mm:ss")
    return e.select("event_id", norm("date").alias("as_date"), norm("time").alias("as_time"), norm("datetimetz").alias("as_zoned"))


@query("fn_temporal_format", """
WITH e AS (SELECT event_id, ts, event_id % 6 AS k, CASE event_id % 6
    WHEN 0 THEN strftime(ts, '%Y/%-m/%-d ') || extract(hour FROM ts) || ':' || extract(minute FROM ts) || ':' || extract(second FROM ts)::INT
    WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+02:00') WHEN 3 THEN strftime(ts, '%H:%M:%S')
    WHEN 4 THEN 'not a date' ELSE strftime(ts, '%d.%m.%Y %H:%M:%S') END AS raw FROM events)
SELECT event_id, CASE WHEN k IN (0, 2) THEN strftime(ts, '%d.%m.%Y at %H h %M') ELSE raw END AS shown,
  CASE WHEN k IN (0, 1, 2) THEN strftime(ts, '%Y/%m/%d') ELSE raw END AS day,
  CASE WHEN k IN (0, 2, 3) THEN strftime(ts, '%H-%M') ELSE raw END AS clock,
  CASE WHEN k = 2 THEN strftime(ts, '%H:%M +02:00 +0200') ELSE raw END AS zoned, raw AS refused FROM e""")
def fn_temporal_format(t):
    e = t.events.selectExpr("event_id", f"{TEXTS} AS raw")
    patterns = {
        "shown": "DD.MM.YYYY [at] HH [h] mm", "day": "YYYY/MM/DD", "clock": "HH-mm", "zoned": "HH:mm Z ZZ",
        "refused": "MM/DD/YYYY hh:mm A",
    }
    return e.select("event_id", *[temporal.format_text(F.col("raw"), p).alias(n) for n, p in patterns.items()])


@query("fn_fuzzy_match", """
SELECT p_partkey, lower(p_name) LIKE '%ri%' OR lower(p_name) LIKE '%r%i%' AS ri, lower(p_name) LIKE '%b%t%' AS bt, lower(p_name) LIKE '%z%' AS z FROM part""")
def fn_fuzzy_match(t):
    return t.part.select("p_partkey", *[formatters.fuzzy_match(F.col("p_name"), w).alias(w.lower()) for w in ("RI", "bt", "z")])


@query("fn_text_matches", """
WITH d AS (SELECT doc_id, string_split(lower(text), 'the') AS p FROM documents),
s AS (SELECT doc_id, len(p) - 1 AS n, list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::INT + 3 * (i - 1)::INT) AS pos FROM d)
SELECT doc_id, n::INT AS n, coalesce(pos[1], -1)::INT AS first_start, coalesce(pos[-1], -1)::INT AS last_start, coalesce(list_sum(pos), 0)::BIGINT AS total FROM s""")
def fn_text_matches(t):
    d = t.documents.select("doc_id", formatters.text_matches(F.col("text"), "THE").alias("m"))
    starts = F.col("m.start")
    return d.select(
        "doc_id", F.size("m").alias("n"), F.coalesce(F.try_element_at(starts, F.lit(1)), F.lit(-1)).alias("first_start"),
        F.coalesce(F.try_element_at(starts, F.lit(-1)), F.lit(-1)).alias("last_start"),
        F.aggregate(starts, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
    )


@query("fn_sql_literal", """
SELECT c_custkey, c_custkey::VARCHAR AS i, c_acctbal::VARCHAR AS d, '''O''''' || c_name || '''' AS s,
  CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS b, CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE '''' || c_mktsegment || '''' END AS n,
  '''["' || c_mktsegment || '"]''' AS a FROM customer""")
def fn_sql_literal(t):
    c = t.customer.selectExpr("c_custkey AS i", "c_acctbal AS d", "concat('O\\'', c_name) AS s", "c_custkey % 2 = 0 AS b",
                              "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS n", "array(c_mktsegment) AS a")
    return c.select(F.col("i").alias("c_custkey"), *[literals.literal_of(c, x).alias(x) for x in "idsbna"])


@query("fn_sql_in_list", """
WITH v AS (SELECT DISTINCT p_name FROM part), r AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS rn FROM v)
SELECT rn // 25 AS list_no, '(' || string_agg('''' || p_name || '''', ', ' ORDER BY rn) || ')' AS in_list FROM r GROUP BY 1""")
def fn_sql_in_list(t):
    return literals.in_lists(t.part, "p_name", 25)


@query("fn_geo_near", """
WITH c AS (SELECT c_custkey, (c_custkey % 360) - 180.0 AS lon, (c_custkey % 170) - 85.0 AS lat FROM customer),
d AS (SELECT c_custkey, 2 * 6378100.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 48.2) / 2), 2)
  + cos(radians(lat)) * cos(radians(48.2)) * pow(sin(radians(lon - 16.4) / 2), 2)))) AS distance FROM c)
SELECT c_custkey, round(distance / 1000, 3) AS km FROM d WHERE distance BETWEEN 500000 AND 6000000""")
def fn_geo_near(t):
    c = t.customer.selectExpr("c_custkey", "(c_custkey % 360) - 180.0D AS lon", "(c_custkey % 170) - 85.0D AS lat")
    out = formatters.geo_near(c, "lon", "lat", (16.4, 48.2), max_distance=6_000_000.0, min_distance=500_000.0)
    return out.select("c_custkey", F.round(F.col("distance") / 1000, 3).alias("km"))


@query("column_type_map", """
WITH c AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'bigint unsigned' WHEN 1 THEN 'Decimal(' || (p_size % 18 + 3) || ',2)' WHEN 2 THEN 'varchar(' || p_size || ')'
  WHEN 3 THEN 'timestamptz' WHEN 4 THEN 'longblob' WHEN 5 THEN 'bool' WHEN 6 THEN 'jsonb' ELSE 'numeric' END AS t, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DECIMAL(' || (p_size % 18 + 3) || ',2)' WHEN 2 THEN 'STRING' WHEN 3 THEN 'TIMESTAMP' WHEN 4 THEN 'BINARY'
  WHEN 5 THEN 'BOOLEAN' WHEN 6 THEN 'STRING' ELSE 'DECIMAL' END AS spark,
 CASE p_partkey % 8 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DECIMAL(' || (p_size % 18 + 3) || ',2)' WHEN 2 THEN 'VARCHAR(' || p_size || ')' WHEN 3 THEN 'TIMESTAMP' WHEN 4 THEN 'BYTEA'
  WHEN 5 THEN 'BOOLEAN' WHEN 6 THEN 'JSONB' ELSE 'NUMERIC' END AS postgres,
 CASE p_partkey % 8 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DECIMAL(' || (p_size % 18 + 3) || ',2)' WHEN 2 THEN 'VARCHAR(' || p_size || ')' WHEN 3 THEN 'DATETIME' WHEN 4 THEN 'LONGBLOB'
  WHEN 5 THEN 'TINYINT(1)' WHEN 6 THEN 'JSON' ELSE 'NUMERIC' END AS mysql,
 CASE p_partkey % 8 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DECIMAL(' || (p_size % 18 + 3) || ',2)' WHEN 2 THEN 'NVARCHAR(' || p_size || ')' WHEN 3 THEN 'DATETIME2' WHEN 4 THEN 'VARBINARY(MAX)'
  WHEN 5 THEN 'BIT' WHEN 6 THEN 'TEXT' ELSE 'NUMERIC' END AS sqlserver,
 CASE p_partkey % 8 WHEN 0 THEN 'BIGINT' WHEN 2 THEN 'VARCHAR(' || p_size || ')' WHEN 3 THEN 'DateTime64(6)' WHEN 4 THEN 'BLOB'
  WHEN 5 THEN 'BOOLEAN' WHEN 6 THEN 'TEXT' ELSE 'NUMERIC' END AS clickhouse,
 CASE p_partkey % 8 WHEN 0 THEN 'BIGINT' WHEN 2 THEN 'VARCHAR(' || p_size || ')' WHEN 3 THEN 'TIMESTAMP' WHEN 4 THEN 'BLOB'
  WHEN 5 THEN 'BOOLEAN' WHEN 6 THEN 'TEXT' ELSE 'NUMERIC' END AS other FROM c""")
def column_type_map(t):
    c = t.part.selectExpr("p_partkey", """CASE p_partkey % 8 WHEN 0 THEN 'bigint unsigned' WHEN 1 THEN concat('Decimal(', p_size % 18 + 3, ',2)')
        WHEN 2 THEN concat('varchar(', p_size, ')') WHEN 3 THEN 'timestamptz' WHEN 4 THEN 'longblob' WHEN 5 THEN 'bool'
        WHEN 6 THEN 'jsonb' ELSE 'numeric' END AS t""")
    return c.select("p_partkey", *[typemap.column_type_map(F.col("t"), x).alias(x) for x in typemap.TARGETS])


@query("flatten_fields", """
SELECT * FROM (VALUES ('props', 'object'), ('props.k', 'scalar'), ('type', 'scalar'), ('tags', 'array'), ('tags.n', 'scalar'), ('id', 'scalar')) v(path, kind),
(SELECT count(*) AS documents FROM events)""")
def flatten_fields(t):
    from tablewright.operators.fields import flatten_fields as flat
    docs = t.events.select(F.concat(
        F.lit('{"id": '), "event_id", F.lit(', "type": "'), "event_type", F.lit('", "props": '), "props",
        F.lit(', "tags": [{"n": 1}, {"n": '), "user_id", F.lit("}]}"),
    ).alias("doc"))
    return flat(docs, "doc").select("path", "kind", "documents")

