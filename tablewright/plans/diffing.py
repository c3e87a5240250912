"""Diff, sync and changeset queries over orders and a perturbed copy of it."""

from pyspark.sql import functions as F

from tablewright.operators import changeset, checksums, diff, sync
from tablewright.plans.registry import query

KEY = ["o_orderkey"]

# The second side: some rows dropped, some copied under new keys, some changed.
TARGET_SQL = """
tgt AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 101 = 0
),
joined AS (
  SELECT CASE WHEN t.o_orderkey IS NULL THEN 'added' WHEN s.o_orderkey IS NULL THEN 'removed'
              WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus
                OR s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'modified'
              ELSE 'same' END AS status,
         coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
         s.o_custkey AS s_cust, s.o_orderstatus AS s_status, t.o_orderstatus AS t_status,
         s.o_totalprice AS s_price, t.o_totalprice AS t_price,
         s.o_orderdate AS s_date, s.o_orderpriority AS s_prio
  FROM orders s FULL JOIN tgt t ON s.o_orderkey IS NOT DISTINCT FROM t.o_orderkey
),
changed AS (
  SELECT *, s_status IS DISTINCT FROM t_status AS c_status, s_price IS DISTINCT FROM t_price AS c_price
  FROM joined WHERE status <> 'same'
)"""


def perturbed(orders):
    key = F.col("o_orderkey")
    kept = orders.where(key % 97 != 0).withColumns({
        "o_orderstatus": F.when(key % 17 != 0, F.col("o_orderstatus")),
        "o_totalprice": F.when(key % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    })
    copies = orders.where(key % 101 == 0).withColumn("o_orderkey", key + 10_000_000)
    return kept.unionByName(copies)


DIFF_SQL = f"""WITH {TARGET_SQL}
SELECT status, o_orderkey,
       CASE WHEN status = 'modified' THEN c_status::INT + c_price::INT ELSE 0 END AS n_changes,
       CASE WHEN status = 'modified' THEN concat_ws(',', CASE WHEN c_status THEN 'o_orderstatus' END,
            CASE WHEN c_price THEN 'o_totalprice' END) ELSE '' END AS changed_columns
FROM changed"""


@query("diff_rows", DIFF_SQL)
def diff_rows(t):
    rows = diff.diff_rows(t.orders, perturbed(t.orders), KEY)
    return rows.select("status", "o_orderkey", "n_changes", "changed_columns")


@query("diff_rows_checksum", DIFF_SQL)
def diff_rows_checksum(t):
    rows = checksums.diff_rows(t.orders, perturbed(t.orders), KEY, range_rows=500)
    return rows.select("status", "o_orderkey", "n_changes", "changed_columns")


@query("diff_rows_checksum_recent", """
WITH tgt AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 AND o_orderkey > (SELECT max(o_orderkey) FROM orders) - 200 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders)
SELECT 'modified' AS status, o_orderkey, s.o_totalprice AS was, t.o_totalprice AS now FROM tgt s JOIN orders t USING (o_orderkey) WHERE s.o_totalprice <> t.o_totalprice""")
def diff_rows_checksum_recent(t):
    """Changes that lie together: all but a few key ranges stay out of the join."""
    newest = t.orders.agg(F.max("o_orderkey")).first()[0] or 0
    late = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") > newest - 200)
    changed = t.orders.withColumn("o_totalprice", F.when(late, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    rows = checksums.diff_rows(changed, t.orders, KEY, range_rows=500)
    return rows.select("status", "o_orderkey", F.col("s_o_totalprice").alias("was"), F.col("t_o_totalprice").alias("now"))


@query("table_equal_checksum", """
SELECT 'orders' AS name, 'same' AS result UNION ALL SELECT 'changed', 'different' UNION ALL SELECT 'lineitem', 'same'""")
def table_equal_checksum(t):
    dealt = {name: df.hint("rebalance") for name, df in (("orders", t.orders), ("lineitem", t.lineitem))}  # tasks of a bounded size
    parts = {"orders": (t.orders, dealt["orders"]), "changed": (t.orders, perturbed(t.orders)), "lineitem": (t.lineitem, dealt["lineitem"])}
    out = [checksums.table_equal(*pair).select(F.lit(name).alias("name"), "result") for name, pair in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("diff_rows_whole", f"""WITH {TARGET_SQL}
SELECT c.status, c.o_orderkey, CASE WHEN c.status = 'modified' THEN c_status::INT + c_price::INT ELSE 0 END AS n_changes,
  s.o_custkey AS s_o_custkey, s.o_orderstatus AS s_o_orderstatus, s.o_totalprice AS s_o_totalprice, s.o_orderdate::VARCHAR AS s_o_orderdate, s.o_orderpriority AS s_o_orderpriority,
  t.o_custkey AS t_o_custkey, t.o_orderstatus AS t_o_orderstatus, t.o_totalprice AS t_o_totalprice, t.o_orderdate::VARCHAR AS t_o_orderdate, t.o_orderpriority AS t_o_orderpriority,
  CASE WHEN c.status = 'modified' THEN concat_ws(',', CASE WHEN c_status THEN 'o_orderstatus' END, CASE WHEN c_price THEN 'o_totalprice' END) ELSE '' END AS changed
FROM changed c LEFT JOIN orders s ON s.o_orderkey = c.o_orderkey LEFT JOIN tgt t ON t.o_orderkey = c.o_orderkey""")
def diff_rows_whole(t):
    """Both sides' values and the changes, as the published measurement returns them."""
    rows = diff.diff_rows(t.orders, perturbed(t.orders), KEY).drop("changed_columns")
    return rows.withColumns({
        "s_o_orderdate": F.col("s_o_orderdate").cast("string"), "t_o_orderdate": F.col("t_o_orderdate").cast("string"),
        "changes": F.array_join(F.col("changes.column"), ","),
    }).withColumnRenamed("changes", "changed")


@query("diff_join", f"""WITH {TARGET_SQL}
SELECT status, o_orderkey, s_price, t_price, s_status, t_status FROM joined""")
def diff_join(t):
    rows = diff.diff_join(t.orders, perturbed(t.orders), KEY)
    return rows.select(
        "status", "o_orderkey", F.col("s_o_totalprice").alias("s_price"),
        F.col("t_o_totalprice").alias("t_price"), F.col("s_o_orderstatus").alias("s_status"),
        F.col("t_o_orderstatus").alias("t_status"),
    )


@query("diff_cells", f"""WITH {TARGET_SQL}
SELECT o_orderkey, 'o_orderstatus' AS "column", s_status AS source, t_status AS target
FROM changed WHERE status = 'modified' AND c_status
UNION ALL
SELECT o_orderkey, 'o_totalprice', s_price::VARCHAR, t_price::VARCHAR
FROM changed WHERE status = 'modified' AND c_price""")
def diff_cells(t):
    return diff.diff_cells(t.orders, perturbed(t.orders), KEY)


@query("diff_duplicate_keys", """
SELECT 'source' AS side, l_orderkey, l_linenumber, count(*) AS copies
FROM lineitem GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'target', l_orderkey, l_linenumber, count(*)
FROM lineitem WHERE l_quantity < 25 GROUP BY ALL HAVING count(*) > 1""")
def diff_duplicate_keys(t):
    return diff.diff_duplicate_keys(
        t.lineitem, t.lineitem.where("l_quantity < 25"), ["l_orderkey", "l_linenumber"]
    )


@query("diff_counts", f"""WITH {TARGET_SQL}
SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM tgt) AS target_rows""")
def diff_counts(t):
    return diff.diff_counts(t.orders, perturbed(t.orders))


@query("diff_summary", f"""WITH {TARGET_SQL}
SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
       count(*) FILTER (status = 'modified') AS modified, 'different' AS result FROM changed""")
def diff_summary(t):
    return diff.diff_summary(t.orders, perturbed(t.orders), KEY)


@query("diff_all_tables", f"""WITH {TARGET_SQL}
SELECT 'orders' AS table_name, count(*) FILTER (status = 'added') AS added,
       count(*) FILTER (status = 'removed') AS removed,
       count(*) FILTER (status = 'modified') AS modified, 'different' AS result, NULL AS reason FROM changed
UNION ALL SELECT 'customer', 0, 0, count(*) FILTER (c_acctbal < 0),
  CASE WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'different' ELSE 'same' END, NULL FROM customer
UNION ALL SELECT 'part', 0, 0, 0, 'same', NULL
UNION ALL SELECT 'lineitem', 0, 0, 0, 'error', 'Duplicate source key'
UNION ALL SELECT 'supplier', 0, 0, 0, 'missing target', NULL
UNION ALL SELECT 'nation', 0, 0, 0, 'error', '[CAST_INVALID_INPUT]'""")
def diff_all_tables(t):
    source = {n: getattr(t, n) for n in ("orders", "customer", "part", "lineitem", "supplier", "nation")}
    floored = t.customer.withColumn("c_acctbal", F.greatest(F.col("c_acctbal"), F.lit(0.0)))
    target = {
        "orders": perturbed(t.orders), "customer": floored, "part": t.part, "lineitem": t.lineitem,
        # Numbers against text that is none: the cast fails in the job.
        "nation": t.nation.withColumn("n_regionkey", F.col("n_name")),
    }
    keys = {
        "nation": ["n_nationkey"],
        "orders": KEY, "customer": ["c_custkey"], "part": ["p_partkey"],
        "lineitem": ["l_orderkey", "l_linenumber"],
    }
    return diff.diff_all_tables(source, target, keys).withColumn("reason", F.substring("reason", 1, 20))


@query("diff_missing_target", """
SELECT 'added' AS status, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def diff_missing_target(t):
    return diff.diff_missing_target(t.customer, ["c_custkey"])


@query("join_anti_added", f"""WITH {TARGET_SQL}
SELECT s.* FROM orders s WHERE NOT EXISTS (FROM tgt t WHERE t.o_orderkey = s.o_orderkey)""")
def join_anti_added(t):
    return diff.only_in(t.orders, perturbed(t.orders), KEY)


@query("join_anti_removed", f"""WITH {TARGET_SQL}
SELECT t.* FROM tgt t WHERE NOT EXISTS (FROM orders s WHERE t.o_orderkey = s.o_orderkey)""")
def join_anti_removed(t):
    return diff.only_in(perturbed(t.orders), t.orders, KEY)


@query("table_equal", """
WITH off AS (SELECT * FROM lineitem EXCEPT ALL
             SELECT * FROM lineitem WHERE l_quantity <> 50)
SELECT CASE WHEN (SELECT count(*) FROM off) > 0 THEN 'different' ELSE 'same' END AS result""")
def table_equal(t):
    return diff.table_equal(t.lineitem, t.lineitem.where("l_quantity <> 50"))


@query("sync_plan", f"""WITH {TARGET_SQL},
n AS (SELECT count(*) FILTER (status = 'added') AS inserts,
             count(*) FILTER (status = 'modified' AND c_price) AS updates,
             count(*) FILTER (status = 'removed') AS deletes FROM changed)
SELECT *, (ceil(inserts / 500) + ceil(updates / 200) + ceil(deletes / 200))::BIGINT AS statements FROM n""")
def sync_plan(t):
    return sync.sync_plan(t.orders, perturbed(t.orders), KEY, generated=["o_orderstatus"])


@query("sync_statements", f"""WITH {TARGET_SQL}
SELECT CASE status WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END AS step, o_orderkey,
  CASE status
  WHEN 'added' THEN 'INSERT INTO "orders" ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority") VALUES ('
    || o_orderkey || ', ' || s_cust || ', ''' || s_status || ''', ' || s_price || ', '''
    || strftime(s_date, '%Y-%m-%d %H:%M:%S') || ''', ''' || s_prio || ''');'
  WHEN 'modified' THEN 'UPDATE "orders" SET ' || concat_ws(', ',
    CASE WHEN c_status THEN '"o_orderstatus" = ''' || s_status || '''' END,
    CASE WHEN c_price THEN '"o_totalprice" = ' || s_price END) || ' WHERE "o_orderkey" = ' || o_orderkey || ';'
  ELSE 'DELETE FROM "orders" WHERE "o_orderkey" = ' || o_orderkey || ';' END AS statement
FROM changed""")
def sync_statements(t):
    return sync.sync_statements(t.orders, perturbed(t.orders), KEY, "orders")


@query("sync_statement_batches", f"""WITH {TARGET_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY o_orderkey) - 1 AS rn FROM changed)
SELECT 'insert' AS kind, rn // 500 AS batch_no,
  'INSERT INTO "orders" ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority") VALUES '
  || string_agg('(' || o_orderkey || ', ' || s_cust || ', ''' || s_status || ''', ' || s_price || ', '''
    || strftime(s_date, '%Y-%m-%d %H:%M:%S') || ''', ''' || s_prio || ''')', ', ' ORDER BY o_orderkey) || ';' AS statement
FROM n WHERE status = 'added' GROUP BY rn // 500
UNION ALL
SELECT 'update', rn // 200, 'UPDATE "orders" SET '
  || concat_ws(', ',
    CASE WHEN bool_or(c_status) THEN '"o_orderstatus" = CASE ' || string_agg('WHEN "o_orderkey" = ' || o_orderkey
      || ' THEN ''' || s_status || '''', ' ' ORDER BY o_orderkey) FILTER (c_status) || ' ELSE "o_orderstatus" END' END,
    CASE WHEN bool_or(c_price) THEN '"o_totalprice" = CASE ' || string_agg('WHEN "o_orderkey" = ' || o_orderkey
      || ' THEN ' || s_price, ' ' ORDER BY o_orderkey) FILTER (c_price) || ' ELSE "o_totalprice" END' END)
  || ' WHERE ' || string_agg('("o_orderkey" = ' || o_orderkey || ')', ' OR ' ORDER BY o_orderkey) || ';'
FROM n WHERE status = 'modified' GROUP BY rn // 200
UNION ALL
SELECT 'delete', rn // 200, 'DELETE FROM "orders" WHERE '
  || string_agg('("o_orderkey" = ' || o_orderkey || ')', ' OR ' ORDER BY o_orderkey) || ';'
FROM n WHERE status = 'removed' GROUP BY rn // 200""")
def sync_statement_batches(t):
    source, target = t.orders, perturbed(t.orders)
    added, removed = diff.only_in(source, target, KEY), diff.only_in(target, source, KEY)
    parts = {
        "insert": sync.sync_insert_batches(added, KEY, "orders"),
        "update": sync.sync_update_batches(source, target, KEY, "orders"),
        "delete": sync.sync_delete_batches(removed, KEY, "orders"),
    }
    named = [p.select(F.lit(k).alias("kind"), "batch_no", "statement") for k, p in parts.items()]
    return named[0].unionAll(named[1]).unionAll(named[2])


@query("sync_apply", "SELECT * FROM orders")
def sync_apply(t):
    return sync.sync_apply(t.orders, perturbed(t.orders), KEY)


def edits(t):
    """Edits derived from the customer table: negative balances are set to 0
    and moved to a segment, the BUILDING rows of nation 0 are deleted, and
    one new row per supplier is inserted."""
    poor = t.customer.where("c_acctbal < 0").selectExpr(
        "'update' AS op", "c_custkey",
        "inline(array(struct('c_acctbal' AS column, '0.0' AS value, 1 AS seq),"
        " struct('c_mktsegment' AS column, 'REVIEW' AS value, 2 AS seq)))",
    )
    gone = t.customer.where("c_nationkey = 0 AND c_acctbal >= 0").selectExpr(
        "'delete' AS op", "c_custkey", "CAST(NULL AS STRING) AS column",
        "CAST(NULL AS STRING) AS value", "1 AS seq",
    )
    new = t.supplier.selectExpr(
        "'insert' AS op", "s_suppkey + 50000000 AS c_custkey",
        "inline(array(struct('c_name' AS column, s_name AS value, 1 AS seq),"
        " struct('c_nationkey' AS column, CAST(s_nationkey AS STRING) AS value, 2 AS seq)))",
    )
    return poor.unionAll(gone).unionAll(new)


@query("changeset_apply", """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE NOT (c_nationkey = 0 AND c_acctbal >= 0)
UNION ALL SELECT s_suppkey + 50000000, s_name, s_nationkey, NULL, 'NEW' FROM supplier""")
def changeset_apply(t):
    return changeset.changeset_apply(
        t.customer, edits(t), ["c_custkey"], defaults={"c_mktsegment": "NEW"}
    )


@query("changeset_rollback", """
SELECT 'update' AS op, c_custkey, 'c_acctbal' AS "column", c_acctbal::VARCHAR AS value FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'update', c_custkey, 'c_mktsegment', c_mktsegment FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'delete', s_suppkey + 50000000, NULL, NULL FROM supplier
UNION ALL SELECT 'insert', c_custkey, 'c_name', c_name FROM customer WHERE c_nationkey = 0 AND c_acctbal >= 0
UNION ALL SELECT 'insert', c_custkey, 'c_nationkey', c_nationkey::VARCHAR FROM customer WHERE c_nationkey = 0 AND c_acctbal >= 0
UNION ALL SELECT 'insert', c_custkey, 'c_acctbal', c_acctbal::VARCHAR FROM customer WHERE c_nationkey = 0 AND c_acctbal >= 0
UNION ALL SELECT 'insert', c_custkey, 'c_mktsegment', c_mktsegment FROM customer WHERE c_nationkey = 0 AND c_acctbal >= 0""")
def changeset_rollback(t):
    return changeset.changeset_rollback(t.customer, edits(t), ["c_custkey"])
