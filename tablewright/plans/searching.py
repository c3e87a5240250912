"""Search, metadata, lineage and log queries."""

from pyspark.sql import functions as F

from tablewright.operators import logs, metadata, search
from tablewright.plans.registry import query


# Every table with its key; columns are text (t), numbers (n) or not searched (-).
SEARCHED = {
    "region": ("r_regionkey", "r_regionkey n r_name t"),
    "nation": ("n_nationkey", "n_nationkey n n_name t n_regionkey n"),
    "customer": ("c_custkey", "c_custkey n c_name t c_nationkey n c_acctbal n c_mktsegment t"),
    "supplier": ("s_suppkey", "s_suppkey n s_name t s_nationkey n s_acctbal n"),
    "part": ("p_partkey", "p_partkey n p_name t p_brand t p_type t p_size n p_retailprice n"),
    "orders": ("o_orderkey", "o_orderkey n o_custkey n o_orderstatus t o_totalprice n o_orderdate - o_orderpriority t"),
    "lineitem": (
        "l_orderkey l_linenumber",
        "l_orderkey n l_partkey n l_suppkey n l_linenumber n l_quantity n l_extendedprice n l_discount n l_tax n "
        "l_returnflag t l_linestatus t l_shipdate -",
    ),
    "events": ("event_id", "event_id n ts - user_id n event_type t value n props t"),
    "documents": ("doc_id", "doc_id n text t lang t source t n_chars n"),
    "embeddings": ("vec_id", "vec_id n embedding - label n"),
    "pages": ("page_id", "page_id n url t html t"),
    "benchmark": ("item_id", "item_id n text t"),
    "labels": ("doc_id", "doc_id n quality n toxic n"),
    "conversations": ("conv_id turn", "conv_id n turn n role t text t"),
}


def search_sql(term: str) -> str:
    parts = []
    for table, (keys, columns) in SEARCHED.items():
        names = columns.split()
        tests = {
            c: f"lower({c}) LIKE '%{term}%'" if kind == "t" else f"{c} = {term}"
            for c, kind in zip(names[::2], names[1::2]) if kind != "-"
        }
        listed = keys.split()
        key = f"{keys}::VARCHAR" if len(listed) == 1 else "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {k}" for k in listed) + " || '}'"
        found = ", ".join(f"CASE WHEN {test} THEN '{c}' END" for c, test in tests.items())
        parts.append(
            f"SELECT '{table}' AS table_name, {key} AS key, concat_ws(',', {found}) AS matched_columns FROM {table} WHERE {' OR '.join(tests.values())}"
        )
    return " UNION ALL ".join(parts)


@query("search_database", search_sql("21"))
def search_database(t):
    tables = {name: (getattr(t, name), keys.split()) for name, (keys, _) in SEARCHED.items()}
    return search.search_database(tables, " 21 ").select("table_name", "key", "matched_columns")


@query("search_escaped", r"""
SELECT page_id::VARCHAR AS key, concat_ws(',', CASE WHEN lower(url) LIKE '%~%%' ESCAPE '~' THEN 'url' END, CASE WHEN lower(html) LIKE '%~%%' ESCAPE '~' THEN 'html' END) AS matched_columns
FROM pages WHERE lower(url) LIKE '%~%%' ESCAPE '~' OR lower(html) LIKE '%~%%' ESCAPE '~'""")
def search_escaped(t):
    return search.search_table(t.pages, "pages", ["page_id"], "%").select("key", "matched_columns")


@query("search_hit_locator", """
SELECT c_custkey, '"c_custkey" = ' || c_custkey AS by_key, concat_ws(' AND ', CASE WHEN c_custkey = 7 THEN '"c_custkey" = 7' END,
  CASE WHEN lower(c_name) LIKE '%7%' THEN '"c_name" = ''' || c_name || '''' END, CASE WHEN c_nationkey = 7 THEN '"c_nationkey" = 7' END) AS by_columns
FROM customer WHERE c_custkey = 7 OR c_name LIKE '%7%' OR c_nationkey = 7 OR c_acctbal = 7""")
def search_hit_locator(t):
    a = search.search_hit_locator(t.customer, ["c_custkey"], "7").select("c_custkey", F.col("locator").alias("by_key"))
    b = search.search_hit_locator(t.customer, [], "7").select("c_custkey", F.col("locator").alias("by_columns"))
    return a.join(b, "c_custkey")


@query("search_cells", """
SELECT c_custkey, 'c_custkey' AS "column", 0 AS column_index, c_custkey::VARCHAR AS value FROM customer WHERE c_custkey::VARCHAR LIKE '%11%'
UNION ALL SELECT c_custkey, 'c_name', 1, c_name FROM customer WHERE c_name LIKE '%11%'
UNION ALL SELECT c_custkey, 'c_nationkey', 2, c_nationkey::VARCHAR FROM customer WHERE c_nationkey::VARCHAR LIKE '%11%'
UNION ALL SELECT c_custkey, 'c_acctbal', 3, c_acctbal::VARCHAR FROM customer WHERE c_acctbal::VARCHAR LIKE '%11%'
UNION ALL SELECT c_custkey, 'c_mktsegment', 4, c_mktsegment FROM customer WHERE c_mktsegment LIKE '%11%'""")
def search_cells(t):
    return search.search_cells(t.customer, ["c_custkey"], "11")


@query("search_match_join", """
SELECT p_partkey, concat_ws(',', CASE WHEN p_name LIKE '%red%' THEN 'p_name' END, CASE WHEN p_type = 'ECONOMY' THEN 'p_type' END, CASE WHEN p_size > 45 THEN 'p_size' END) AS matched
FROM part WHERE p_name LIKE '%red%' OR p_type = 'ECONOMY' OR p_size > 45""")
def search_match_join(t):
    tests = {"p_name": F.col("p_name").contains("red"), "p_type": F.col("p_type") == "ECONOMY", "p_size": F.col("p_size") > 45}
    return search.search_match_join(t.part, tests).select("p_partkey", F.array_join("matched", ",").alias("matched"))


@query("search_kv", """
WITH kv AS (SELECT event_type || ':' || user_id || ':' || event_id AS key, CASE event_id % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'list' ELSE 'hash' END AS type,
  CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN event_type || ' ' || value ELSE 'score ' || value || ' user ' || user_id END AS txt FROM events)
SELECT key, type, key LIKE '%7:4%' AS key_match, lower(txt) LIKE '%7:4%' OR lower(txt) LIKE '%user 7%' AND false AS value_match FROM kv WHERE key LIKE 'click:%' AND (key LIKE '%7:4%' OR txt LIKE '%7:4%')
UNION ALL SELECT key, type, false, true FROM kv WHERE txt LIKE '%user 77%'""")
def search_kv(t):
    kv = t.events.selectExpr(
        "concat_ws(':', event_type, user_id, event_id) AS key",
        "CASE event_id % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'list' ELSE 'hash' END AS type",
        "CASE WHEN event_id % 3 = 0 THEN props END AS text",
        "CASE WHEN event_id % 3 = 1 THEN array(event_type, CAST(value AS STRING)) END AS items",
        "CASE WHEN event_id % 3 = 2 THEN map('score', CAST(value AS STRING), 'user', CAST(user_id AS STRING)) END AS fields",
    )
    return search.search_kv(kv, "7:4", "Click:*").unionAll(search.search_kv(kv, "USER 77"))


# --- metadata: a catalog derived from the part table ---------------------------------

COLS_SQL = """s AS (SELECT p_brand AS table_name, 'c' || p_partkey AS name, p_type AS data_type, p_size % 2 = 0 AS is_nullable,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::VARCHAR END AS "default", p_name AS comment, p_size AS position, CASE WHEN p_brand LIKE '%7' THEN 'view' ELSE 'table' END AS kind FROM part WHERE p_brand <> 'Brand#3'),
g AS (SELECT p_brand AS table_name, 'c' || p_partkey AS name, CASE WHEN p_partkey % 23 = 0 THEN 'OTHER' ELSE lower(p_type) END AS data_type, p_size % 2 = 0 AS is_nullable,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::VARCHAR END AS "default", CASE WHEN p_partkey % 29 = 0 THEN 'new' ELSE p_name END AS comment, p_size AS position,
  CASE WHEN p_brand LIKE '%7' THEN 'view' ELSE 'table' END AS kind FROM part WHERE p_brand <> 'Brand#4' AND p_partkey % 31 <> 0)"""


def catalogs(t):
    base = t.part.selectExpr(
        "p_partkey AS k", "p_brand AS table_name", "concat('c', p_partkey) AS name", "p_type AS data_type", "p_size % 2 = 0 AS is_nullable",
        "CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS STRING) END AS default", "p_name AS comment", "p_size AS position",
        "CASE WHEN p_brand LIKE '%7' THEN 'view' ELSE 'table' END AS kind",
    )
    source = base.where("table_name <> 'Brand#3'").drop("k")
    target = base.where("table_name <> 'Brand#4' AND k % 31 <> 0").withColumns({
        "data_type": F.when(F.col("k") % 23 == 0, "OTHER").otherwise(F.lower("data_type")),
        "comment": F.when(F.col("k") % 29 == 0, "new").otherwise(F.col("comment")),
    }).drop("k")
    return source, target


@query("schema_diff_columns", f"""WITH {COLS_SQL},
j AS (SELECT coalesce(s.table_name, g.table_name) AS table_name, coalesce(s.name, g.name) AS name, s.name AS sn, g.name AS gn,
  lower(s.data_type) IS DISTINCT FROM lower(g.data_type) AS dt, s.comment IS DISTINCT FROM g.comment AS dc FROM s FULL JOIN g ON s.table_name = g.table_name AND s.name = g.name)
SELECT CASE WHEN gn IS NULL THEN 'added' WHEN sn IS NULL THEN 'removed' ELSE 'modified' END AS status, table_name, name,
  CASE WHEN gn IS NOT NULL AND sn IS NOT NULL THEN concat_ws(',', CASE WHEN dt THEN 'data_type' END, CASE WHEN dc THEN 'comment' END) ELSE '' END AS changed_columns
FROM j WHERE dt OR dc""")
def schema_diff_columns(t):
    return metadata.schema_diff_columns(*catalogs(t)).select("status", "table_name", "name", "changed_columns")


@query("schema_diff_tables", f"""WITH {COLS_SQL},
st AS (SELECT DISTINCT kind, table_name FROM s), gt AS (SELECT DISTINCT kind, table_name FROM g),
ch AS (SELECT DISTINCT coalesce(s.table_name, g.table_name) AS table_name FROM s FULL JOIN g ON s.table_name = g.table_name AND s.name = g.name
       WHERE lower(s.data_type) IS DISTINCT FROM lower(g.data_type) OR s.comment IS DISTINCT FROM g.comment)
SELECT kind, table_name, 'added' AS status FROM st WHERE table_name NOT IN (SELECT table_name FROM gt)
UNION ALL SELECT kind, table_name, 'removed' FROM gt WHERE table_name NOT IN (SELECT table_name FROM st)
UNION ALL SELECT st.kind, table_name, 'modified' FROM st JOIN gt USING (table_name) JOIN ch USING (table_name) WHERE st.kind = 'table'""")
def schema_diff_tables(t):
    return metadata.schema_diff_tables(*catalogs(t))


@query("schema_diff_keys", """
WITH i AS (SELECT p_brand AS table_name, 'idx_' || p_partkey AS name, p_type AS columns, p_size % 2 = 0 AS is_unique, p_partkey FROM part)
SELECT 'modified' AS status, table_name, name, 1 AS n_changes, 'is_unique' AS changed_columns FROM i WHERE p_partkey % 37 = 0 AND p_partkey % 41 <> 0
UNION ALL SELECT 'added', table_name, name, 0, '' FROM i WHERE p_partkey % 41 = 0""")
def schema_diff_keys(t):
    i = t.part.selectExpr("p_brand AS table_name", "concat('idx_', p_partkey) AS name", "p_type AS columns", "p_size % 2 = 0 AS is_unique", "p_partkey AS k")
    g = i.where("k % 41 <> 0").withColumn("is_unique", F.expr("CASE WHEN k % 37 = 0 THEN NOT is_unique ELSE is_unique END"))
    return metadata.schema_diff_keys(i.drop("k"), g.drop("k"))


META_SQL = """cols AS (SELECT 'public' AS schema_name, 'T_' || p_brand AS table_name, split_part(p_name, ' ', 2) AS name, p_partkey FROM part),
fks AS (SELECT 'public' AS schema_name, 'T_' || p_brand AS table_name, 'fk_' || p_partkey AS name, split_part(p_name, ' ', 2) AS column_name,
  'T_Brand#' || (p_size % 10) AS ref_table, split_part(p_name, ' ', 1) AS ref_column FROM part)"""


def meta(t):
    cols = t.part.selectExpr("'public' AS schema_name", "concat('T_', p_brand) AS table_name", "split_part(p_name, ' ', 2) AS name")
    fks = t.part.selectExpr("'public' AS schema_name", "concat('T_', p_brand) AS table_name", "concat('fk_', p_partkey) AS name",
                            "split_part(p_name, ' ', 2) AS column_name", "concat('T_Brand#', p_size % 10) AS ref_table", "split_part(p_name, ' ', 1) AS ref_column")
    views = t.documents.selectExpr("'public' AS schema_name", "concat('v', doc_id) AS name", "text AS ddl")
    history = t.conversations.selectExpr("concat(conv_id, '-', turn) AS id", "text AS sql_text", "turn AS executed_at")
    return cols, fks, views, history


@query("lineage_column", f"""WITH {META_SQL}
SELECT 'foreignKey' AS kind, 'certain' AS confidence, 'outgoing' AS direction, ref_table AS table_name, ref_column AS column_name, name AS ref FROM fks
  WHERE lower(table_name) = 't_brand#5' AND lower(column_name) = 'the'
UNION ALL SELECT 'foreignKey', 'certain', 'incoming', table_name, column_name, name FROM fks WHERE lower(ref_table) = 't_brand#5' AND lower(ref_column) = 'the'
UNION ALL SELECT 'viewReference', CASE WHEN regexp_matches(text, '(?i)(^|[^\\w$])T_Brand#5($|[^\\w$])') THEN 'likely' ELSE 'possible' END, 'reference', 'v' || doc_id, NULL, 'v' || doc_id
  FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\w$])the($|[^\\w$])')
UNION ALL SELECT 'historyReference', 'possible', 'reference', NULL, NULL, conv_id || '-' || turn FROM conversations WHERE regexp_matches(text, '(?i)(^|[^\\w$])the($|[^\\w$])')
UNION ALL SELECT 'sameName', 'possible', 'reference', table_name, name, NULL FROM cols WHERE lower(name) = 'the' AND lower(table_name) <> 't_brand#5'""")
def lineage_column(t):
    cols, fks, views, history = meta(t)
    out = metadata.lineage_column("t_brand#5", "THE", "public", cols, fks, views, history)
    return out.drop("schema_name")


@query("lineage_keys", f"""WITH {META_SQL}
SELECT 'foreignKey' AS kind, 'outgoing' AS direction, ref_table AS table_name, ref_column AS column_name, name AS ref FROM fks
  WHERE lower(table_name) = 't_brand#5' AND lower(column_name) = 'ring'
UNION ALL SELECT 'foreignKey', 'incoming', table_name, column_name, name FROM fks WHERE lower(ref_table) = 't_brand#5' AND lower(ref_column) = 'ring'
UNION ALL SELECT 'sameName', 'reference', table_name, name, NULL FROM cols WHERE lower(name) = 'ring' AND lower(table_name) <> 't_brand#5'""")
def lineage_keys(t):
    cols, fks, _, _ = meta(t)
    return metadata.lineage_column("T_Brand#5", "ring", "public", cols, fks).drop("schema_name", "confidence")


@query("lineage_join", f"""WITH {META_SQL},
g AS (SELECT DISTINCT lower(table_name) AS tt, lower(name) AS tc FROM cols)
SELECT tt, tc, 'outgoing' AS direction, lower(ref_table) AS table_name, lower(ref_column) AS name FROM g JOIN fks ON tt = lower(table_name) AND tc = lower(column_name)
UNION ALL SELECT tt, tc, 'incoming', lower(table_name), lower(column_name) FROM g JOIN fks ON tt = lower(ref_table) AND tc = lower(ref_column)
UNION ALL SELECT g.tt, g.tc, 'same name', o.tt, o.tc FROM g JOIN g o ON g.tc = o.tc AND g.tt <> o.tt""")
def lineage_join(t):
    cols, fks, _, _ = meta(t)
    return metadata.lineage_join(cols.select("table_name", "name").distinct(), cols, fks)


@query("lineage_references", f"""WITH
g AS (SELECT DISTINCT lower(regexp_extract(text, '[\\w$]+', 0)) AS tt, lower(regexp_extract(text, '([\\w$]+)[^\\w$]+([\\w$]+)', 2)) AS tc FROM documents WHERE regexp_matches(text, '[\\w$]+[^\\w$]+[\\w$]+')),
st AS (SELECT 'viewReference' AS kind, 'public' AS schema_name, 'v' || doc_id AS ref, text FROM documents
       UNION ALL SELECT 'historyReference', NULL, conv_id || '-' || turn, text FROM conversations),
w AS (SELECT DISTINCT kind, schema_name, ref, lower(unnest(regexp_extract_all(text, '[\\w$]+'))) AS word FROM st)
SELECT tt, tc, c.kind, CASE WHEN t.word IS NULL THEN 'possible' ELSE 'likely' END AS confidence, c.schema_name, c.ref
FROM g JOIN w c ON c.word = tc LEFT JOIN w t ON t.word = tt AND t.kind = c.kind AND t.ref = c.ref""")
def lineage_references(t):
    """Every document's first two words as a table and its column, looked up in all texts."""
    _, _, views, history = meta(t)
    word = r"([\w$]+)[^\w$]+([\w$]+)"
    names = [F.regexp_extract("text", word, i) for i in (1, 2)]
    targets = t.documents.select(names[0].alias("table_name"), names[1].alias("name")).where("name <> ''")
    return metadata.lineage_references(targets, views, history)


# --- logs: a query log derived from the events ------------------------------------------

SQL_TEXT = """CASE event_id % 6 WHEN 0 THEN 'SELECT * FROM t' || event_id WHEN 1 THEN '-- note' || chr(10) || 'insert into t values (' || event_id || ')'
  WHEN 2 THEN 'select 1; DROP TABLE t' || event_id WHEN 3 THEN '/* create */ update t set a = ' || event_id
  WHEN 4 THEN 'explain select 50%_' || event_id ELSE 'created = 1' END"""
LOG_SQL = f"""log AS (SELECT event_id AS id, 'c' || (user_id % 4) AS connection_id, 'Conn ' || (user_id % 4) AS connection_name, 'db' || (user_id % 3) AS database,
  {SQL_TEXT} AS sql_text, date_trunc('hour', ts) AS executed_at, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN 'Failure ' || event_id END AS error,
  CASE event_id % 6 WHEN 1 THEN 'data_change' WHEN 2 THEN 'schema_change' WHEN 3 THEN 'data_change' ELSE 'query' END AS activity_kind FROM events)"""


def log(t):
    df = t.events.selectExpr(
        "event_id AS id", "concat('c', user_id % 4) AS connection_id", "concat('Conn ', user_id % 4) AS connection_name", "concat('db', user_id % 3) AS database",
        f"{SQL_TEXT} AS sql_text", "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS executed_at", "event_type <> 'error' AS success",
        "CASE WHEN event_type = 'error' THEN concat('Failure ', event_id) END AS error",
    )
    return df.withColumn("activity_kind", logs.activity_classify(F.col("sql_text")))


@query("activity_classify", f"WITH {LOG_SQL} SELECT id, activity_kind FROM log")
def activity_classify(t):
    return log(t).select("id", "activity_kind")


@query("log_filter", f"""WITH {LOG_SQL} SELECT id FROM log WHERE (connection_id = 'c1' OR (connection_id = 'c2' AND database = 'db0'))
AND activity_kind IN ('query', 'data_change') AND executed_at BETWEEN '2024-01-03' AND '2024-01-20'
AND (lower(sql_text) LIKE '%~%~_%' ESCAPE '~' OR lower(error) LIKE '%~%~_%' ESCAPE '~')
UNION ALL SELECT -id - 1 FROM log WHERE NOT success AND lower(error) LIKE '%failure 9%'""")
def log_filter(t):
    a = logs.log_filter(log(t), [("c1", None), ("c2", "db0")], ["query", "data_change"], None, "2024-01-03", "2024-01-20", "%_")
    b = logs.log_filter(log(t), success=False, text="FAILURE 9")
    return a.select("id").unionAll(b.select(-F.col("id") - 1))


@query("log_search_page", f"""WITH {LOG_SQL}, f AS (SELECT id, executed_at, sql_text FROM log WHERE connection_id = 'c1'),
p AS (SELECT * FROM f WHERE executed_at < TIMESTAMP '2024-01-15 06:00:00' OR (executed_at = TIMESTAMP '2024-01-15 06:00:00' AND id < 4728))
SELECT id, executed_at::VARCHAR AS executed_at, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM p) > 150 AS has_more FROM p ORDER BY executed_at DESC, id DESC LIMIT 150""")
def log_search_page(t):
    rows = logs.log_filter(log(t), [("c1", None)]).select("id", "executed_at", "sql_text")
    page = logs.log_search_page(rows, 150, ("2024-01-15 06:00:00", 4728))
    return page.select("id", F.col("executed_at").cast("string").alias("executed_at"), "total", "has_more")
