"""Queries over whole tables for options and values that the main queries do not reach."""

from pyspark.sql import functions as F

from tablewright.operators import diff, filters, relate, segments, stages, sync, transfer, windows
from tablewright.plans.registry import query


@query("filter_long_list_null", """
SELECT p_partkey, size FROM (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_partkey END AS size FROM part)
WHERE size IS NULL OR (size % 3 = 0 AND size < 6000)""")
def filter_long_list_null(t):
    parts = t.part.selectExpr("p_partkey", "CASE WHEN p_size % 5 > 0 THEN p_partkey END AS size")
    return filters.filter_in_list(parts, "size", [None, *range(0, 6000, 3)])


@query("lookup_then_count", """
SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM orders)::BIGINT AS matches""")
def lookup_then_count(t):
    looked = {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}}
    tables = {"orders": t.orders}
    rows = stages.apply_stages(t.customer, [looked], tables)
    return rows.agg(F.count("*").alias("documents"), F.sum(F.size("found")).alias("matches"))


@query("lookup_unwind", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def lookup_unwind(t):
    out = stages.apply_stages(t.customer.select("c_custkey"), [
        {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}},
        {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}},
    ], {"orders": t.orders})
    return out.select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"))


@query("lookup_pipeline", """
SELECT c_custkey, count(o_orderkey)::INT AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS keys
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 AND o_orderstatus = 'O' GROUP BY 1""")
def lookup_pipeline(t):
    out = stages.apply_stages(t.customer, [{"$lookup": {
        "from": "orders", "let": {"key": "$c_custkey", "bal": "$c_acctbal"}, "as": "o",
        "pipeline": [
            {"$match": {"$expr": {"$and": [
                {"$eq": ["$o_custkey", "$$key"]}, {"$gt": ["$o_totalprice", {"$multiply": ["$$bal", 20]}]},
            ]}}},
            {"$match": {"o_orderstatus": "O"}}, {"$project": {"o_orderkey": 1}},
        ],
    }}], {"orders": t.orders})
    keys = F.array_join(F.sort_array("o.o_orderkey").cast("array<string>"), ",")
    return out.select("c_custkey", F.size("o").alias("n"), keys.alias("keys"))


@query("stage_facet", """
SELECT 'brands' AS facet, count(DISTINCT p_brand) AS n FROM part
UNION ALL SELECT 'large', count(*) FILTER (p_size > 25) FROM part""")
def stage_facet(t):
    out = stages.apply_stages(t.part, [{"$facet": {
        "brands": [{"$sortByCount": "$p_brand"}], "large": [{"$match": {"p_size": {"$gt": 25}}}],
    }}])
    return out.groupBy("facet").agg(F.count("*").alias("n"))


@query("stage_graph_lookup", """
WITH RECURSIVE up AS (
  SELECT p_partkey AS start, p_partkey // 2 AS node, 0 AS depth FROM part
  UNION ALL SELECT start, node // 2, depth + 1 FROM up WHERE node > 0 AND depth < 3)
SELECT p_partkey, count(node)::INT AS n, coalesce(sum(node), 0)::BIGINT AS total, max(depth)::BIGINT AS far
FROM part LEFT JOIN (SELECT start, node, min(depth) AS depth FROM up WHERE node IN (SELECT p_partkey FROM part) GROUP BY ALL) ON start = p_partkey GROUP BY 1""")
def stage_graph_lookup(t):
    parts = t.part.selectExpr("p_partkey", "p_partkey DIV 2 AS parent")
    out = stages.apply_stages(parts, [{"$graphLookup": {
        "from": "part", "startWith": "$parent", "connectFromField": "parent", "connectToField": "p_partkey",
        "as": "above", "maxDepth": 3, "depthField": "level",
    }}], {"part": parts})
    total = F.aggregate("above.p_partkey", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("p_partkey", F.size("above").alias("n"), total.alias("total"), F.array_max("above.level").alias("far"))


@query("stage_merge", """
SELECT coalesce(c.c_custkey, s.k) AS c_custkey, coalesce(s.b, c_acctbal) AS c_acctbal, c_mktsegment FROM customer c
FULL JOIN (SELECT s_suppkey * 3 AS k, s_acctbal AS b FROM supplier) s ON c.c_custkey = s.k""")
def stage_merge(t):
    target = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    return stages.apply_stages(t.supplier, [
        {"$project": {"c_custkey": {"$multiply": ["$s_suppkey", 3]}, "c_acctbal": "$s_acctbal"}},
        {"$merge": {"into": "customer", "on": "c_custkey"}},
    ], {"customer": target})


@query("window_directions", """
SELECT event_id, row_number() OVER d AS no, rank() OVER v AS place, dense_rank() OVER v AS dense,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS rest,
  coalesce(lead(value) OVER d, -1) AS next, first_value(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS near,
  round(stddev_pop(value) OVER (PARTITION BY user_id), 6) AS sd,
  count(*) OVER (PARTITION BY user_id ORDER BY ts DESC RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS recent
FROM events WINDOW d AS (PARTITION BY user_id ORDER BY ts DESC, event_id), v AS (PARTITION BY user_id ORDER BY event_type DESC)""")
def window_directions(t):
    whole = windows.set_window_fields(t.events, "$user_id", {"ts": -1, "event_id": 1}, {
        "no": {"$documentNumber": {}}, "rest": {"$sum": "$value", "window": {"documents": ["current", "unbounded"]}},
        "next": {"$shift": {"output": "$value", "by": 1, "default": -1.0}},
        "near": {"$first": "$value", "window": {"documents": [-2, -1]}}, "sd": {"$stdDevPop": "$value"},
        "recent": {"$count": {}, "window": {"range": [-6, 0], "unit": "hour"}},
    })
    ranked = windows.set_window_fields(whole, "$user_id", {"event_type": -1}, {"place": {"$rank": {}}, "dense": {"$denseRank": {}}})
    return ranked.select("event_id", "no", "place", "dense", F.round("rest", 4).alias("rest"), "next", "near", F.round("sd", 6).alias("sd"), "recent")


@query("window_cut_descending", """
SELECT event_id, row_number() OVER d AS no, round(sum(value) OVER (d ROWS UNBOUNDED PRECEDING), 4) AS run, lag(value) OVER d AS prev,
  round(sum(value) OVER (d ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS near
FROM events WINDOW d AS (PARTITION BY event_type ORDER BY ts DESC, event_id)""")
def window_cut_descending(t):
    """The form for keys beyond one task, here for all."""
    out = windows.set_window_fields(t.events, "$event_type", {"ts": -1, "event_id": 1}, {
        "no": {"$documentNumber": {}}, "run": {"$sum": "$value", "window": {"documents": ["unbounded", "current"]}},
        "prev": {"$shift": {"output": "$value", "by": -1}}, "near": {"$sum": "$value", "window": {"documents": [-3, 1]}},
    }, segments=6)
    return out.select("event_id", "no", F.round("run", 4).alias("run"), "prev", F.round("near", 4).alias("near"))


@query("running_text_order", """
SELECT event_id, sum(event_id) OVER w AS run, lag(event_id) OVER w AS prev FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY 'x' || event_id ROWS UNBOUNDED PRECEDING)""")
def running_text_order(t):
    named = t.events.selectExpr("event_id", "event_type", "concat('x', event_id) AS name")
    out = segments.running(named, ["event_type"], ["name"], {"run": ("sum", F.col("event_id")), "prev": ("lag", F.col("event_id"))}, segments=5)
    return out.select("event_id", "run", "prev")


@query("fill_cut", """
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v
FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN value END AS v FROM events)""")
def fill_cut(t):
    rows = t.events.selectExpr("event_id", "event_type", "ts", "CASE WHEN event_id % 7 = 0 THEN value END AS v")
    return windows.fill(rows, {"v": {"method": "locf"}}, ["event_type"], ["ts", "event_id"], segments=7).select("event_id", "v")


@query("densify_months", """
WITH m AS (SELECT DISTINCT o_orderpriority AS p, date_trunc('quarter', o_orderdate) AS q FROM orders),
r AS (SELECT p, min(q) AS lo, max(q) AS hi FROM m GROUP BY 1)
SELECT p, unnest(generate_series(lo, hi, INTERVAL 3 MONTH))::VARCHAR AS q FROM r""")
def densify_months(t):
    quarters = t.orders.select(F.col("o_orderpriority").alias("p"), F.date_trunc("QUARTER", "o_orderdate").cast("timestamp_ntz").alias("q"))
    some = quarters.distinct()
    return windows.densify(some, "q", 1, ["p"], "partition", "quarter", block=5).withColumn("q", F.col("q").cast("string"))


@query("densify_bounds", """
WITH h AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS d FROM events),
p AS (SELECT event_type, unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-01-09', INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT event_type FROM h))
SELECT event_type, d::VARCHAR AS d FROM (SELECT * FROM p UNION SELECT event_type, d FROM h)""")
def densify_bounds(t):
    days = t.events.select("event_type", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("d")).distinct()
    out = windows.densify(days, "d", 1, ["event_type"], ["2023-12-25 00:00:00", "2024-01-10 00:00:00"], "day")
    return out.withColumn("d", F.col("d").cast("string"))


@query("fn_date_options", """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M +0530') AS india, strftime(ts, '%G-W%V-%u') AS iso,
  strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS quarter_hour,
  strftime(time_bucket(INTERVAL 14 DAY, ts, TIMESTAMP '2000-01-03'), '%Y-%m-%d') AS fortnight,
  extract(hour FROM ts + INTERVAL 330 MINUTE)::INT AS hour FROM events""")
def fn_date_options(t):
    from tablewright.functions.expressions import expr

    zone = {"date": "$ts", "timezone": "+05:30"}
    return t.events.select(
        "event_id", expr({"$dateToString": {**zone, "format": "%Y-%m-%d %H:%M %z"}}).alias("india"),
        expr({"$dateToString": {"date": "$ts", "format": "%G-W%V-%u"}}).alias("iso"),
        F.date_format(expr({"$dateTrunc": {"date": "$ts", "unit": "minute", "binSize": 15}}), "yyyy-MM-dd HH:mm").alias("quarter_hour"),
        F.date_format(expr({"$dateTrunc": {"date": "$ts", "unit": "week", "binSize": 2, "startOfWeek": "monday"}}), "yyyy-MM-dd").alias("fortnight"),
        expr({"$hour": zone}).alias("hour"),
    )


@query("fn_substr_bytes", """
SELECT doc_id, left(text, 8) AS head FROM documents""")
def fn_substr_bytes(t):
    from tablewright.functions.expressions import expr

    bytes_of = {"$strLenBytes": {"$substrCP": ["$text", 0, 8]}}
    return t.documents.select("doc_id", expr({"$substrBytes": ["$text", 0, bytes_of]}).alias("head"))


SPECIAL = """src AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE s_acctbal END AS v FROM supplier),
tgt AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 < 2 THEN NULL WHEN s_suppkey % 8 = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS v FROM supplier WHERE s_suppkey % 10 > 0)"""


def special(t):
    source = t.supplier.selectExpr("s_suppkey AS k", "CASE s_suppkey % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE s_acctbal END AS v",
                                   "map('a', s_nationkey, 'b', 1) AS m")
    target = t.supplier.where("s_suppkey % 10 > 0").selectExpr(
        "s_suppkey AS k", "CASE WHEN s_suppkey % 4 < 2 THEN NULL WHEN s_suppkey % 8 = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS v",
        "map('b', 1, 'a', s_nationkey) AS m")
    return source, target


@query("diff_special_values", f"""WITH {SPECIAL}
SELECT CASE WHEN t.k IS NULL THEN 'added' ELSE 'modified' END AS status, s.k, CASE WHEN t.k IS NULL THEN '' ELSE 'v' END AS changed_columns
FROM src s LEFT JOIN tgt t ON s.k = t.k WHERE t.k IS NULL OR s.k % 8 = 3""")
def diff_special_values(t):
    return diff.diff_rows(*special(t), ["k"]).select("status", "k", "changed_columns")


@query("sync_special_values", f"""WITH {SPECIAL} SELECT k, v::VARCHAR AS v FROM src""")
def sync_special_values(t):
    source, target = special(t)
    text = F.when(F.isnan("v"), "nan").when(F.abs("v") == float("inf"), "inf").otherwise(F.col("v").cast("string"))
    return sync.sync_apply(source.drop("m"), target.drop("m"), ["k"]).select("k", text.alias("v"))


@query("update_paths", """
SELECT p_partkey, p_size + 1 AS size, p_name || '!' AS name, array_to_string(list_sort([p_size, 7, p_size + 3]), ',') AS sizes FROM part""")
def update_paths(t):
    docs = t.part.selectExpr(
        "p_partkey", "struct(p_size AS size, p_name AS name) AS d", "array(struct(p_size AS n)) AS lots", "concat(p_name, '!') AS loud")
    out = transfer.update_documents(docs, {}, {
        "$inc": {"d.size": 1}, "$set": {"d.name": F.col("loud")},
        "$push": {"lots": {"$each": [{"n": 7}], "$sort": {"n": 1}}},
    })
    more = out.select("p_partkey", F.col("d.size").alias("size"), F.col("d.name").alias("name"), F.col("lots.n").alias("n"))
    sizes = F.array_sort(F.concat("n", F.array((F.col("size") + 2).cast("int"))))
    return more.select("p_partkey", "size", "name", F.array_join(sizes.cast("array<string>"), ",").alias("sizes"))


@query("lookup_rows", """
SELECT p_partkey, s_suppkey FROM part LEFT JOIN supplier ON s_nationkey = p_size""")
def lookup_rows(t):
    out = relate.lookup_rows(t.part, t.supplier, "p_size", "s_nationkey", "s")
    return out.select("p_partkey", F.col("s.s_suppkey").alias("s_suppkey"))
