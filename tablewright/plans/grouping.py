"""Aggregation, bucket, window, join, paging and set queries."""

from pyspark.sql import functions as F

from tablewright.operators import aggregates, buckets, diff, paging, relate, stages, windows
from tablewright.plans.registry import query


@query("count_rows", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def count_rows(t):
    return aggregates.count_rows(t.lineitem, "l_quantity > 25", "n")


@query("count_query", """
SELECT count(*) AS count FROM (SELECT l_suppkey, l_returnflag FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 3000)""")
def count_query(t):
    q = t.spark.sql(
        "SELECT l_suppkey, l_returnflag FROM {l} GROUP BY ALL HAVING sum(l_quantity) > 3000", l=t.lineitem
    )
    return aggregates.count_rows(q)


@query("facet_distinct", """
SELECT l_partkey AS value, count(*) AS count FROM lineitem WHERE l_quantity > 10
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def facet_distinct(t):
    return aggregates.facet_distinct(t.lineitem, "l_partkey", "l_quantity > 10", limit=100)


@query("facet_search", """
SELECT CASE WHEN p_size = 7 THEN NULL ELSE p_name END AS value, count(*) AS count FROM part
WHERE CASE WHEN p_size = 7 THEN NULL ELSE p_name END LIKE '%ring%' GROUP BY 1""")
def facet_search(t):
    p = t.part.selectExpr("CASE WHEN p_size = 7 THEN NULL ELSE p_name END AS p_name")
    return aggregates.facet_distinct(p, "p_name", search="ring", by_value=True)


@query("distinct_field", """
SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part""")
def distinct_field(t):
    return aggregates.distinct_field(t.part.selectExpr("split(p_name, ' ') AS words"), "words")


@query("selection_summary", """
WITH s AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 5 = 0 THEN ' ' WHEN o_custkey % 5 = 1 THEN 'x' || o_custkey
  WHEN o_custkey % 5 = 2 THEN 'NaN' ELSE ' ' || o_custkey || ' ' END AS txt, o_custkey % 2 = 0 AS flag FROM orders),
n AS (SELECT *, CASE WHEN txt NOT LIKE '%N%' THEN try_cast(trim(txt) AS DOUBLE) END AS num FROM s)
SELECT count(*) * 4 AS cell_count, count(*) AS row_count, count(*) * 2 + count(num) AS numeric_count,
  round(sum(o_orderkey::DOUBLE) + sum(o_totalprice) + sum(num), 2) AS sum FROM n""")
def selection_summary(t):
    s = t.orders.selectExpr(
        "o_orderkey", "o_totalprice",
        "CASE WHEN o_custkey % 5 = 0 THEN ' ' WHEN o_custkey % 5 = 1 THEN concat('x', o_custkey)"
        " WHEN o_custkey % 5 = 2 THEN 'NaN' ELSE concat(' ', o_custkey, ' ') END AS txt",
        "o_custkey % 2 = 0 AS flag",
    )
    return aggregates.selection_summary(s).withColumn("sum", F.round("sum", 2))


GROUP_SQL = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rd,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rk,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rl,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rq FROM lineitem)
SELECT l_returnflag AS _id, sum(l_quantity) AS qty, round(avg(l_discount), 9) AS disc, min(l_shipdate)::VARCHAR AS first_ship,
  max(l_extendedprice) AS dear, count(*) AS n, round(stddev_pop(l_quantity), 6) AS sd, round(stddev_samp(l_quantity), 6) AS ss,
  max(l_extendedprice) FILTER (rk = 1) AS first_, max(l_extendedprice) FILTER (rl = 1) AS last_,
  max(l_partkey) FILTER (rd = 1) AS top_part,
  string_agg(l_extendedprice::VARCHAR, ',' ORDER BY rd) FILTER (rd <= 3) AS top3,
  string_agg(l_extendedprice::VARCHAR, ',' ORDER BY rk) FILTER (rk <= 3) AS first3,
  string_agg(l_extendedprice::VARCHAR, ',' ORDER BY rl DESC) FILTER (rl <= 3) AS last3,
  string_agg(l_quantity::VARCHAR, ',' ORDER BY rq) FILTER (rq <= 2) AS max2,
  quantile_disc(l_quantity, 0.5) AS med, array_to_string(quantile_disc(l_quantity, [0.1, 0.9]), ',') AS pct
FROM l GROUP BY 1"""


@query("group_accumulate", GROUP_SQL)
def group_accumulate(t):
    order = {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "l_extendedprice": 1}
    price = "$l_extendedprice"
    best = {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1}
    out = aggregates.group(t.lineitem, "$l_returnflag", {
        "qty": {"$sum": "$l_quantity"}, "disc": {"$avg": "$l_discount"}, "first_ship": {"$min": "$l_shipdate"},
        "dear": {"$max": price}, "n": {"$count": {}}, "sd": {"$stdDevPop": "$l_quantity"},
        "ss": {"$stdDevSamp": "$l_quantity"}, "first_": {"$first": {"input": price, "sortBy": order}},
        "last_": {"$last": {"input": price, "sortBy": order}},
        "top_part": {"$top": {"output": "$l_partkey", "sortBy": best}},
        "top3": {"$topN": {"n": 3, "output": price, "sortBy": best}},
        "first3": {"$firstN": {"n": 3, "input": price, "sortBy": order}},
        "last3": {"$lastN": {"n": 3, "input": price, "sortBy": order}},
        "max2": {"$maxN": {"n": 2, "input": "$l_quantity"}},
        "med": {"$median": {"input": "$l_quantity"}}, "pct": {"$percentile": {"input": "$l_quantity", "p": [0.1, 0.9]}},
    })
    return out.withColumns({
        "disc": F.round("disc", 9), "sd": F.round("sd", 6), "ss": F.round("ss", 6),
        "first_ship": F.col("first_ship").cast("string"),
        **{c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("top3", "first3", "last3", "max2", "pct")},
    })


@query("group_push", """
WITH r AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS rn FROM lineitem),
p AS (SELECT l_suppkey, rn // 40 AS chunk, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) AS parts FROM r GROUP BY ALL),
d AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS rn FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem)),
s AS (SELECT l_suppkey, rn // 40 AS chunk, string_agg(l_quantity::VARCHAR, ',' ORDER BY rn) AS quantities FROM d GROUP BY ALL),
n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey AS _id, chunk, coalesce(parts, '') AS parts, coalesce(quantities, '') AS quantities, n
FROM p FULL JOIN s USING (l_suppkey, chunk) JOIN n USING (l_suppkey)""")
def group_push(t):
    order = {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "l_extendedprice": 1}
    out = aggregates.group(t.lineitem, "$l_suppkey", {
        "parts": {"$push": {"input": "$l_partkey", "sortBy": order}},
        "quantities": {"$addToSet": "$l_quantity"}, "n": {"$count": {}},
    }, size=40)
    return out.withColumns({
        c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")) for c in ("parts", "quantities")
    })


@query("group_merge_objects", """
WITH e AS (SELECT user_id, event_type, ts, event_id, value FROM events)
SELECT user_id AS _id, event_type AS k, arg_max(value, (ts, event_id)) AS v FROM e GROUP BY ALL""")
def group_merge_objects(t):
    e = t.events.withColumn("m", F.create_map("event_type", "value"))
    out = aggregates.group(e, "$user_id", {"m": {"$mergeObjects": {"input": "$m", "sortBy": {"ts": 1, "event_id": 1}}}})
    return out.select("_id", F.explode("m").alias("k", "v"))


@query("count_stage", "SELECT count(*) AS total FROM lineitem WHERE l_quantity >= 10")
def count_stage(t):
    return stages.apply_stages(t.lineitem, [{"$match": {"l_quantity": {"$gte": 10}}}, {"$count": "total"}])


@query("sort_by_count", "SELECT l_shipdate::VARCHAR AS _id, count(*) AS count FROM lineitem GROUP BY 1")
def sort_by_count(t):
    out = stages.apply_stages(t.lineitem, [{"$sortByCount": "$l_shipdate"}])
    return out.withColumn("_id", F.col("_id").cast("string"))


@query("bucket", """
SELECT CASE WHEN n_chars < 200 THEN 'other' WHEN n_chars < 500 THEN '200' WHEN n_chars < 2000 THEN '500'
  WHEN n_chars < 10000 THEN '2000' ELSE 'other' END AS _id, count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM documents GROUP BY 1""")
def bucket(t):
    return buckets.bucket(
        t.documents, "$n_chars", [200, 500, 2000, 10000], "other",
        {"n": {"$sum": F.lit(1)}, "chars": {"$sum": "$n_chars"}},
    )


@query("bucket_auto", """
WITH v AS (SELECT n_chars, count(*) AS n FROM documents GROUP BY 1),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(n) OVER () AS total FROM v),
g AS (SELECT floor(before * 7 / total)::INT AS bucket_no, min(n_chars) AS min, max(n_chars) AS top, sum(n)::BIGINT AS n, sum(n * n_chars)::BIGINT AS chars
      FROM b GROUP BY 1)
SELECT bucket_no, min, coalesce(lead(min) OVER (ORDER BY bucket_no), top) AS max, n, chars FROM g""")
def bucket_auto(t):
    return buckets.bucket_auto(
        t.documents, "$n_chars", 7, {"n": {"$count": {}}, "chars": {"$sum": "$n_chars"}}
    )


@query("facet_multi", """
SELECT 'by_brand' AS facet, p_brand AS name, count(*) AS n FROM part GROUP BY 2
UNION ALL SELECT 'big', 'total', count(*) FROM part WHERE p_size > 25
UNION ALL SELECT 'by_type', p_type, count(*) FROM part GROUP BY 2""")
def facet_multi(t):
    parts = aggregates.facets(t.part, {
        "by_brand": [{"$sortByCount": "$p_brand"}],
        "big": [{"$match": {"p_size": {"$gt": 25}}}, {"$group": {"_id": {"$literal": "total"}, "count": {"$count": {}}}}],
        "by_type": [{"$sortByCount": "$p_type"}],
    })
    named = [df.select(F.lit(k).alias("facet"), F.col("_id").alias("name"), F.col("count").alias("n")) for k, df in parts.items()]
    return named[0].unionAll(named[1]).unionAll(named[2])


@query("search_agg_flatten", """
SELECT event_type AS type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS doc_count, max(value) AS top, count(DISTINCT user_id) AS users
FROM events GROUP BY ALL""")
def search_agg_flatten(t):
    return aggregates.search_agg_flatten(
        t.events, {"type": "$event_type", "day": {"$dateToString": {"date": "$ts", "format": "%Y-%m-%d"}}},
        {"top": F.max("value"), "users": F.countDistinct("user_id")},
    )


@query("chart_series", """
SELECT o_orderdate::VARCHAR AS x, o_totalprice, coalesce(try_cast(left(o_orderpriority, 2) AS DOUBLE), 0) AS prio FROM
(SELECT o_orderdate, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderpriority, 1) ELSE o_orderpriority END AS o_orderpriority FROM orders)""")
def chart_series(t):
    o = t.orders.selectExpr(
        "o_orderdate", "o_totalprice",
        "left(CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderpriority, 1) ELSE o_orderpriority END, 2) AS prio",
    )
    return aggregates.chart_series(o, "o_orderdate", ["o_totalprice", "prio"])


@query("profile_columns", """
SELECT 'l_suppkey' AS "column", count(*) AS rows, 0 AS nulls, count(*) AS "numeric", count(DISTINCT l_suppkey) AS distinct_values, true AS chartable FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), 0, 0, count(DISTINCT l_returnflag), false FROM lineitem
UNION ALL SELECT 'q', count(*), count(*) FILTER (l_quantity > 40), count(*) FILTER (l_quantity <= 40), count(DISTINCT l_quantity) FILTER (l_quantity <= 40), true FROM lineitem""")
def profile_columns(t):
    li = t.lineitem.selectExpr("l_suppkey", "l_returnflag", "CASE WHEN l_quantity <= 40 THEN l_quantity END AS q")
    return aggregates.profile_columns(li, exact=True)


KEYSPACE_SQL = """k AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN 'lone' || event_id
    ELSE 'app:' || event_type || ':' || (user_id % 10) || ':' || user_id || ':' || event_id END AS key,
  (event_id % 100)::BIGINT AS size FROM events)"""


def keyspace(t):
    return t.events.selectExpr(
        "CASE WHEN event_id % 50 = 0 THEN concat('lone', event_id) ELSE concat_ws(':', 'app', event_type,"
        " user_id % 10, user_id, event_id) END AS key", "event_id % 100 AS size",
    )


@query("key_prefix_rollup", f"""WITH {KEYSPACE_SQL},
p AS (SELECT string_split(key, ':') AS s, size FROM k),
e AS (SELECT s, size, unnest(range(1, len(s))) AS depth FROM p)
SELECT array_to_string(s[1:depth], ':') AS prefix, depth::INT AS depth, count(*) AS keys, sum(size)::BIGINT AS total_size FROM e GROUP BY ALL""")
def key_prefix_rollup(t):
    return aggregates.key_prefix_rollup(keyspace(t), "key", F.col("size"))


# --- windows ---------------------------------------------------------------

@query("set_window_fields", """
SELECT event_id, round(sum(value) OVER w, 4) AS run, count(*) OVER w AS n,
  round(avg(value) OVER w, 9) AS run_avg, max(value) OVER w AS high,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), 4) AS last6h,
  max(value) OVER (PARTITION BY user_id) AS best, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev,
  lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def set_window_fields(t):
    run = {"documents": ["unbounded", "current"]}
    out = windows.set_window_fields(t.events, "$user_id", {"ts": 1, "event_id": 1}, {
        "run": {"$sum": "$value", "window": run}, "n": {"$count": {}, "window": run},
        "run_avg": {"$avg": "$value", "window": run}, "high": {"$max": "$value", "window": run},
        "near": {"$sum": "$value", "window": {"documents": [-2, 1]}},
        "last6h": {"$sum": "$value", "window": {"range": [-6, 0], "unit": "hour"}},
        "best": {"$max": "$value"}, "prev": {"$shift": {"output": "$value", "by": -1}},
        "ahead": {"$shift": {"output": "$value", "by": 2}}, "no": {"$documentNumber": {}},
    })
    rounded = {"run": F.round("run", 4), "run_avg": F.round("run_avg", 9), "near": F.round("near", 4), "last6h": F.round("last6h", 4)}
    return out.withColumns(rounded).select(
        "event_id", "run", "n", "run_avg", "high", "near", "last6h", "best", "prev", "ahead", "no"
    )


HOURLY = """h AS (SELECT event_type, date_trunc('hour', ts) AS hr, max(value) AS v FROM events
  WHERE value > 25 GROUP BY ALL)"""


def hourly(t):
    return t.events.where("value > 25").groupBy("event_type", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hr")).agg(F.max("value").alias("v"))


@query("densify", f"""WITH {HOURLY},
b AS (SELECT min(hr) AS lo, max(hr) AS hi FROM h),
p AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hr FROM (SELECT DISTINCT event_type FROM h), b)
SELECT event_type, hr::VARCHAR AS hr, v FROM p LEFT JOIN h USING (event_type, hr)""")
def densify(t):
    out = windows.densify(hourly(t), "hr", 1, ["event_type"], "full", "hour", block=100)
    return out.withColumn("hr", F.col("hr").cast("string"))


@query("fill", f"""WITH {HOURLY},
b AS (SELECT min(hr) AS lo, max(hr) AS hi FROM h),
p AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hr FROM (SELECT DISTINCT event_type FROM h), b),
d AS (SELECT event_type, hr, epoch_us(hr) AS x, v, CASE WHEN v IS NOT NULL THEN epoch_us(hr) END AS vx FROM p LEFT JOIN h USING (event_type, hr)),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER pre AS y0, last_value(vx IGNORE NULLS) OVER pre AS x0,
  first_value(v IGNORE NULLS) OVER post AS y1, first_value(vx IGNORE NULLS) OVER post AS x1 FROM d
  WINDOW pre AS (PARTITION BY event_type ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         post AS (PARTITION BY event_type ORDER BY hr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, hr::VARCHAR AS hr, coalesce(v, 0) AS const, y0 AS locf, round(coalesce(v, y0 + (y1 - y0) * (x - x0) / (x1 - x0)), 6) AS linear FROM f""")
def fill(t):
    d = windows.densify(hourly(t), "hr", 1, ["event_type"], "full", "hour")
    d = d.select("event_type", "hr", *[F.col("v").alias(n) for n in ("const", "locf", "linear")])
    out = windows.fill(
        d, {"const": {"value": 0.0}, "locf": {"method": "locf"}, "linear": {"method": "linear"}},
        ["event_type"], ["hr"],
    )
    return out.withColumns({"hr": F.col("hr").cast("string"), "linear": F.round("linear", 6)})


RATES = """
WITH c AS (SELECT event_id, event_type, ts, (event_id * 3 - CASE WHEN event_id % 40 = 0 THEN 100000 ELSE 0 END)::DOUBLE AS counter FROM events),
p AS (SELECT *, lag(counter) OVER w AS c0, lag(ts) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, event_type, counter, round(CASE WHEN t0 IS NULL THEN NULL WHEN epoch_us(ts) - epoch_us(t0) <= 0 OR counter < c0 THEN 0
  ELSE (counter - c0) / ((epoch_us(ts) - epoch_us(t0)) / 1000000) END, 9) AS rate FROM p"""


def counters(t):
    return t.events.selectExpr(
        "event_id", "event_type", "ts",
        "CAST(event_id * 3 - CASE WHEN event_id % 40 = 0 THEN 100000 ELSE 0 END AS DOUBLE) AS counter",
    )


@query("rate_counters", RATES)
def rate_counters(t):
    out = windows.rate_counters(counters(t), ["event_type"], "ts", "counter", ["ts", "event_id"])
    return out.select("event_id", "event_type", "counter", F.round("rate", 9).alias("rate"))


@query("last_n_samples", """
SELECT event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 60""")
def last_n_samples(t):
    return windows.last_n_samples(t.events, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "value")


# --- paging and order --------------------------------------------------------

@query("scan_table_page", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200""")
def scan_table_page(t):
    return paging.scan_page(
        t.orders, ["o_orderkey", "o_totalprice"], "o_orderstatus = 'O'",
        [F.desc("o_totalprice"), "o_orderkey"], 100, 200,
    )


@query("sort_query", "SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY 2 DESC")
def sort_query(t):
    q = t.spark.sql("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {o} GROUP BY 1", o=t.orders)
    return paging.sort_query(q, 2, ascending=False)


@query("page_offset", """
SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem ORDER BY 1, 2 LIMIT 50 OFFSET 100""")
def page_offset(t):
    return paging.page_offset(t.lineitem.select("l_suppkey", "l_returnflag").distinct(), 50, 100)


@query("page_index", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate::VARCHAR AS l_shipdate FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS n, count(*) OVER () AS total FROM lineitem)
WHERE n BETWEEN 11 AND 30 OR n BETWEEN total // 2 + 1 AND total // 2 + 50""")
def page_index(t):
    """Two pages of one index: near the start, and in the middle."""
    index = paging.OrderIndex(t.lineitem, [F.desc("l_shipdate")], rows=2000)
    total = sum(n for _, n in index.counts)
    pages = index.page(20, 10).unionAll(index.page(50, total // 2))
    return pages.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_shipdate").cast("string").alias("l_shipdate"))


@query("page_keyset", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey > 7000 OR (l_orderkey = 7000 AND l_linenumber > 3) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 200""")
def page_keyset(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return paging.page_keyset(rows, ["l_orderkey", "l_linenumber"], [7000, 3], 200, ["l_partkey"])


@query("row_number_page", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders
QUALIFY row_no BETWEEN 5001 AND 5100""")
def row_number_page(t):
    return paging.row_number_page(
        t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 5001, 5100
    )


@query("topk_order", """
SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 ORDER BY n DESC, top DESC LIMIT 25""")
def topk_order(t):
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return g.orderBy(F.desc("n"), F.desc("top")).limit(25)


@query("sort_natural", r"""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE
  (CASE WHEN o_orderkey % 2 = 0 THEN 'Item-' ELSE 'ITEM-' END) || (o_custkey) || repeat('0', (o_orderkey % 30)::INT) || '-' || left(o_orderpriority, 1) END AS label FROM orders)
SELECT o_orderkey, label, row_number() OVER (ORDER BY label IS NULL,
  upper(split_part(label, '-', 1)) DESC, length(ltrim(split_part(label, '-', 2), '0')) DESC, ltrim(split_part(label, '-', 2), '0') DESC, split_part(label, '-', 3) DESC,
  o_orderkey) - 1 AS place FROM s""")
def sort_natural(t):
    s = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat(CASE WHEN o_orderkey % 2 = 0"
                            " THEN 'Item-' ELSE 'ITEM-' END, o_custkey, repeat('0', CAST(o_orderkey % 30 AS INT)), '-', left(o_orderpriority, 1)) END AS label")
    return paging.sort_natural(s, "label", False, ["o_orderkey"], index="place")


CENTROIDS = """c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
q AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY 1),
s AS (SELECT q.label AS query_id, vec_id AS id, {score} AS score FROM q, embeddings)"""


def centroids(t):
    """Mean vector per label."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v"))


@query("vector_topk", "WITH " + CENTROIDS.format(
    score="list_cosine_similarity(q.v, embedding::DOUBLE[])") + """
SELECT query_id::BIGINT AS query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, round(score, 6) AS score FROM s
QUALIFY rank <= 10""")
def vector_topk(t):
    out = paging.vector_topk(t.embeddings, centroids(t), 10)
    return out.withColumn("score", F.round("score", 6))


@query("vector_topk_l2", "WITH " + CENTROIDS.format(score="list_distance(q.v, embedding::DOUBLE[])") + """
SELECT query_id::BIGINT AS query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank, round(score, 6) AS score FROM s
QUALIFY rank <= 5""")
def vector_topk_l2(t):
    out = paging.vector_topk(t.embeddings, centroids(t), 5, "l2")
    return out.withColumn("score", F.round("score", 6))


@query("sample_n", "SELECT * FROM customer ORDER BY md5('7/' || c_custkey), c_custkey LIMIT 100")
def sample_n(t):
    return stages.sample(t.customer, 100, ["c_custkey"], seed=7)


# --- joins -------------------------------------------------------------------

RELATIONS = [
    relate.Relationship("orders", "o_custkey", "customer", "c_custkey"),
    relate.Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
    relate.Relationship("nation", "n_regionkey", "region", "r_regionkey"),
    relate.Relationship("part", "p_partkey", "supplier", "s_suppkey"),
]


@query("join_relationships", """
SELECT r_name, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def join_relationships(t):
    tables = {n: getattr(t, n) for n in ("orders", "customer", "nation", "region", "part", "supplier")}
    joined = relate.join_relationships(tables, RELATIONS, "orders")
    return joined.groupBy(F.col("region_r_name").alias("r_name")).agg(
        F.count("*").alias("orders"),
        F.sum(F.col("orders_o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query("lookup", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders),
m AS (SELECT o_custkey, rn // 8 AS chunk, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) AS keys, count(*)::INT AS n FROM r GROUP BY ALL)
SELECT c_custkey, coalesce(chunk, 0) AS chunk, coalesce(n, 0) AS n, coalesce(keys, '') AS keys
FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def lookup(t):
    out = relate.lookup(t.customer, t.orders, "c_custkey", "o_custkey", "found", ["o_orderkey"], size=8)
    return out.select(
        "c_custkey", "chunk", F.size("found").alias("n"),
        F.array_join(F.col("found.o_orderkey").cast("array<string>"), ",").alias("keys"),
    )


@query("lookup_array", """
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS el FROM part),
b AS (SELECT split_part(p_name, ' ', 1) AS word, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, string_agg(el || '=' || n, ',' ORDER BY el) AS found FROM w JOIN b ON el = word GROUP BY 1""")
def lookup_array(t):
    words = t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).agg(F.count("*").alias("n"))
    left = t.part.selectExpr("p_partkey", "split(p_name, ' ') AS names")
    out = relate.lookup(left, words, "names", "word", "found", ["word"], row_key=["p_partkey"])
    text = F.transform("found", lambda x: F.concat_ws("=", x["word"], x["n"]))
    return out.where(F.size("found") > 0).select("p_partkey", F.array_join(text, ",").alias("found"))


@query("graph_lookup", """
WITH RECURSIVE up AS (
  SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part
  UNION ALL SELECT start, node // 2, depth + 1 FROM up WHERE node > 0)
SELECT start, node, min(depth)::INT AS depth FROM up WHERE node IN (SELECT p_partkey FROM part WHERE p_size > 2) GROUP BY ALL
""")
def graph_lookup(t):
    # Every part hangs below the part of half its key, a tree as deep as log2(n).
    edges = t.part.selectExpr("p_partkey", "p_size", "CASE WHEN p_partkey > 0 THEN p_partkey DIV 2 END AS parent")
    starts = t.part.selectExpr("p_partkey AS start", "p_partkey AS value")
    found = relate.graph_lookup(starts, edges, "parent", "p_partkey")
    return found.join(t.part.where("p_size > 2").selectExpr("p_partkey AS node"), "node", "left_semi")


@query("union_with", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_with(t):
    c = t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS bal", "c_mktsegment AS segment")
    return stages.union_with(c, t.supplier.selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS bal"))


@query("name_diff", """
WITH s AS (SELECT DISTINCT lower(c_mktsegment) || c_nationkey AS name FROM customer WHERE c_nationkey < 20),
g AS (SELECT DISTINCT lower(c_mktsegment) || c_nationkey AS name FROM customer WHERE c_nationkey > 4)
SELECT 'added' AS status, name FROM s WHERE name NOT IN (FROM g)
UNION ALL SELECT 'removed', name FROM g WHERE name NOT IN (FROM s)
UNION ALL SELECT 'common', name FROM s WHERE name IN (FROM g)""")
def name_diff(t):
    names = t.customer.selectExpr("concat(lower(c_mktsegment), c_nationkey) AS name", "c_nationkey")
    s = names.where("c_nationkey < 20").select("name").distinct()
    g = names.where("c_nationkey > 4").select("name").distinct()
    added, removed = diff.only_in(s, g, ["name"]), diff.only_in(g, s, ["name"])
    common = s.join(g, "name", "left_semi")
    tagged = [d.select(F.lit(k).alias("status"), "name") for k, d in (("added", added), ("removed", removed), ("common", common))]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2])


@query("unwind", """
WITH w AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN string_split(p_name, ' ') END AS words FROM part)
SELECT p_partkey, u.word, u.at::BIGINT - 1 AS at FROM w, LATERAL (SELECT unnest(words) AS word, generate_subscripts(words, 1) AS at) u
UNION ALL SELECT p_partkey, NULL, NULL FROM w WHERE words IS NULL""")
def unwind(t):
    p = t.part.selectExpr("p_partkey", "CASE WHEN p_size > 3 THEN split(p_name, ' ') END AS word")
    return stages.unwind(p, "$word", "at", keep_empty=True)


@query("stages_orders", """
SELECT c_mktsegment AS _id, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice > 100000 GROUP BY 1""")
def stages_orders(t):
    return stages.apply_stages(
        t.orders,
        [
            {"$match": {"o_totalprice": {"$gt": 100000}}},
            {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}},
            {"$unwind": "$c"},
            {"$group": {"_id": "$c.c_mktsegment", "n": {"$count": {}}, "top": {"$max": "$o_totalprice"}}},
            {"$sort": {"_id": 1}},
        ],
        {"customer": t.customer},
    )

