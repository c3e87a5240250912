"""Document expression families, each as one projection over a whole table."""

from pyspark.sql import functions as F

from tablewright.functions.expressions import expr
from tablewright.plans.registry import query


def pick(df, ids, **fields):
    return df.select(*ids, *[expr(v).alias(k) for k, v in fields.items()])


@query("fn_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size,
  coalesce(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END, 'none') AS st,
  CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS code
FROM orders""")
def fn_conditional(t):
    o = t.orders.withColumn("s", F.expr("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END"))
    return pick(
        o, ["o_orderkey"],
        size={"$cond": [{"$gt": ["$o_totalprice", 200000]}, "big", "small"]},
        st={"$ifNull": ["$s", "none"]},
        code={"$switch": {"branches": [
            {"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 1},
            {"case": {"$eq": ["$o_orderstatus", "O"]}, "then": 2}], "default": 0}},
    )


@query("fn_compare", """
SELECT o_orderkey, o_custkey = 7 AS eq, o_custkey <> 7 AS ne, o_custkey > 700 AS gt, o_custkey >= 700 AS gte,
  o_custkey < 700 AS lt, o_custkey <= 700 AS lte,
  CASE WHEN o_custkey < 700 THEN -1 WHEN o_custkey > 700 THEN 1 ELSE 0 END AS cmp,
  o_custkey > 700 AND o_totalprice > 1000 AS both_, o_custkey > 700 OR o_totalprice > 1000 AS either,
  NOT (o_custkey > 700) AS neither
FROM orders""")
def fn_compare(t):
    c = "$o_custkey"
    return pick(
        t.orders, ["o_orderkey"], eq={"$eq": [c, 7]}, ne={"$ne": [c, 7]}, gt={"$gt": [c, 700]},
        gte={"$gte": [c, 700]}, lt={"$lt": [c, 700]}, lte={"$lte": [c, 700]}, cmp={"$cmp": [c, 700]},
        both_={"$and": [{"$gt": [c, 700]}, {"$gt": ["$o_totalprice", 1000]}]},
        either={"$or": [{"$gt": [c, 700]}, {"$gt": ["$o_totalprice", 1000]}]},
        neither={"$not": [{"$gt": [c, 700]}]},
    )


@query("fn_math", """
SELECT o_orderkey, o_custkey + 5 + o_orderkey AS add_, o_custkey - o_orderkey AS sub, o_custkey * 3 AS mul,
  o_totalprice / 7 AS div, o_custkey % 7 AS mod_, abs(o_custkey - o_orderkey) AS abs_,
  ceil(o_totalprice)::BIGINT AS ceil_, floor(o_totalprice)::BIGINT AS floor_,
  round_even(o_totalprice, 1) AS round1, round_even(o_custkey / 2, 0) AS half_even,
  trunc(o_totalprice - 250000) AS trunc_, pow(o_custkey, 2) AS pow_, sqrt(o_totalprice) AS sqrt_,
  round(ln(o_totalprice), 9) AS ln_, round(ln(o_totalprice) / ln(2), 9) AS log2_, round(exp(o_custkey % 5), 9) AS exp_
FROM orders""")
def fn_math(t):
    c, k, p = "$o_custkey", "$o_orderkey", "$o_totalprice"
    out = pick(
        t.orders, ["o_orderkey"], add_={"$add": [c, 5, k]}, sub={"$subtract": [c, k]}, mul={"$multiply": [c, 3]},
        div={"$divide": [p, 7]}, mod_={"$mod": [c, 7]}, abs_={"$abs": {"$subtract": [c, k]}},
        ceil_={"$ceil": p}, floor_={"$floor": p}, round1={"$round": [p, 1]},
        half_even={"$round": [{"$divide": [c, 2]}, 0]}, trunc_={"$trunc": {"$subtract": [p, 250000]}},
        pow_={"$pow": [c, 2]}, sqrt_={"$sqrt": p}, ln_={"$ln": p}, log2_={"$log": [p, 2]},
        exp_={"$exp": {"$mod": [c, 5]}},
    )
    return out.withColumns({n: F.round(n, 9) for n in ("ln_", "log2_", "exp_")})


@query("fn_string", """
SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, string_split(c_name, '#')[2] AS after,
  substring(c_name, 1, 8) AS head, substring(c_name, 10, 3) AS mid, length(c_name) AS chars, strlen(c_name) AS bytes,
  CASE WHEN upper(c_mktsegment) < 'FURNITURE' THEN -1 WHEN upper(c_mktsegment) > 'FURNITURE' THEN 1 ELSE 0 END AS cmp,
  lower(c_name) AS low, upper(c_name) AS up, trim('  ' || c_name || ' ') AS trimmed,
  ltrim(c_name, 'Cus') AS ltrimmed, rtrim(c_name, '0') AS rtrimmed,
  regexp_replace(c_name, '0', 'x') AS one, replace(c_name, '0', 'x') AS every,
  regexp_matches(c_name, '[0-9]+7$') AS has7, regexp_extract(c_name, '[1-9]+') AS digits_or_empty,
  len(regexp_extract_all(c_name, '[1-9]')) AS n_digits, instr(c_name, '#') - 1 AS at, instr(c_name, 'zz') - 1 AS absent
FROM customer""")
def fn_string(t):
    n = "$c_name"
    return pick(
        t.customer, ["c_custkey"], joined={"$concat": [n, "/", "$c_mktsegment"]},
        after={"$arrayElemAt": [{"$split": [n, "#"]}, 1]}, head={"$substr": [n, 0, 8]},
        mid={"$substrCP": [n, 9, 3]}, chars={"$strLenCP": n}, bytes={"$strLenBytes": n},
        cmp={"$strcasecmp": ["$c_mktsegment", "furniture"]}, low={"$toLower": n}, up={"$toUpper": n},
        trimmed={"$trim": {"input": {"$concat": ["  ", n, " "]}}}, ltrimmed={"$ltrim": {"input": n, "chars": "Cus"}},
        rtrimmed={"$rtrim": {"input": n, "chars": "0"}},
        one={"$replaceOne": {"input": n, "find": "0", "replacement": "x"}},
        every={"$replaceAll": {"input": n, "find": "0", "replacement": "x"}},
        has7={"$regexMatch": {"input": n, "regex": "[0-9]+7$"}},
        digits_or_empty={"$ifNull": [{"$getField": {
            "input": {"$regexFind": {"input": n, "regex": "[1-9]+"}}, "field": "match"}}, ""]},
        n_digits={"$size": {"$regexFindAll": {"input": n, "regex": "[1-9]"}}},
        at={"$indexOfCP": [n, "#"]}, absent={"$indexOfBytes": [n, "zz"]},
    )


ARR = "transform(sequence(1, 1 + p_size % 5), i -> CAST(i * p_size AS INT))"


@query("fn_array", """
WITH a AS (SELECT p_partkey, p_size, list_transform(range(1, 2 + p_size % 5), lambda i: (i * p_size)::INT) AS v FROM part)
SELECT p_partkey, len(v) AS n, v[2] AS second, v[1] AS first_, v[-1] AS last_, v[-2] AS back,
  list_sum(v[1:2])::BIGINT AS slice_sum, list_contains(v, 20) AS has20, coalesce(list_position(v, 20), 0) - 1 AS at20,
  len(v) * 2 AS twice, len(list_filter(v, lambda x: x > 30)) AS over30, list_sum(list_transform(v, lambda x: x + 1))::BIGINT AS plus1,
  list_sum(v)::BIGINT AS total, list_reverse(v)[1] AS rev1, list_sort(v, 'DESC')[1] AS top, p_size % 5 AS range_n,
  len(v) AS zip_n, true AS is_arr
FROM a""")
def fn_array(t):
    a = t.part.selectExpr("p_partkey", "p_size", f"{ARR} AS v")
    out = pick(
        a, ["p_partkey"], n={"$size": "$v"}, second={"$arrayElemAt": ["$v", 1]}, first_={"$first": "$v"},
        last_={"$last": "$v"}, back={"$arrayElemAt": ["$v", -2]},
        slice_sum={"$reduce": {"input": {"$slice": ["$v", 2]}, "initialValue": F.lit(0).cast("bigint"),
                               "in": {"$add": ["$$value", "$$this"]}}},
        has20={"$in": [20, "$v"]}, at20={"$indexOfArray": ["$v", 20]},
        twice={"$size": {"$concatArrays": ["$v", "$v"]}},
        over30={"$size": {"$filter": {"input": "$v", "as": "x", "cond": {"$gt": ["$$x", 30]}}}},
        plus1={"$reduce": {"input": {"$map": {"input": "$v", "as": "x", "in": {"$add": ["$$x", 1]}}},
                           "initialValue": F.lit(0).cast("bigint"), "in": {"$add": ["$$value", "$$this"]}}},
        total={"$reduce": {"input": "$v", "initialValue": F.lit(0).cast("bigint"),
                           "in": {"$add": ["$$value", "$$this"]}}},
        rev1={"$first": {"$reverseArray": "$v"}}, top={"$first": {"$sortArray": {"input": "$v", "sortBy": -1}}},
        range_n={"$size": {"$range": [0, {"$mod": ["$p_size", 5]}]}},
        zip_n={"$size": {"$zip": {"inputs": ["$v", {"$reverseArray": "$v"}]}}}, is_arr={"$isArray": "$v"},
    )
    return out.withColumn("at20", F.col("at20").cast("int"))


@query("fn_object", """
SELECT c_custkey, 2 AS entries, c_mktsegment AS seg, c_name || '!' AS changed,
  c_nationkey::VARCHAR AS merged_a, 'late' AS merged_b
FROM customer""")
def fn_object(t):
    c = t.customer.selectExpr(
        "c_custkey", "struct(c_name AS name, c_mktsegment AS seg) AS obj",
        "map('a', CAST(c_nationkey AS STRING), 'b', 'early') AS m1", "map('b', 'late') AS m2",
    )
    return pick(
        c, ["c_custkey"], entries={"$size": {"$objectToArray": "$m1"}},
        seg={"$getField": {"input": "$obj", "field": "seg"}},
        changed={"$getField": {"input": {"$setField": {
            "input": "$obj", "field": "name", "value": {"$concat": ["$obj.name", "!"]}}}, "field": "name"}},
        merged_a={"$getField": {"input": {"$mergeObjects": ["$m1", "$m2"]}, "field": "a"}},
        merged_b={"$getField": {"input": {"$mergeObjects": ["$m1", "$m2"]}, "field": "b"}},
    )


SETS = ("split(p_name, ' ') AS a", "array('red', 'ring', 'red') AS b")


@query("fn_setcheck", """
WITH s AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS a FROM part)
SELECT p_partkey, list_contains(a, 'red') AND list_contains(a, 'ring') AND len(a) = 2 AS same_set,
  len(list_filter(a, lambda x: x NOT IN ('red', 'ring'))) = 0 AS subset_, len(list_filter(a, lambda x: x = 'red')) = len(a) AS all_red,
  list_contains(a, 'red') AS any_red
FROM s""")
def fn_setcheck(t):
    s = t.part.selectExpr("p_partkey", *SETS)
    is_red = {"$map": {"input": "$a", "as": "w", "in": {"$eq": ["$$w", "red"]}}}
    return pick(
        s, ["p_partkey"], same_set={"$setEquals": ["$a", "$b"]}, subset_={"$setIsSubset": ["$a", "$b"]},
        all_red={"$allElementsTrue": is_red}, any_red={"$anyElementTrue": is_red},
    )


@query("array_sets", """
WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, ['red', 'ring']))), ',') AS u,
  array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x IN ('red', 'ring')))), ',') AS i,
  array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x NOT IN ('red', 'ring')))), ',') AS d
FROM s""")
def array_sets(t):
    s = t.part.selectExpr("p_partkey", *SETS)
    out = pick(
        s, ["p_partkey"], u={"$setUnion": ["$a", "$b"]}, i={"$setIntersection": ["$a", "$b"]},
        d={"$setDifference": ["$a", "$b"]},
    )
    return out.withColumns({n: F.concat_ws(",", F.array_sort(n)) for n in "uid"})


@query("fn_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS text, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h,
  minute(ts) AS mi, second(ts) AS s, (millisecond(ts) % 1000) AS ms, strftime(ts, '%U')::INT AS week_, dayofyear(ts) AS doy,
  isoyear(ts) AS iso_y, weekofyear(ts) AS iso_w, isodow(ts) AS iso_d, dayofweek(ts) + 1 AS dow,
  strftime(ts + INTERVAL 1 MONTH, '%Y-%m-%d') AS plus_month, strftime(ts - INTERVAL 36 HOUR, '%Y-%m-%d %H') AS minus_hours,
  date_diff('day', TIMESTAMP '2024-01-10 18:00:00', ts) AS days, date_diff('month', TIMESTAMP '2023-11-30', ts) AS months,
  strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour_start,
  strftime(make_timestamp(year(ts), month(ts), 1, 12, 0, 0), '%Y-%m-%d %H') AS parts
FROM events""")
def fn_date(t):
    ts = "$ts"
    text = lambda value, fmt: {"$dateToString": {"date": value, "format": fmt}}
    import datetime as dt
    return pick(
        t.events, ["event_id"], text=text(ts, "%Y-%m-%d %H:%M"), y={"$year": ts}, mo={"$month": ts},
        d={"$dayOfMonth": ts}, h={"$hour": ts}, mi={"$minute": ts}, s={"$second": ts}, ms={"$millisecond": ts},
        week_={"$week": ts}, doy={"$dayOfYear": ts}, iso_y={"$isoWeekYear": ts}, iso_w={"$isoWeek": ts},
        iso_d={"$isoDayOfWeek": ts}, dow={"$dayOfWeek": ts},
        plus_month=text({"$dateAdd": {"startDate": ts, "unit": "month", "amount": 1}}, "%Y-%m-%d"),
        minus_hours=text({"$dateSubtract": {"startDate": ts, "unit": "hour", "amount": 36}}, "%Y-%m-%d %H"),
        days={"$dateDiff": {"startDate": {"$literal": dt.datetime(2024, 1, 10, 18)}, "endDate": ts, "unit": "day"}},
        months={"$dateDiff": {"startDate": {"$literal": dt.datetime(2023, 11, 30)}, "endDate": ts, "unit": "month"}},
        hour_start=text({"$dateTrunc": {"date": ts, "unit": "hour"}}, "%Y-%m-%d %H:%M"),
        parts=text({"$dateFromParts": {"year": {"$year": ts}, "month": {"$month": ts}, "day": 1, "hour": 12}},
                   "%Y-%m-%d %H"),
    )


@query("fn_convert", """
WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS raw FROM customer)
SELECT c_custkey, 'long' AS type_key, 'double' AS type_bal, c_custkey::VARCHAR AS str, try_cast(raw AS INT) AS as_int,
  try_cast(raw AS BIGINT) AS as_long, try_cast(raw AS DOUBLE) AS as_double, coalesce(try_cast(raw AS INT), -1) AS safe,
  true AS num, false AS not_num, '$c_name' AS lit
FROM c""")
def fn_convert(t):
    c = t.customer.selectExpr("*", "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey AS STRING) END AS raw")
    return pick(
        c, ["c_custkey"], type_key={"$type": "$c_custkey"}, type_bal={"$type": "$c_acctbal"},
        str={"$toString": "$c_custkey"}, as_int={"$toInt": "$raw"}, as_long={"$toLong": "$raw"},
        as_double={"$toDouble": "$raw"}, safe={"$convert": {"input": "$raw", "to": "int", "onError": -1}},
        num={"$isNumber": "$c_acctbal"}, not_num={"$isNumber": "$raw"}, lit={"$literal": "$c_name"},
    )


@query("fn_misc", """
SELECT c_custkey, (c_nationkey * 10 + 5) * 2 AS let_, true AS in_range FROM customer""")
def fn_misc(t):
    return pick(
        t.customer, ["c_custkey"],
        let_={"$let": {"vars": {"x": {"$add": [{"$multiply": ["$c_nationkey", 10]}, 5]}},
                       "in": {"$multiply": ["$$x", 2]}}},
        in_range={"$let": {"vars": {"r": {"$rand": {}}},
                           "in": {"$and": [{"$gte": ["$$r", 0]}, {"$lt": ["$$r", 1]}]}}},
    )
