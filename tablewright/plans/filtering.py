"""Filter, projection and shape queries."""

from pyspark.sql import functions as F

from tablewright.operators import document_filter, filters, shape, stages
from tablewright.plans.registry import query

RULES = [
    ("eq", "equals", "F", None, "o_orderstatus = 'F'"),
    ("ne", "not-equals", "F", None, "o_orderstatus <> 'F'"),
    ("null", "is-null", None, None, "o_orderstatus IS NULL"),
    ("notnull", "is-not-null", None, None, "o_orderstatus IS NOT NULL"),
    ("like", "like", "URG", None, "o_orderpriority LIKE '%URG%'"),
    ("notlike", "not-like", "URG", None, "o_orderpriority NOT LIKE '%URG%'"),
    ("lt", "less-than", 100000.0, None, "o_totalprice < 100000"),
    ("gt", "greater-than", 100000.0, None, "o_totalprice > 100000"),
    ("in", "in", ["O", "P", "O"], None, "o_orderstatus IN ('O', 'P')"),
    ("notin", "not-in", ["O", "P"], None, "o_orderstatus NOT IN ('O', 'P')"),
    ("between", "between", 100000.0, 200000.0, "o_totalprice BETWEEN 100000 AND 200000"),
    ("notbetween", "not-between", 100000.0, 200000.0, "o_totalprice NOT BETWEEN 100000 AND 200000"),
]
RULE_COLUMN = {
    "like": "o_orderpriority", "notlike": "o_orderpriority", "lt": "o_totalprice",
    "gt": "o_totalprice", "between": "o_totalprice", "notbetween": "o_totalprice",
}


@query("filter_rule", "SELECT o_orderkey, " + ", ".join(f"({sql}) AS r_{n}" for n, _, _, _, sql in RULES)
       + " FROM orders")
def filter_rule(t):
    cols = [
        filters.filter_rule(RULE_COLUMN.get(n, "o_orderstatus"), mode, a, b).alias(f"r_{n}")
        for n, mode, a, b, _ in RULES
    ]
    return t.orders.select("o_orderkey", *cols)


NULLED = "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END"


@query("filter_in_null", f"""
WITH o AS (SELECT o_orderkey, {NULLED} AS st FROM orders)
SELECT 'in' AS test, o_orderkey FROM o WHERE st IS NULL OR st IN ('F')
UNION ALL SELECT 'not in', o_orderkey FROM o WHERE st IS NOT NULL AND st NOT IN ('F')
UNION ALL SELECT 'only null negated', o_orderkey FROM o WHERE st IS NOT NULL
UNION ALL SELECT 'empty', o_orderkey FROM o""")
def filter_in_null(t):
    o = t.orders.selectExpr("o_orderkey", f"{NULLED} AS st")
    cases = {
        "in": filters.filter_in("st", ["F", None, "F"]),
        "not in": filters.filter_in("st", ["F", None], negate=True),
        "only null negated": filters.filter_in("st", [None], negate=True),
        "empty": filters.filter_in("st", []),
    }
    tests = F.array_compact(F.array(*[
        F.when(F.lit(True) if p is None else p, F.lit(name)) for name, p in cases.items()
    ]))
    return o.select(F.explode(tests).alias("test"), "o_orderkey")


@query("filter_between", """
SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000
AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""")
def filter_between(t):
    price = filters.filter_rule("o_totalprice", "between", 50000.0, 150000.0)
    date = filters.filter_rule("o_orderdate", "between", "1996-01-01", "1997-12-31")
    assert filters.filter_rule("o_totalprice", "between", 50000.0, None) is None
    return t.orders.where(price & date).select("o_orderkey")


@query("filter_builder", """
SELECT o_orderkey FROM orders
WHERE (o_orderstatus = 'O' AND o_totalprice > 200000) OR o_orderpriority LIKE '%LOW%'""")
def filter_builder(t):
    rules = [
        {"column": "o_orderstatus", "mode": "equals", "value": "O"},
        {"column": "o_totalprice", "mode": "greater-than", "value": 200000.0, "joiner": "and"},
        {"column": "o_custkey", "mode": "equals", "value": 1, "enabled": False},
        {"column": "o_custkey", "mode": "between", "value": 1},
        {"column": "o_orderpriority", "mode": "like", "value": "LOW", "joiner": "or"},
    ]
    return t.orders.where(filters.filter_builder(rules)).select("o_orderkey")


@query("filter_parse_value", """
SELECT o_orderkey FROM orders
WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21) AND o_orderstatus IN ('F', 'O') AND o_totalprice > 1000.5
AND o_orderpriority IS NOT NULL""")
def filter_parse_value(t):
    o = t.orders
    parts = [
        filters.filter_parse_value(o, "o_custkey", "in", "1, 2,3\n5, 8,13 ,21"),
        filters.filter_parse_value(o, "o_orderstatus", "in", "'F', \"O\""),
        filters.filter_parse_value(o, "o_totalprice", "greater-than", " 1000.5 "),
        filters.filter_parse_value(o, "o_orderpriority", "not-equals", "null"),
    ]
    for p in parts:
        o = o.where(p)
    return o.select("o_orderkey")


@query("filter_in_list", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def filter_in_list(t):
    wanted = t.customer.where("c_acctbal > 5000").select("c_custkey")
    return filters.filter_in_list(t.orders, "o_custkey", wanted).select("o_orderkey")


def docs(t):
    """Parts as documents: a string array, an array of objects, a VARIANT."""
    return t.part.selectExpr(
        "p_partkey", "p_name", "p_size", "p_brand", "p_retailprice", "split(p_name, ' ') AS words",
        "transform(sequence(1, 1 + p_size % 3), i -> struct(i AS n, i * p_size AS qty)) AS lots",
        """parse_json(CASE p_partkey % 4 WHEN 0 THEN '{"a": null, "n": 5}' WHEN 1 THEN '{"n": 7, "s": "x"}'
           WHEN 2 THEN '{"a": "t", "tags": [1, 2]}' ELSE '{}' END) AS doc""",
    )


DOC_TESTS = {
    "elem_eq": ({"words": "red"}, "list_contains(words, 'red')"),
    "ne": ({"words": {"$ne": "red"}}, "NOT list_contains(words, 'red')"),
    "cmp": ({"p_size": {"$gte": 10, "$lt": 20}}, "p_size >= 10 AND p_size < 20"),
    "gt_lte": ({"p_size": {"$gt": 40}, "p_retailprice": {"$lte": 1000.0}}, "p_size > 40 AND p_retailprice <= 1000"),
    "in": ({"words": {"$in": ["bolt", "ring"]}}, "list_has_any(words, ['bolt', 'ring'])"),
    "nin": ({"p_brand": {"$nin": ["Brand#1", "Brand#2"]}}, "p_brand NOT IN ('Brand#1', 'Brand#2')"),
    "or": ({"$or": [{"p_size": 1}, {"p_size": 2}]}, "p_size IN (1, 2)"),
    "nor": ({"$nor": [{"p_size": 1}, {"p_brand": "Brand#3"}]}, "NOT (p_size = 1 OR p_brand = 'Brand#3')"),
    "and_not": ({"$and": [{"p_size": {"$not": {"$gt": 5}}}, {"p_brand": {"$ne": "Brand#3"}}]},
                "p_size <= 5 AND p_brand <> 'Brand#3'"),
    "exists": ({"doc.a": {"$exists": True}}, "p_partkey % 4 IN (0, 2)"),
    "missing": ({"doc.a": {"$exists": False}}, "p_partkey % 4 IN (1, 3)"),
    "variant_eq": ({"doc.n": 7}, "p_partkey % 4 = 1"),
    "variant_type": ({"doc.n": {"$type": "number"}}, "p_partkey % 4 IN (0, 1)"),
    "type": ({"p_name": {"$type": "string"}}, "true"),
    "regex": ({"p_name": {"$regex": "^RED", "$options": "i"}}, "p_name ILIKE 'red%'"),
    "mod": ({"p_size": {"$mod": [7, 3]}}, "p_size % 7 = 3"),
    "all": ({"words": {"$all": ["red", "ring"]}}, "list_contains(words, 'red') AND list_contains(words, 'ring')"),
    "elem_match": ({"lots": {"$elemMatch": {"n": {"$gte": 2}, "qty": {"$gt": 60}}}},
                   "len(list_filter(range(2, 2 + p_size % 3), lambda i: i * p_size > 60)) > 0"),
    "size": ({"lots": {"$size": 3}}, "p_size % 3 = 2"),
    "expr": ({"$expr": {"$gt": ["$p_retailprice", {"$multiply": ["$p_size", 40]}]}}, "p_retailprice > p_size * 40"),
    "bits_all": ({"p_size": {"$bitsAllSet": [0, 2]}}, "p_size & 5 = 5"),
    "bits_any": ({"p_size": {"$bitsAnySet": 6}}, "p_size & 6 <> 0"),
    "bits_clear": ({"p_size": {"$bitsAllClear": 6}}, "p_size & 6 = 0"),
    "bits_any_clear": ({"p_size": {"$bitsAnyClear": 3}}, "p_size & 3 <> 3"),
}


@query("filter_document", "WITH d AS (SELECT *, string_split(p_name, ' ') AS words FROM part) SELECT p_partkey, "
       + ", ".join(f"coalesce({sql}, false) AS t_{n}" for n, (_, sql) in DOC_TESTS.items()) + " FROM d")
def filter_document(t):
    d = docs(t)
    cols = [
        F.coalesce(document_filter.filter_document(d.schema, body), F.lit(False)).alias(f"t_{n}")
        for n, (body, _) in DOC_TESTS.items()
    ]
    return d.select("p_partkey", *cols)


@query("filter_search_bool", """
SELECT p_partkey FROM part
WHERE (p_name LIKE 'red%' OR p_name ILIKE '%RING%') AND p_size BETWEEN 5 AND 40
  AND p_brand NOT IN ('Brand#1', 'Brand#2') AND NOT (p_type = 'SMALL') AND p_retailprice IS NOT NULL
  AND p_size <> 7""")
def filter_search_bool(t):
    where = [
        "and", ["or", ["like", "p_name", "red%"], ["like", "p_name", "%RING%"]],
        ["between", "p_size", 5, 40], ["not-in", "p_brand", ["Brand#1", "Brand#2"]],
        ["not", ["=", "p_type", "SMALL"]], ["not-null", "p_retailprice"], ["!=", "p_size", 7],
    ]
    return t.part.where(filters.filter_search_bool(where)).select("p_partkey")


@query("filter_search_clauses", """
SELECT doc_id FROM documents
WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'der'])
  AND n_chars >= 100 AND n_chars < 4000 AND text IS NOT NULL
  AND (source ILIKE 'src1%' OR lang IN ('de', 'fr'))
  AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the($|[^\\p{L}\\p{N}])')
  AND source <> 'src3'""")
def filter_search_clauses(t):
    body = {
        "must": [{"match": {"text": "the DER"}}, {"range": {"n_chars": {"gte": 100, "lt": 4000}}}],
        "filter": [{"exists": {"field": "text"}}],
        "should": [{"wildcard": {"source": "SRC1*"}}, {"terms": {"lang": ["de", "fr"]}}],
        "must_not": [{"match_phrase": {"text": "of the"}}, {"term": {"source": "src3"}}],
    }
    return t.documents.where(filters.filter_search_clauses(body)).select("doc_id")


@query("document_filter_rule", """
SELECT p_partkey FROM part
WHERE (p_size >= 10 AND 20 < 2 * p_size AND p_size % 3 >= 1 AND p_name ILIKE '%red%') OR p_brand = 'Brand#5'""")
def document_filter_rule(t):
    d = docs(t)
    rules = [
        {"field": "lots.n", "mode": "equals", "value": 2},
        {"field": "lots.qty", "mode": "greater-or-equal", "value": 20},
        {"field": "lots.qty", "mode": "greater-than", "value": 20, "joiner": "and"},
        {"field": "p_size", "mode": "greater-or-equal", "value": 10, "joiner": "and"},
        {"field": "p_name", "mode": "contains", "value": "RED", "joiner": "and"},
        {"field": "p_name", "mode": "equals", "value": None},
        {"field": "p_brand", "mode": "equals", "value": "Brand#5", "joiner": "or"},
    ]
    return document_filter.match(
        d, document_filter.document_filter_rule(d.schema, rules)
    ).select("p_partkey")


@query("filter_null_equality", f"""
WITH o AS (SELECT o_orderkey, {NULLED} AS st FROM orders)
SELECT o_orderkey, st IS NULL AS missing, st IS NOT NULL AS present FROM o""")
def filter_null_equality(t):
    o = t.orders.selectExpr("o_orderkey", f"{NULLED} AS st")
    return o.select(
        "o_orderkey", filters.filter_null_equality("st", True).alias("missing"),
        filters.filter_null_equality("st", False).alias("present"),
    )


@query("params_bind", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > 250000 AND o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def params_bind(t):
    return t.spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :least"
        " AND o_orderstatus = :status AND array_contains(:priorities, o_orderpriority)",
        args={"least": 250000.0, "status": "O", "priorities": F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))},
        orders=t.orders,
    )


@query("stage_basic", """
SELECT p_partkey, p_size FROM part WHERE p_size > 10 ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 20""")
def stage_basic(t):
    return stages.apply_stages(t.part, [
        {"$match": {"p_size": {"$gt": 10}}}, {"$sort": {"p_size": -1, "p_partkey": 1}},
        {"$skip": 20}, {"$limit": 50}, {"$project": {"p_partkey": 1, "p_size": 1}},
    ])


@query("find_documents", """
WITH f AS (SELECT p_partkey, p_name FROM part WHERE p_size >= 25 AND p_name LIKE 'red%')
SELECT p_partkey, p_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_partkey LIMIT 20 OFFSET 5""")
def find_documents(t):
    page, total = stages.find_documents(
        t.part, {"p_size": {"$gte": 25}, "p_name": {"$regex": "^red"}},
        {"p_partkey": 1, "p_name": 1}, {"p_partkey": 1}, skip=5, limit=20,
    )
    return page.select("*", F.lit(total.first()["total"]).alias("total"))


@query("project_fields", """
SELECT p_partkey AS id, upper(p_name) AS name, p_size * 2 AS double_size FROM part""")
def project_fields(t):
    return stages.apply_stages(t.part, [
        {"$addFields": {"double_size": {"$multiply": ["$p_size", 2]}}},
        {"$unset": ["p_brand", "p_type"]},
        {"$project": {"root": {"id": "$p_partkey", "name": {"$toUpper": "$p_name"}, "double_size": "$double_size"}}},
        {"$replaceRoot": {"newRoot": "$root"}},
    ])


@query("unpivot_cells", f"""
WITH o AS (SELECT o_orderkey, o_custkey, {NULLED} AS st, o_totalprice FROM orders)
SELECT o_orderkey, 'o_custkey' AS "column", 'bigint' AS type, o_custkey::VARCHAR AS value, o_custkey IS NULL AS is_null FROM o
UNION ALL SELECT o_orderkey, 'st', 'string', st, st IS NULL FROM o
UNION ALL SELECT o_orderkey, 'o_totalprice', 'double', o_totalprice::VARCHAR, o_totalprice IS NULL FROM o""")
def unpivot_cells(t):
    o = t.orders.selectExpr("o_orderkey", "o_custkey", f"{NULLED} AS st", "o_totalprice")
    return shape.unpivot_cells(o, ["o_orderkey"])


@query("transpose", """
WITH g AS (SELECT o_orderpriority AS p, count(*) AS orders, min(o_totalprice) AS low, max(o_totalprice) AS high
           FROM orders GROUP BY 1),
c AS (SELECT p, 'orders' AS "column", orders::VARCHAR AS v FROM g UNION ALL SELECT p, 'low', low::VARCHAR FROM g
      UNION ALL SELECT p, 'high', high::VARCHAR FROM g)
SELECT "column", max(v) FILTER (p = '1-URGENT') AS "1-URGENT", max(v) FILTER (p = '2-HIGH') AS "2-HIGH",
       max(v) FILTER (p = '3-MEDIUM') AS "3-MEDIUM", max(v) FILTER (p = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
       max(v) FILTER (p = '5-LOW') AS "5-LOW" FROM c GROUP BY 1""")
def transpose(t):
    g = t.orders.groupBy(F.col("o_orderpriority").alias("p")).agg(
        F.count("*").alias("orders"), F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
    )
    return shape.transpose(g, "p", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
