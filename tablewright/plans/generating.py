"""Generation queries: values drawn for the ids of the given tables."""

from pyspark.sql import functions as F

from tablewright.operators import generate
from tablewright.operators.generate import stream_number
from tablewright.plans.registry import query

P = generate.PRIME


def sql_draw(key, stream, seed=0):
    """The draw of a row id as DuckDB arithmetic."""
    a = f"((({key}) % {P}) * 48271 + (({key}) // {P}) * 40692 + {stream + seed * 16807}) % {P}"
    b = f"((({a}) * ({a})) % {P} + ({a}) * 16807 + {stream}) % {P}"
    return f"(((({b}) * ({b})) % {P} + ({b}) * 48271 + 12345) % {P})"


def sql_int(key, low, high, stream):
    return f"({low} + {sql_draw(key, stream)} % {high - low + 1})"


def sql_unit(key, stream):
    return f"({sql_draw(key, stream)} / {float(P)})"


def sql_pick(key, values, stream):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][{sql_draw(key, stream)} % {len(values)} + 1]"


def sql_digits(key, count, stream):
    parts = [
        f"lpad(({sql_draw(key, stream + i)} % {10 ** min(9, count - i)})::VARCHAR, {min(9, count - i)}, '0')"
        for i in range(0, count, 9)
    ]
    return "(" + " || ".join(parts) + ")"


S = stream_number
K = "o_orderkey"


@query("gen_numeric", f"""
SELECT o_orderkey, {sql_int(K, -50, 1000, S('qty'))} AS qty, round(0 + {sql_unit(K, S('price'))} * 100, 2) AS price FROM orders""")
def gen_numeric(t):
    return generate.generate_columns(t.orders, "o_orderkey", [
        {"name": "qty", "type": "bigint", "generator": "number", "params": {"min": -50, "max": 1000}},
        {"name": "price", "type": "double", "generator": "number", "params": {"min": 0, "max": 100, "numberType": "decimal"}},
    ])


@query("gen_sequence", """
SELECT o_orderkey, 10 + o_orderkey * 3 AS plain, 5 + (((10 - o_orderkey * 7 - 5) % 21) + 21) % 21 AS cycled, least(1 + o_orderkey, 500) AS held FROM orders""")
def gen_sequence(t):
    return generate.generate_columns(t.orders, "o_orderkey", [
        {"name": "plain", "generator": "sequence", "params": {"startValue": 10, "increment": 3}},
        {"name": "cycled", "generator": "sequence", "params": {"startValue": 10, "increment": -7, "sequenceMin": 5, "sequenceMax": 25, "sequenceCycle": True}},
        {"name": "held", "generator": "sequence", "params": {"sequenceMax": 500}},
    ])


LOW, HIGH = 1577836800, 1735689600


@query("gen_temporal", f"""
SELECT o_orderkey, strftime(TIMESTAMP '1970-01-01' + to_seconds({sql_int(K, LOW, HIGH, S('at'))}), '%Y-%m-%d %H:%M:%S') AS at,
  strftime(TIMESTAMP '1970-01-01' + to_seconds({sql_int(K, LOW, HIGH, S('day'))}), '%Y-%m-%d') AS day,
  lpad({sql_int(K, 9, 17, S('clock'))}::VARCHAR, 2, '0') || ':' || lpad({sql_int(K, 0, 59, S('clock') + 1)}::VARCHAR, 2, '0') || ':' || lpad({sql_int(K, 0, 59, S('clock') + 2)}::VARCHAR, 2, '0') AS clock
FROM orders""")
def gen_temporal(t):
    span = {"start": "2020-01-01", "end": "2025-01-01"}
    out = generate.generate_columns(t.orders, "o_orderkey", [
        {"name": "at", "generator": "datetime", "params": span}, {"name": "day", "generator": "date", "params": span},
        {"name": "clock", "generator": "time", "params": {"startHour": 9, "endHour": 17}},
    ])
    return out.withColumns({"at": F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "day": F.col("day").cast("string")})


@query("gen_enum", f"""
SELECT o_orderkey, {sql_pick(K, ['new', 'open', 'done'], S('state'))} AS state, {sql_pick(K, list('ABCDE'), S('grade'))} AS grade FROM orders""")
def gen_enum(t):
    return generate.generate_columns(t.orders, "o_orderkey", [
        {"name": "state", "generator": "enum", "params": {"values": ["new", "open", "done"]}}, {"name": "grade", "generator": "enum"},
    ])


@query("gen_text", f"""
SELECT o_orderkey, substring(repeat('{generate.LOREM}', 4), {sql_int(K, 1, 60, S('note') + 1)}::INT, {sql_int(K, 50, 200, S('note'))}::INT) AS note,
  {sql_pick(K, generate.WORDS['currency'], S('money'))} AS money, true AS hex_ok, true AS alnum_ok, true AS bcrypt_ok, true AS version_ok, true AS slug_ok, true AS tags_ok
FROM orders""")
def gen_text(t):
    make = lambda n, fmt, **p: {"name": n, "generator": "text", "params": {"textFormat": fmt, **p}}
    out = generate.generate_columns(t.orders, "o_orderkey", [
        make("note", "lorem", minLength=50, maxLength=200), make("money", "currency"), make("hex", "hex"),
        make("alnum", "alphanumeric", minLength=8, maxLength=20), make("bcrypt", "bcrypt"), make("version", "version"),
        make("slug", "slug"), make("tags", "tag_list"),
    ])
    shapes = {
        "hex": "^[0-9a-f]{32}$", "alnum": "^[A-Za-z0-9]{8,20}$", "bcrypt": r"^\$2a\$10\$[./A-Za-z0-9]{53}$",
        "version": r"^v?\d+\.\d+\.\d+$", "slug": "^[a-z]+(-[a-z]+){1,3}$", "tags": "^[a-z]+(,[a-z]+){0,2}$",
    }
    return out.select("o_orderkey", "note", "money", *[F.col(n).rlike(p).alias(f"{n}_ok") for n, p in shapes.items()])


@query("gen_uuid", f"""
WITH h AS (SELECT o_orderkey, md5(o_orderkey || '/{S('uid')}/0') AS h FROM orders)
SELECT o_orderkey, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uid FROM h""")
def gen_uuid(t):
    return generate.generate_columns(t.orders, "o_orderkey", [{"name": "uid", "generator": "uuid"}])


@query("gen_fk", f"""
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer)
SELECT o_orderkey, c_custkey AS customer_id FROM orders JOIN p ON n = {sql_draw(K, S('customer_id'))} % (SELECT count(*) FROM customer)""")
def gen_fk(t):
    return generate.with_foreign_key(t.orders.select("o_orderkey"), "o_orderkey", "customer_id", t.customer, "c_custkey")


def sql_luhn(body, n):
    d = f"substring({body}, i, 1)::INT"
    return (f"((10 - list_sum(list_transform(range(1, {n + 1}), lambda i: CASE WHEN ({n} - i) % 2 = 0 THEN "
            f"CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END ELSE {d} END)) % 10) % 10)")


def sql_card(key, stream):
    cases = " ".join(
        f"WHEN {i} THEN left({sql_pick(key, prefixes, stream + 20)} || {sql_digits(key, 15, stream + 1)}, {length - 1})"
        for i, (prefixes, length) in enumerate(generate.CARDS.values())
    )
    return f"CASE {sql_draw(key, stream)} % {len(generate.CARDS)} {cases} END"


@query("gen_semantic", f"""
WITH b AS (SELECT o_orderkey, {sql_card(K, S('card'))} AS body FROM orders)
SELECT o_orderkey, {sql_pick(K, generate.FIRST, S('who'))} || ' ' || {sql_pick(K, generate.LAST, S('who') + 1)} AS who,
  CASE WHEN length(body) = 15 THEN body || {sql_luhn('body', 15)}::INT ELSE body || {sql_luhn('body', 14)}::INT END AS card, {sql_pick(K, generate.PICKS['city'], S('town'))} AS town,
  true AS mail_ok, true AS ip_ok, true AS mac_ok, true AS ean_ok, true AS url_ok FROM b""")
def gen_semantic(t):
    out = generate.generate_columns(t.orders, "o_orderkey", [
        {"name": "who", "generator": "full_name"}, {"name": "card", "generator": "credit_card_number"},
        {"name": "town", "generator": "city"}, {"name": "mail", "generator": "email"},
        {"name": "ip", "generator": "ip_address"}, {"name": "mac", "generator": "mac_address"},
        {"name": "ean", "generator": "barcode"}, {"name": "url", "generator": "url"},
    ])
    weights = sum((F.substring("ean", i + 1, 1).cast("int") * (1 if i % 2 == 0 else 3) for i in range(13)), F.lit(0))
    return out.select(
        "o_orderkey", "who", "card", "town", F.col("mail").rlike(r"^[a-z]+\.[a-z]+\d+@example\.(com|org|net)$").alias("mail_ok"),
        F.col("ip").rlike(r"^\d{1,3}(\.\d{1,3}){3}$").alias("ip_ok"), F.col("mac").rlike("^[0-9a-f]{2}(:[0-9a-f]{2}){5}$").alias("mac_ok"),
        (weights % 10 == 0).alias("ean_ok"), F.col("url").startswith("https://").alias("url_ok"),
    )


@query("gen_null_default", f"""
SELECT o_orderkey, CASE WHEN {sql_unit(K, S('status', 2))} * 100 < 20 THEN NULL WHEN {sql_unit(K, S('status', 1))} * 100 < 50 THEN 'active'
  ELSE {sql_pick(K, ['x', 'y'], S('status'))} END AS status, 'active' AS always FROM orders""")
def gen_null_default(t):
    return generate.generate_columns(t.orders, "o_orderkey", [
        {"name": "status", "generator": "enum", "default": "active",
         "params": {"values": ["x", "y"], "includeNull": True, "nullPercent": 20, "defaultPercent": 50}},
        {"name": "always", "type": "string", "default": "active"},
    ])


@query("gen_snowflake_ids", """
SELECT o_orderkey, ((1704067200000 - 1609459200000 + o_orderkey // 4096) << 22) | (1 << 12) | (o_orderkey % 4096) AS id,
  ((1719792000000 - 1609459200000 + o_orderkey // 4096) << 22) | (77 << 12) | (o_orderkey % 4096) AS other FROM orders""")
def gen_snowflake_ids(t):
    return generate.generate_columns(t.orders, "o_orderkey", [
        {"name": "id", "generator": "snowflake"},
        {"name": "other", "generator": "snowflake", "params": {"startMs": 1719792000000, "workerId": 77}},
    ])


@query("generate_rows", f"""
SELECT l_orderkey * 8 + l_linenumber AS id, {sql_int('l_orderkey * 8 + l_linenumber', 1, 1000, S('quantity'))} AS quantity,
  {sql_pick('l_orderkey * 8 + l_linenumber', generate.PICKS['city'], S('city'))} AS city,
  {sql_pick('l_orderkey * 8 + l_linenumber', list('ABCDE'), S('status'))} AS status FROM lineitem""")
def generate_rows(t):
    ids = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    # Generators are guessed from column names and types.
    return generate.generate_columns(ids, "id", [
        {"name": "quantity", "type": "bigint"}, {"name": "city", "type": "string"}, {"name": "status", "type": "string"},
    ])
