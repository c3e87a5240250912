"""Synthetic rows, the same for a given id, column and seed on every run.

Each value is arithmetic over the row id, a number for the column and the seed,
so a retried or repartitioned task makes the same data and no generator state is
shared. Expressions are plain integer arithmetic inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
import re
import zlib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.segments import with_running_index

PRIME = 2147483647
SNOWFLAKE_EPOCH_MS = 1_609_459_200_000  # fixed value
SNOWFLAKE_SEQUENCES, SNOWFLAKE_WORKERS = 4096, 1024  # fixed values
SNOWFLAKE_START_MS = 1_704_067_200_000  # 2024-01-01, unless a column says otherwise


def stream_number(name: str, part: int = 0) -> int:
    """The number that tells one column (and one draw in it) from another."""
    return (zlib.crc32(f"{name}/{part}".encode()) % PRIME) or 1


class RowDraws:
    """The random draws of one row.

    Every draw becomes a column of its own, computed in three steps that each
    use the step before twice; as columns they are computed once, however often
    a generator refers to them.
    """

    def __init__(self, row_id: Column, seed: int = 0):
        self.id, self.seed = row_id, seed
        self.streams: set[int] = set()
        self.kept: dict[str, Column] = {}

    def draw(self, stream: int) -> Column:
        """An integer in [0, 2^31-1) that looks random over ids."""
        self.streams.add(stream)
        return F.col(f"_d{stream}")

    def keep(self, value: Column) -> Column:
        """A value built from draws that is used more than once."""
        name = f"_k{len(self.kept)}"
        self.kept[name] = value
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        p = F.lit(PRIME)
        df = df.withColumns({"_low": F.pmod(self.id, p), "_high": F.floor(self.id / p).cast("bigint")})
        names = sorted(self.streams)

        def first(n: int) -> Column:
            return (F.col("_low") * 48271 + F.col("_high") * 40692 + F.lit(n + self.seed * 16807)) % p

        def second(n: int) -> Column:
            a = F.col(f"_a{n}")
            return ((a * a) % p + a * 16807 + F.lit(n)) % p

        def third(n: int) -> Column:
            b = F.col(f"_b{n}")
            return ((b * b) % p + b * 48271 + 12345) % p

        df = df.withColumns({f"_a{n}": first(n) for n in names}) if names else df
        df = df.withColumns({f"_b{n}": second(n) for n in names}) if names else df
        df = df.withColumns({f"_d{n}": third(n) for n in names}) if names else df
        return df.withColumns(self.kept) if self.kept else df


def unit(r: RowDraws, stream: int) -> Column:
    return r.draw(stream) / F.lit(float(PRIME))


def int_between(r: RowDraws, low: int, high: int, stream: int) -> Column:
    low, high = min(low, high), max(low, high)
    span = high - low + 1
    if span <= PRIME:
        return F.lit(low) + F.pmod(r.draw(stream), F.lit(span))
    wide = r.draw(stream) * F.lit(1 << 31) + r.draw(stream + 1)
    return F.lit(low) + F.pmod(wide, F.lit(span))


def choose(r: RowDraws, values: list[Any], stream: int) -> Column:
    at = F.pmod(r.draw(stream), F.lit(len(values))) + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def digits(r: RowDraws, count: int, stream: int) -> Column:
    parts = []
    for i in range(0, count, 9):
        n = min(9, count - i)
        value = F.pmod(r.draw(stream + i), F.lit(10**n)).cast("string")
        parts.append(F.lpad(value, n, "0"))
    return F.concat(*parts)


def letters(r: RowDraws, length: int, stream: int) -> Column:
    """Up to five capital letters from one draw."""
    value = r.draw(stream)
    codes = [(F.floor(value / F.lit(26**i)).cast("bigint") % 26).cast("int") + 65 for i in range(length)]
    return F.concat(*[F.char(c) for c in codes])


def hash_hex(r: RowDraws, length: int, stream: int) -> Column:
    """Hex digits of hashes of id, column and seed, 64 per hash."""
    blocks = [
        F.sha2(F.concat_ws("/", r.id.cast("string"), F.lit(f"{stream}/{r.seed}/{i}")), 256)
        for i in range(0, length, 64)
    ]
    return F.left(F.concat(*blocks), F.lit(length))


def hash_text(r: RowDraws, length: int, stream: int, last_two: str) -> Column:
    """Letters and digits, 42 per hash; ``last_two`` stand for base64's + and /."""
    blocks = [
        F.left(F.base64(F.unhex(F.sha2(
            F.concat_ws("/", r.id.cast("string"), F.lit(f"{stream}/{r.seed}/{i}")), 256
        ))), F.lit(42))
        for i in range(0, length, 42)
    ]
    return F.translate(F.left(F.concat(*blocks), F.lit(length)), "+/", last_two)


def check_digit(r: RowDraws, body: Column, longest: int, weigh) -> Column:
    """Digit that brings the weighted sum of ``body`` (from the right, first weight
    on the last digit) to a multiple of ten; shorter bodies count as padded."""
    padded = r.keep(F.lpad(body, longest, "0"))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(padded, F.lit(longest) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, weigh(digit)).otherwise(digit)

    places = F.array(*[F.lit(i) for i in range(longest)])
    total = F.aggregate(places, F.lit(0), add)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def luhn_digit(r: RowDraws, body: Column, longest: int) -> Column:
    return check_digit(r, body, longest, lambda d: d * 2 - F.when(d > 4, 9).otherwise(0))


def ean_digit(r: RowDraws, body: Column, longest: int) -> Column:
    return check_digit(r, body, longest, lambda d: d * 3)


def sequence_value(r: RowDraws, p: dict[str, Any]) -> Column:
    """start + id * increment, wrapped or held inside its limits."""
    value = F.lit(p.get("startValue", 1)) + r.id * F.lit(p.get("increment", 1))
    low, high = p.get("sequenceMin"), p.get("sequenceMax")
    if low is not None and high is not None and p.get("sequenceCycle"):
        return F.lit(low) + F.pmod(value - F.lit(low), F.lit(high - low + 1))
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def _moment(text: str | None, fallback: str) -> int:
    return int(dt.datetime.fromisoformat(text or fallback).replace(tzinfo=dt.timezone.utc).timestamp())


def datetime_value(r: RowDraws, p: dict[str, Any], stream: int) -> Column:
    a, b = _moment(p.get("start"), "2020-01-01"), _moment(p.get("end"), "2025-01-01")
    second = int_between(r, a, b, stream)
    at = F.timestamp_add("SECOND", second, F.lit("1970-01-01").cast("timestamp_ntz"))
    if p.get("startHour") is not None or p.get("endHour") is not None:
        hour = int_between(r, p.get("startHour", 0), p.get("endHour", 23), stream + 7)
        rest = int_between(r, 0, 3599, stream + 8)
        at = F.timestamp_add("SECOND", hour * 3600 + rest, F.date_trunc("DAY", at))
    return at


def time_value(r: RowDraws, p: dict[str, Any], stream: int) -> Column:
    h = int_between(r, p.get("startHour", 0), p.get("endHour", 23), stream)
    m, s = int_between(r, 0, 59, stream + 1), int_between(r, 0, 59, stream + 2)
    return F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (h, m, s)])


LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut "
    "labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco "
)
WORDS = {
    "slug": ["amber", "river", "stone", "cloud", "maple", "comet", "ember", "quartz"],
    "tag_list": ["alpha", "beta", "fresh", "rare", "daily", "local", "green", "quick"],
    "level": ["bronze", "silver", "gold", "platinum"],
    "channel": ["radio", "print", "phone", "shop", "post"],
    "language": ["sv-SE", "de-AT", "en-IE", "fr-BE", "pl-PL", "tr-TR", "vi-VN", "cs-CZ"],
    "currency": ["SEK", "PLN", "CZK", "TRY", "VND", "EUR", "USD", "NOK"],
}


def text_value(r: RowDraws, p: dict[str, Any], stream: int) -> Column:
    fmt = p.get("textFormat", "lorem")
    pick = lambda n, part: choose(r, WORDS[n], stream + part)
    if fmt == "bcrypt":
        return F.concat(F.lit("$2a$10$"), hash_text(r, 53, stream, "./"))
    if fmt in ("hex", "alphanumeric"):
        low, high = p.get("minLength", 32), p.get("maxLength", 32)
        size = int_between(r, low, high, stream + 999).cast("int")
        if fmt == "hex":
            return F.left(hash_hex(r, high, stream), size)
        return F.left(hash_text(r, high, stream, "Qz"), size)
    if fmt == "version":
        n = [int_between(r, 0, top, stream + i).cast("string") for i, top in enumerate((3, 20, 99))]
        return F.concat(F.when(unit(r, stream + 3) < 0.3, "v").otherwise(""), F.concat_ws(".", *n))
    if fmt in ("slug", "tag_list"):
        few, many = (2, 4) if fmt == "slug" else (1, 3)
        n = int_between(r, few, many, stream)
        parts = F.array(*[pick(fmt, i + 1) for i in range(many)])
        kept = F.slice(parts, F.lit(1), n.cast("int"))
        return F.array_join(kept, "-") if fmt == "slug" else F.array_join(F.array_distinct(kept), ",")
    if fmt in WORDS:
        return pick(fmt, 0)
    low, high = p.get("minLength", 50), p.get("maxLength", 500)
    size = int_between(r, low, high, stream)
    offset = int_between(r, 1, 60, stream + 1)
    body = LOREM * (high // len(LOREM) + 2)
    return F.substring(F.lit(body), offset.cast("int"), size.cast("int"))


def uuid_value(r: RowDraws, stream: int, hyphens: bool = True) -> Column:
    """Different for every id: a hash of id, column and seed in UUID form."""
    h = F.md5(F.concat_ws("/", r.id.cast("string"), F.lit(str(stream)), F.lit(str(r.seed))))
    if not hyphens:
        return h
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def snowflake_id(row_id: Column, start_ms: int = SNOWFLAKE_START_MS, worker: int = 1) -> Column:
    """64-bit ids of one worker, as if all rows asked at ``start_ms``: milliseconds since
    the epoch of such ids, worker, sequence. A millisecond has 4096 sequence numbers; the
    next row takes the next millisecond. Unique as long as row ids are."""
    if not 0 <= worker < SNOWFLAKE_WORKERS:
        raise ValueError(f"a worker is 0 to {SNOWFLAKE_WORKERS - 1}")
    later = F.floor(row_id / SNOWFLAKE_SEQUENCES).cast("bigint")
    ms = F.lit(max(start_ms, SNOWFLAKE_EPOCH_MS) - SNOWFLAKE_EPOCH_MS).cast("bigint") + later
    return F.shiftleft(ms, 22).bitwiseOR(F.lit(worker << 12)).bitwiseOR(F.pmod(row_id, F.lit(SNOWFLAKE_SEQUENCES)))


PICKS = {
    "gender": ["female", "male", "other"], "title": ["Ms", "Mr", "Mx", "Dr"],
    "marital_status": ["single", "married", "divorced", "widowed"],
    "job_title": ["Engineer", "Analyst", "Manager", "Designer", "Accountant", "Technician"],
    "payment_method": ["card", "transfer", "wallet", "cash"],
    "credit_card_type": ["Visa", "MasterCard", "American Express", "JCB", "UnionPay"],
    "department": ["Sales", "Finance", "Support", "Research", "Operations", "Legal"],
    "industry": ["Energy", "Health", "Retail", "Software", "Transport", "Education"],
    "city": ["Lisbon", "Osaka", "Lima", "Oslo", "Nairobi", "Quito", "Hanoi", "Lyon"],
    "region": ["North", "South", "East", "West", "Central"],
    "product_category": ["Books", "Garden", "Kitchen", "Sports", "Toys", "Audio"],
    "color": ["red", "green", "blue", "black", "white", "amber"],
    "size": ["XS", "S", "M", "L", "XL"], "weight_unit": ["g", "kg", "lb", "oz"],
    "file_extension": ["pdf", "png", "txt", "csv", "docx", "zip"],
}
FIRST = ["Ada", "Bo", "Cleo", "Dara", "Eli", "Finn", "Gia", "Hana", "Ivo", "Jun"]
LAST = ["Abe", "Berg", "Costa", "Diaz", "Endo", "Fox", "Gray", "Holm", "Ito", "Jansen"]
FIRMS = ["Northwind", "Bluepeak", "Ironleaf", "Sunfield", "Clearbrook", "Stonegate"]
FORMS = ["Ltd", "Inc", "GmbH", "Group", "Labs"]
STREETS = ["Oak St", "Lake Rd", "Hill Ave", "Mill Ln", "Park Way"]
GOODS = ["Lamp", "Chair", "Kettle", "Bottle", "Helmet", "Speaker"]
KINDS = ["Classic", "Compact", "Deluxe", "Eco", "Travel"]
# Card number prefixes and lengths by card type.
CARDS = {
    "American Express": (["34", "37"], 15),
    "JCB": (["3528", "3529", "3530", "3531", "3532", "3533", "3534", "3535", "3536", "3537", "3538", "3539"], 16),
    "MasterCard": (
        ["51", "52", "53", "54", "55", "2221", "2222", "2223", "2224", "2225", "2226", "2227", "2228", "2229",
         "23", "24", "25", "26", "270", "271", "2720"], 16,
    ),
    "UnionPay": (["62", "623", "624", "625", "626", "627", "628"], 16),
    "Visa": (["4"], 16),
}


def semantic_value(key: str, r: RowDraws, stream: int) -> Column:
    """Names, contacts, payment, company, place, product, network and file values."""
    pick = lambda values, part=0: choose(r, values, stream + part)
    num = lambda low, high, part=0: int_between(r, low, high, stream + part)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    if key in PICKS:
        return pick(PICKS[key])
    if key == "full_name":
        return text(pick(FIRST), " ", pick(LAST, 1))
    if key == "phone":
        return text("+1-", num(200, 999), "-", digits(r, 7, stream + 1))
    if key in ("email", "social_id"):
        name = text(F.lower(pick(FIRST)), ".", F.lower(pick(LAST, 1)), num(1, 9999, 2))
        return name if key == "social_id" else text(name, "@example.", pick(["com", "org", "net"], 3))
    if key == "id_number":
        return digits(r, 18, stream)
    if key == "credit_card_number":
        at = F.pmod(r.draw(stream), F.lit(len(CARDS)))
        rest = digits(r, 15, stream + 1)
        out = None
        for i, (prefixes, length) in enumerate(CARDS.values()):
            body = F.left(F.concat(choose(r, prefixes, stream + 20), rest), F.lit(length - 1))
            out = F.when(at == i, body) if out is None else out.when(at == i, body)
        return F.concat(out, luhn_digit(r, out, 15))
    if key == "credit_card_date":
        return text(F.lpad(num(1, 12).cast("string"), 2, "0"), "/", F.lpad(num(25, 39, 1).cast("string"), 2, "0"))
    if key == "company_name":
        return text(pick(FIRMS), " ", pick(FORMS, 1))
    if key == "address":
        return text(num(1, 999), " ", pick(STREETS, 1), ", ", pick(PICKS["city"], 2))
    if key == "product_name":
        return text(pick(KINDS), " ", pick(GOODS, 1))
    if key == "barcode":
        body = digits(r, 12, stream)
        return F.concat(body, ean_digit(r, body, 12))
    if key == "sku":
        return text(letters(r, 3, stream), "-", digits(r, 6, stream + 9))
    if key == "ip_address":
        return F.concat_ws(".", *[num(1 if i in (0, 3) else 0, 254, i).cast("string") for i in range(4)])
    if key == "mac_address":
        return F.concat_ws(":", *[F.lower(F.lpad(F.hex(num(0, 255, i)), 2, "0")) for i in range(6)])
    if key in ("file_name", "file_path"):
        name = text(F.lower(pick(GOODS)), "_", num(1, 9999, 1), ".", pick(PICKS["file_extension"], 2))
        return name if key == "file_name" else text("/data/", pick(["in", "out", "tmp"], 3), "/", name)
    if key in ("hostname", "url"):
        host = text(F.lower(pick(FIRMS)), "-", num(1, 99, 1), ".example.com")
        return host if key == "hostname" else text("https://", host, "/", F.lower(pick(GOODS, 2)))
    if key == "image":
        return text("0x", hash_hex(r, 32, stream))
    raise ValueError(f"unknown generator {key}")


# Column-name patterns and their generator, tried in order.
NAME_PATTERNS = [
    (r"email|e-?mail|mail", "email"),
    (r"phone|tel|mobile|cell|fax|telephone", "phone"),
    (r"id.?card|idcard|身份证|id.?number|证件号|证件|passport|护照|social.?credit|统一社会|信用代码", "id_number"),
    (r"bank.?card|银行卡|bank.?account", "id_number"),
    (r"driver.?license|drivers?|驾驶证|驾照", "id_number"),
    (r"first.?name|fname|given.?name", "full_name"),
    (r"last.?name|lname|surname|family.?name", "full_name"),
    (r"full.?name|name|user.?name|username|nickname|nick.?name", "full_name"),
    (r"gender|sex", "gender"),
    (r"city|town|municipality", "city"),
    (r"country|province|state|region", "city"),
    (r"zip|postal.?code|postcode", "number"),
    (r"address|street|district|county", "address"),
    (r"url|website|link|homepage|href|weburl", "url"),
    (r"ip$", "ip_address"),
    (r"ip.?address|ipv4|ipv6", "ip_address"),
    (r"mac.?address|mac$", "mac_address"),
    (r"uuid|guid", "uuid"),
    (r"company|corp|organization|org|brand", "company_name"),
    (r"department|dept|division", "department"),
    (r"color|colour", "color"),
    (r"title|position|job.?title|role", "job_title"),
    (r"description|comment|note|summary|bio|content|body|detail|remark|memo|intro|introduction|overview", "text"),
    (r"status|state", "enum"),
    (r"barcode|upc|ean|qr.?code", "barcode"),
    (r"sku", "sku"),
    (r"product.?name|product$", "product_name"),
    (r"category|type|kind|classification", "product_category"),
    (r"size$", "size"),
    (r"weight|weight.?unit|unit.?weight|weight.?type", "weight_unit"),
    (r"file.?path|filePath|directory|dir$", "file_path"),
    (r"file.?name|filename|original.?name|file.?original.?name", "file_name"),
    (r"file.?extension|ext$|filetype|file.?type", "file_extension"),
    (r"hostname|host$", "hostname"),
    (r"version|ver$", "text"),
    (r"language|locale$", "text"),
    (r"currency|currency.?code|currency.?name", "text"),
    (r"slug|permalink|alias|url.?slug|key$", "text"),
    (r"tag|keyword|labels|tags$", "text"),
    (r"level|tier|stage|phase|channel|source|platform", "text"),
    (r"owner|creator|author|created_by|updated_by|modified_by|operator|user$", "full_name"),
]
FLAG_NAME = r"(is|has|had|can|did|enable|disable|allow|use|visible|deleted|active|flag)[_-]?"
NUMBER_TYPES = r"int|bool|decimal|numeric|float|double|^real$"


def guess_generator(name: str, data_type: str, auto_increment: bool = False) -> str:
    """Generator for a column: typed columns by their type, others by their name."""
    kind = data_type.lower()
    number = re.search(NUMBER_TYPES, kind)
    time = re.search(r"date|timestamp|^time$", kind)
    raw = re.search(r"binary|blob|bytea", kind)
    if auto_increment:
        return "sequence"
    if number or time or raw:
        flag = number and re.match(FLAG_NAME, name, re.I)
        if "serial" in kind:
            return "sequence"
        if flag or kind in ("bool", "boolean", "bit", "tinyint(1)") or re.search("status|state", name, re.I):
            return "enum"
        if number:
            return "number"
        return "text" if raw else "time" if kind == "time" else "datetime"
    named = next((key for pattern, key in NAME_PATTERNS if re.search(pattern, name, re.I)), None)
    if named:
        return named
    texts = re.search(r"char|text|clob", kind)
    return "uuid" if not texts and re.search("uuid|guid", kind) else "text"


def generated(spec: dict[str, Any], r: RowDraws) -> Column:
    """One column from its spec ``{name, type, generator, params, default}``. NULL by
    ``nullPercent`` comes first, then the default by ``defaultPercent``."""
    name, kind = spec["name"], spec.get("type", "string")
    p = spec.get("params") or {}
    key = spec.get("generator") or guess_generator(name, kind, spec.get("auto_increment", False))
    stream = stream_number(name)
    if key == "number":
        low, high = p.get("min", 1), p.get("max", 1000)
        if p.get("numberType") == "decimal":
            value = F.round(F.lit(low) + unit(r, stream) * F.lit(high - low), p.get("decimalPlaces", 2))
        else:
            value = int_between(r, low, high, stream)
    elif key == "sequence":
        value = sequence_value(r, p)
    elif key == "datetime":
        value = datetime_value(r, p, stream)
    elif key == "date":
        value = datetime_value(r, p, stream).cast("date")
    elif key == "time":
        value = time_value(r, p, stream)
    elif key == "enum":
        values = p.get("values") or (["true", "false"] if "bool" in kind else ["A", "B", "C", "D", "E"])
        value = choose(r, values, stream)
    elif key == "text":
        value = text_value(r, p, stream)
    elif key == "uuid":
        value = uuid_value(r, stream, p.get("uuidHyphens", True))
    elif key == "foreign_key":
        value = int_between(r, p.get("min", 1), p.get("max", 500), stream)
    elif key == "snowflake":
        value = snowflake_id(r.id, int(p.get("startMs", SNOWFLAKE_START_MS)), int(p.get("workerId", 1)))
    else:
        value = semantic_value(key, r, stream)
    if "type" in spec:
        value = value.cast(kind)
    default, share = spec.get("default"), p.get("defaultPercent", 100)
    if default is not None and p.get("includeDefault", True) and share > 0:
        use = unit(r, stream_number(name, 1)) * 100 < share
        value = F.when(use, F.lit(default).cast(kind) if "type" in spec else F.lit(default)).otherwise(value)
    if p.get("includeNull") and p.get("nullPercent"):
        value = F.when(unit(r, stream_number(name, 2)) * 100 >= p["nullPercent"], value)
    return value.alias(name)


def generate_columns(ids: DataFrame, id_column: str, specs: list[dict[str, Any]], seed: int = 0) -> DataFrame:
    r = RowDraws(F.col(id_column).cast("bigint"), seed)
    columns = [generated(s, r) for s in specs]
    return r.apply(ids.select(id_column)).select(id_column, *columns)


def generate_rows(
    spark: SparkSession, n: int, specs: list[dict[str, Any]], seed: int = 0, partitions: int | None = None
) -> DataFrame:
    """``n`` rows with ids 0 to n-1."""
    return generate_columns(spark.range(0, n, 1, partitions), "id", specs, seed)


def with_foreign_key(
    df: DataFrame, id_column: str, name: str, parent: DataFrame, parent_key: str, seed: int = 0
) -> DataFrame:
    """Add a foreign key whose values exist: each row draws a place in the parent's
    key order and joins on it, so no parent key is favoured and nothing is
    collected."""
    numbered = with_running_index(parent.select(F.col(parent_key).alias(name)), [name], "_at")
    total = parent.count()
    r = RowDraws(F.col(id_column).cast("bigint"), seed)
    place = int_between(r, 0, max(total - 1, 0), stream_number(name))
    wanted = r.apply(df).select(*df.columns, place.alias("_want"))
    # An empty parent leaves the rows, without a value.
    return wanted.join(numbered, F.col("_want") == F.col("_at"), "left").drop("_want", "_at")
