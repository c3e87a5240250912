"""Reading and writing dates and times held as text.

Text is sorted into classes by shape and then cast once; casts of text that
matches no class are never tried, so bad cells cost one regex.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONED = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DATETIME = r"^\d{4}([-/])\d{1,2}\1\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"
DATE = r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"
TIME = r"^\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"

# Pattern letters of the formatter dialog and Spark's letters.
LETTERS = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "HH": "HH", "H": "H",
    "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS", "A": "a",
    "Z": "xxx",
}
# Letters of export patterns, longest first, and Spark's letters.
EXPORT_LETTERS = {
    "YYYY": "yyyy", "SSS": "SSS", "ZZ": "", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss",
    "M": "M", "D": "d", "H": "H", "m": "m", "s": "s", "Z": "",
}
DEFAULT_PATTERN = "YYYY-MM-DD HH:mm:ss"


def spark_pattern(pattern: str) -> str:
    """A day.js style pattern in Spark's letters; ``[text]`` is literal."""
    parts = re.findall(r"\[[^\]]*\]|YYYY|YY|MM?|DD?|HH?|hh?|mm?|SSS|ss?|A|Z|[A-Za-z]+|[^A-Za-z\[]+", pattern)
    out = []
    for p in parts:
        if p.startswith("["):
            out.append("'" + p[1:-1].replace("'", "''") + "'")
        elif p in LETTERS:
            out.append(LETTERS[p])
        elif p.isalpha():
            out.append(f"'{p}'")
        else:
            out.append(p)
    return "".join(out)


def local_time(text: Column) -> Column:
    """Wall-clock time of a dated text, NULL for other text; zones are cut off."""
    dated = text.rlike(ZONED) | text.rlike(DATETIME) | text.rlike(DATE)
    bare = F.regexp_replace(F.regexp_replace(text, "/", "-"), r"([Zz]|[+-]\d{2}:\d{2})$", "")
    # A plain date ends in "-dd", which the zone pattern cannot match without a colon.
    return F.when(dated, F.upper(bare).try_cast("timestamp_ntz"))


def clock_parts(at: Column) -> tuple[Column, Column, Column]:
    """Day, time and fraction text of a wall-clock time. The cast to text knows no
    zone, while patterns go through the session's. The fraction is nothing,
    ``.mmm`` or ``.uuuuuu``: as many digits as the value needs."""
    text = at.cast("string")
    digits = F.rpad(F.substring(text, 21, 6), 6, "0")
    short = F.substring(digits, 4, 3) == "000"
    rest = (
        F.when(digits == "000000", "")
        .when(short, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.substring(text, 1, 10), F.substring(text, 12, 8), rest


def is_timestamp(text: Column) -> Column:
    return (text.rlike(ZONED) | text.rlike(DATETIME)) & local_time(text).isNotNull()


def is_date(text: Column) -> Column:
    return text.rlike(DATE) & local_time(text).isNotNull()


def normalize(value: Column, kind: str, pattern: str | None = None) -> Column:
    """Text as ``kind`` (date, time, datetime, datetimetz) writes it; text that
    cannot be read that way is unchanged."""
    raw = F.trim(value)
    at, zoned = local_time(raw), raw.rlike(ZONED)
    dateless = raw.rlike(TIME)
    clock = F.concat(F.lit("1970-01-01 "), raw).try_cast("timestamp_ntz")
    plain_date = raw.rlike(DATE)
    if pattern and pattern.strip():
        first = F.try_to_timestamp(raw, F.lit(spark_pattern(pattern))).cast("timestamp_ntz")
        has_clock = any(x in pattern for x in ("H", "h"))
        at = F.coalesce(first, at)
        plain_date = F.when(first.isNotNull(), F.lit(not has_clock)).otherwise(plain_date)
        zoned = F.when(first.isNotNull(), F.lit("Z" in pattern)).otherwise(zoned)
    day, hms, rest = clock_parts(at)
    if kind == "date":
        out = day
    elif kind == "time":
        _, time, tail = clock_parts(F.when(dateless, clock).when(~plain_date, at))
        out = F.concat(time, tail)
    else:
        full = F.concat(day, F.lit(" "), hms, rest)
        out = F.when(plain_date, F.concat(day, F.lit(" 00:00:00"))).otherwise(full)
        if kind == "datetimetz":
            offset = F.regexp_extract(raw, r"([Zz]|[+-]\d{2}:\d{2})$", 1)
            offset = F.when(F.upper(offset) == "Z", "+00:00").otherwise(offset)
            out = F.when(zoned, F.concat(day, F.lit("T"), hms, rest, offset)).otherwise(out)
    return F.coalesce(out, value)


def export_parts(pattern: str) -> list[tuple[str, str]] | None:
    """An export pattern as (kind, text) parts: ``date``, ``time``, ``zone`` letters and
    ``text``. None if it is blank, longer than 100, has a percent sign, an open
    bracket or letters that exports do not know."""
    pattern = pattern.strip()
    if not pattern or len(pattern) > 100 or "%" in pattern:
        return None
    parts: list[tuple[str, str]] = []
    while pattern:
        if pattern[0] == "[":
            body, closed, pattern = pattern[1:].partition("]")
            if not closed:
                return None
            parts.append(("text", body))
            continue
        letters = next((x for x in EXPORT_LETTERS if pattern.startswith(x)), None)
        if letters is None and pattern[0].isascii() and pattern[0].isalpha():
            return None
        kind = "text" if letters is None else "zone" if letters[0] == "Z" else "date" if letters[0] in "YMD" else "time"
        parts.append((kind, letters or pattern[0]))
        pattern = pattern[len(parts[-1][1]) :]
    return parts


def format_text(value: Column, pattern: str) -> Column:
    """Text of a known date or time shape in the user's pattern. Text of other shapes,
    and of shapes that lack what the pattern shows (a date has no clock, a time no
    date, only a zoned text a zone), is unchanged; so is all text if the pattern has
    unknown letters."""
    parts = export_parts(pattern)
    if parts is None:
        return value
    kinds = {k for k, _ in parts}
    zoned, clock = value.rlike(ZONED), value.rlike(TIME)
    at = F.when(clock, F.concat(F.lit("1970-01-01 "), value).try_cast("timestamp_ntz")).otherwise(local_time(value))
    fits = F.lit("zone" not in kinds) | zoned
    if "time" in kinds:
        fits = fits & ~value.rlike(DATE)
    if "date" in kinds:
        fits = fits & ~clock
    offset = F.regexp_extract(value, r"([Zz]|[+-]\d{2}:\d{2})$", 1)
    offset = F.when(F.upper(offset) == "Z", "+00:00").otherwise(offset)
    shown = {"Z": offset, "ZZ": F.replace(offset, F.lit(":"), F.lit(""))}
    out = [
        F.lit(x) if k == "text" else shown[x] if k == "zone" else F.date_format(at, EXPORT_LETTERS[x])
        for k, x in parts
    ]
    return F.when(at.isNotNull() & fits, F.concat(*out)).otherwise(value)


def epoch_format(
    value: Column, unit: str = "auto", pattern: str = DEFAULT_PATTERN, zone: str = "UTC"
) -> Column:
    """Epoch numbers or dated text in a zone and pattern.

    ``auto`` takes 10 digits as seconds and 13 as milliseconds, if the year is
    1970 to 2100. Anything unreadable is unchanged; NULL shows as ``NULL``.
    """
    text = F.trim(value.cast("string"))
    whole = text.rlike(r"^-?\d+$")
    number = F.when(whole, text.try_cast("bigint"))
    digits = F.length(F.regexp_replace(text, "^-", ""))
    if unit == "seconds":
        millis = number * 1000
    elif unit == "milliseconds":
        millis = number
    else:
        guess = F.when(F.abs(number) < 100_000_000_000, number * 1000).otherwise(number)
        low, high = 0, 4_133_980_800_000  # 1970-01-01 to 2101-01-01
        millis = F.when(digits.isin(10, 13) & (guess >= low) & (guess < high), guess)
    # Wall-clock times throughout, so the session's own zone plays no part.
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    epoch = F.timestamp_add("MILLISECOND", millis, start)
    local, zoned = local_time(text), text.rlike(ZONED)
    sign = F.when(text.rlike(r"-\d{2}:\d{2}$"), -1).otherwise(1)
    part = lambda i: F.regexp_extract(text, r"[+-](\d{2}):(\d{2})$", i).try_cast("int")
    offset = F.coalesce(sign * (part(1) * 60 + part(2)), F.lit(0))
    utc = F.coalesce(epoch, F.when(zoned, F.timestamp_add("MINUTE", -offset, local)))
    shifted = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    at = F.coalesce(shifted, F.when(~whole, local))
    shown = F.date_format(at, spark_pattern(pattern if pattern.strip() else DEFAULT_PATTERN))
    return F.coalesce(shown, value.cast("string"), F.lit("NULL"))
