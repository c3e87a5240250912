"""Column formatters and text matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(value: Column, path: str) -> Column:
    """``$.a[0].b`` of JSON text: missing gives '', JSON null gives ``NULL``, nested
    values give JSON, text that is no JSON is unchanged."""
    doc = F.try_parse_json(value)
    found = F.try_variant_get(doc, path, "variant")
    nested = F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)")
    shown = (
        F.when(found.isNull(), "")
        .when(F.is_variant_null(found), "NULL")
        .when(nested, F.to_json(found))
        .otherwise(F.try_variant_get(doc, path, "string"))
    )
    return F.when(value.isNull(), "NULL").when(doc.isNull(), value).otherwise(shown)


def mask(value: Column, prefix: int = 0, suffix: int = 0) -> Column:
    """Keep ``prefix`` and ``suffix`` characters, star the middle; short text is all stars."""
    text = value.cast("string")
    n, shown = F.char_length(text), prefix + suffix
    tail = F.right(text, F.lit(suffix)) if suffix else F.lit("")
    hidden = F.concat(
        F.left(text, F.lit(prefix)) if prefix else F.lit(""),
        F.repeat(F.lit("*"), n - shown), tail,
    )
    return F.when(value.isNull(), "NULL").when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(hidden)


def template(value: Column, text: str) -> Column:
    """Fill ``${value}``, ``${upper}``, ``${lower}`` and ``${length}`` into ``text``."""
    shown = F.coalesce(value.cast("string"), F.lit("NULL"))
    parts = {
        "value": shown, "upper": F.upper(shown), "lower": F.lower(shown),
        "length": F.char_length(shown).cast("string"),
    }
    pieces = re.split(r"(\$\{(?:value|upper|lower|length)\})", text)
    return F.concat(*[parts[p[2:-1]] if p.startswith("${") and p[2:-1] in parts else F.lit(p) for p in pieces])


def like_escape(text: str, mark: str = "\\") -> str:
    return "".join(mark + ch if ch in (mark, "%", "_") else ch for ch in text)


def fuzzy_match(value: Column, wanted: str) -> Column:
    """Contains ``wanted`` ignoring case, or, from two letters on, has its letters in order."""
    wanted = wanted.strip().lower()
    if not wanted:
        return F.lit(True)
    text = F.lower(value)
    found = text.contains(wanted)
    if len(wanted) < 2:
        return found
    return found | text.like("%" + "%".join(like_escape(ch) for ch in wanted) + "%")


def text_matches(value: Column, wanted: str) -> Column:
    """All non-overlapping matches ignoring case, as ``array<struct<start, end>>``."""
    pieces = F.split(F.lower(value), re.escape(wanted.lower()), -1)
    size = len(wanted)
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")
    )

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.char_length(piece)
        one = F.array(F.struct(start.alias("start"), (start + size).alias("end")))
        return F.struct((start + size).alias("at"), F.concat(acc["found"], one).alias("found"))

    all_pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.aggregate(all_pieces, zero, step, lambda acc: acc["found"])


EARTH_RADIUS_M = 6_378_100.0


def distance_m(lon: Column, lat: Column, to_lon: float, to_lat: float) -> Column:
    """Great-circle distance in metres."""
    d_lat = F.radians(lat - to_lat) / 2
    d_lon = F.radians(lon - to_lon) / 2
    a = F.pow(F.sin(d_lat), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * F.pow(F.sin(d_lon), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def geo_near(
    df, lon: str, lat: str, near: tuple[float, float], name: str = "distance",
    max_distance: float | None = None, min_distance: float | None = None,
):
    """Rows with their distance to a point, within the given limits. A bounding
    box goes first so that a scan can skip by latitude."""
    if max_distance is not None:
        reach = max_distance / EARTH_RADIUS_M * 57.29577951308232 + 1e-9
        df = df.where(F.col(lat).between(near[1] - reach, near[1] + reach))
    out = df.withColumn(name, distance_m(F.col(lon), F.col(lat), *near))
    if max_distance is not None:
        out = out.where(F.col(name) <= max_distance)
    return out if min_distance is None else out.where(F.col(name) >= min_distance)
