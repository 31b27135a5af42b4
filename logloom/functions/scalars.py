"""Scalar helpers as column expressions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]

_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(?!$)|$)){4}$"
_IPV6 = (
    r"^(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=.*::)(?!.*::.*::)(?!.*:::)(([0-9A-Fa-f]{1,4})?:){2,7}([0-9A-Fa-f]{1,4})?)$"
)
# an IPv4 address in the last 32 bits
_MAPPED = (
    r"^(([0-9A-Fa-f]{1,4}:){6}|(?=.*::)(?!.*::.*::)(?!.*:::)(([0-9A-Fa-f]{1,4})?:){2,6})"
    + _IPV4[1:]
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c: Column, scale: int = 2) -> Column:
    """Round half up; through decimal so that ties do not depend on binary noise."""
    return F.round(c.cast("decimal(38,10)"), scale).cast("double")


def iso_utc(c: Column | str) -> Column:
    """Timestamp to ISO-8601 text with milliseconds and ``Z``."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def chart_label(c: Column | str) -> Column:
    """Axis label such as ``Jan 5, 02 PM``."""
    return F.date_format(col(c), "MMM d, hh a")


_ISO = (
    r"^\d{4}(-\d{2}(-\d{2}(T(\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?)?"
    r"(Z|[+-]\d{2}(:?\d{2})?)?)?)?)?$"
)


def parse_timestamp(c: Column | str) -> Column:
    """ISO-8601 text, else epoch milliseconds; null when it is neither."""
    s = col(c)
    iso = F.regexp_replace(s, r"T(Z|[+-]|$)", "T00:00$1")
    iso = F.regexp_replace(iso, r"T(\d{2})(Z|[+-]|$)", "T$1:00$2")
    iso = F.regexp_replace(iso, ",", ".")
    millis = F.timestamp_millis(s.try_cast("bigint"))
    return F.when(s.rlike(_ISO), F.coalesce(iso.try_cast("timestamp"), millis)).otherwise(
        millis
    )


def format_bytes(c: Column | str) -> Column:
    """``1536`` to ``1.50 KB``; base 1024, two decimals, ``0 B`` for zero."""
    b = col(c).cast("double")
    # Integer comparisons instead of a logarithm: exact at the powers of 1024.
    power = F.lit(0)
    for i in range(1, len(BYTE_UNITS)):
        power = F.when(b >= float(1024**i), F.lit(i)).otherwise(power)
    scaled = (b / F.pow(F.lit(1024.0), power)).cast("decimal(38,2)")
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), power + 1)
    return F.when(b == 0, F.lit("0 B")).otherwise(
        F.concat_ws(" ", scaled.cast("string"), unit)
    )


def valid_ip(c: Column | str) -> Column:
    return col(c).rlike(_IPV4) | col(c).rlike(_IPV6) | col(c).rlike(_MAPPED)


def valid_geo_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


#: Fixed value: the digits of a geohash, in order.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
_BASE_32 = "0123456789abcdefghijklmnopqrstuv"
_CELL_DIGITS = 12
_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_WKT_POINT = rf"(?i)^\s*point\s*(?:z\s*)?\(\s*{_NUMBER}\s+{_NUMBER}(?:\s+{_NUMBER})?\s*\)\s*$"


def geohash_corner(c: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude of the south-western corner of a geohash cell.

    Null for anything that is no geohash. The bits of the digits belong to
    longitude and latitude in turn. Digits behind the twelfth name less than four
    centimetres and change nothing.
    """
    text = F.when(col(c).rlike(f"^[{GEOHASH_DIGITS}]+$"), col(c))
    digits = F.translate(F.rpad(F.substring(text, 1, _CELL_DIGITS), _CELL_DIGITS, "0"), GEOHASH_DIGITS, _BASE_32)
    bits = F.lpad(F.conv(digits, 32, 2), 5 * _CELL_DIGITS, "0")
    steps = float(2 ** (5 * _CELL_DIGITS // 2))
    east = F.conv(F.regexp_replace(bits, "(.).", "$1"), 2, 10).cast("double")
    north = F.conv(F.regexp_replace(bits, ".(.)", "$1"), 2, 10).cast("double")
    return north * 180.0 / steps - 90.0, east * 360.0 / steps - 180.0


def wkt_point(c: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude of ``POINT (lon lat)``, with or without a height; else null."""
    lon, lat = (F.regexp_extract(col(c), _WKT_POINT, i).try_cast("double") for i in (1, 2))
    return lat, lon


def keyword(c: Column | str, ignore_above: int = 256) -> Column:
    """The exact-value form of a text field; longer values have none."""
    return F.when(F.length(col(c)) <= ignore_above, col(c))


def table_name(*parts: Column | str) -> Column:
    """``prefix-suffix-date`` with every other character turned into ``-``."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.regexp_replace(F.concat_ws("-", *cols), "[^a-zA-Z0-9_-]", "-")


def choose(values: list[str], index: Column) -> Column:
    """The list value at a zero-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


# -- arguments given by the caller (driver side) ------------------------------

_DURATION = {
    "ms": 1,
    "s": 1000,
    "m": 60_000,
    "h": 3_600_000,
    "d": 86_400_000,
    "w": 604_800_000,
}


def interval_millis(text: str) -> int:
    """``500ms``, ``30s``, ``5m``, ``2h``, ``1d`` or ``1w`` in milliseconds."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d|w)", text.strip())
    if not m or int(m.group(1)) == 0:
        raise ValueError(f"not a fixed interval: {text!r}")
    return int(m.group(1)) * _DURATION[m.group(2)]


_BOUND = re.compile(
    r"(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2})?(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?)?)?)?"
)


def date_bounds(value: str | int | datetime) -> tuple[datetime, datetime]:
    """The instant a date argument names, and the first instant after it.

    A value covers everything up to its last given component, so an upper bound
    ``2024-01-05`` includes the whole day. Milliseconds are the finest unit.
    """
    if isinstance(value, datetime):
        base = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        base = base.replace(microsecond=base.microsecond // 1000 * 1000)
        return base, base + timedelta(milliseconds=1)
    text = str(value)
    m = _BOUND.fullmatch(text)
    if not m:
        if re.fullmatch(r"-?\d+", text):
            base = datetime.fromtimestamp(0, timezone.utc) + timedelta(
                milliseconds=int(text)
            )
            return base, base + timedelta(milliseconds=1)
        raise ValueError(f"not a date: {value!r}")
    year, month, day, hour, minute, second, fraction, zone = m.groups()
    zone_info = timezone.utc
    if zone and zone != "Z":
        digits = zone[1:].replace(":", "")
        offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:] or 0))
        zone_info = timezone(offset if zone[0] == "+" else -offset)
    millis = int((fraction or "0").ljust(3, "0")[:3])
    base = datetime(
        int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0),
        int(second or 0), millis * 1000, zone_info,
    ).astimezone(timezone.utc)
    if fraction:
        step = timedelta(milliseconds=1)
    elif second:
        step = timedelta(seconds=1)
    elif minute:
        step = timedelta(minutes=1)
    elif hour:
        step = timedelta(hours=1)
    else:
        step = timedelta(days=1)
    return base, base + step
