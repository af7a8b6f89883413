"""Scalar functions of the query surface, as Column builders or plan-time Python."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds in each unit.
UNIT_NS = {
    "ns": 1, "u": 1_000, "us": 1_000, "µ": 1_000, "ms": 1_000_000,
    "s": 10**9, "sec": 10**9, "second": 10**9, "seconds": 10**9,
    "m": 60 * 10**9, "min": 60 * 10**9, "minute": 60 * 10**9, "minutes": 60 * 10**9,
    "h": 3600 * 10**9, "hr": 3600 * 10**9, "hour": 3600 * 10**9, "hours": 3600 * 10**9,
    "d": 86400 * 10**9, "day": 86400 * 10**9, "days": 86400 * 10**9,
    "w": 604800 * 10**9, "wk": 604800 * 10**9, "week": 604800 * 10**9, "weeks": 604800 * 10**9,
}
# Log severities by number.
SEVERITY = {1: "TRACE", 2: "DEBUG", 3: "INFO", 4: "WARN", 5: "ERROR", 6: "FATAL"}
_DURATION = re.compile(r"=?\s*(\d*)\s*([a-zµ]*)", re.I)


def duration_ns(text: str) -> int:
    """``5m``, ``= 7d``, ``3600``: a bare number is seconds, a bare unit counts as none of it."""
    m = _DURATION.fullmatch(text.strip())
    unit = (m[2] or "s").lower() if m else ""
    if not m or unit not in UNIT_NS:
        raise ValueError(f"bad duration: {text!r}")
    return int(m[1] or 0) * UNIT_NS[unit]


def duration_seconds(text: str) -> int:
    return duration_ns(text) // 10**9


def to_precision(time_ns: Column, unit: str) -> Column:
    """Output precision: nanoseconds divided down, toward zero."""
    return div(time_ns, UNIT_NS[unit])


def div(value: Column, by: int) -> Column:
    """Integer division that truncates toward zero, as SQL ``div``."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def from_precision(value: Column, unit: str) -> Column:
    """Input precision: multiplied up to nanoseconds."""
    return value * F.lit(UNIT_NS[unit])


def time_bucket(time_ns: Column, interval_ns: int) -> Column:
    """Start of the interval, truncated toward zero; an interval of zero or less leaves the time as it is."""
    return div(time_ns, interval_ns) * F.lit(interval_ns) if interval_ns > 0 else time_ns


def series_key(tags: Column) -> Column:
    """``k=v`` pairs sorted by key, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def series_key_of(measurement: str, tags: dict[str, str]) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(tags.items()))


def series_id(key: Column) -> Column:
    return F.xxhash64(key)


def severity_text(number: Column) -> Column:
    out = F.lit("UNKNOWN")
    for n, name in SEVERITY.items():
        out = F.when(number == n, name).otherwise(out)
    return out


def hex_lower(b: Column) -> Column:
    return F.lower(F.hex(b))


def crc32_hex(b: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(b))), 8, "0")


def unescape(s: Column) -> Column:
    r"""``\n \r \t \\ \" \'`` and escaped blanks inside a quoted string; a backslash pair is taken first."""
    mark = "\u0001"
    out = F.replace(s, F.lit("\\\\"), F.lit(mark))
    for escaped, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"), ("\\ ", " ")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def url_decode(text: str) -> str:
    return urllib.parse.unquote_plus(text)


def url_encode(text: str) -> str:
    return urllib.parse.quote(text, safe="")


def shard_id(time_ns: Column, duration_ns: int) -> Column:
    """The shard that holds a time: [id * duration, (id + 1) * duration), also before the epoch."""
    return div(time_ns - F.pmod(time_ns, F.lit(duration_ns)), duration_ns)


def shard_node(shard: Column, nodes: int) -> Column:
    return F.pmod(shard, F.lit(nodes))


def field_text(value) -> str:
    """A value as the HTTP answers show it: whole floats without a fraction, no exponent."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[str(value)]
        return format(value, "f").rstrip("0").rstrip(".") if abs(value) >= 1e16 or (value and abs(value) < 1e-4) else repr(value).removesuffix(".0")
    return value.decode(errors="replace") if isinstance(value, (bytes, bytearray)) else str(value)


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
