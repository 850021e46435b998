"""Time parts, bounded-format parsing, strftime-like output, elapsed time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PARSE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy.MM.dd-HH:mm:ss",
    "yyyy.MM.dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy.MM.dd",
    "yyyy/MM/dd",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "MMM d HH:mm:ss Z yyyy",
    "MMM d yyyy HH:mm:ss",
    "MMM d yyyy",
)

# strftime letter -> date_format pattern
_STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy",
    "j": "DDD", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh",
}


def time_parts(ts: Column) -> dict[str, Column]:
    """sec min hour mday mon (from 0) year wday (Sunday 0) yday (from 0) isdst ns."""
    offset = F.unix_timestamp(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    january = F.date_trunc("year", ts)
    return {
        "sec": F.second(ts),
        "min": F.minute(ts),
        "hour": F.hour(ts),
        "mday": F.dayofmonth(ts),
        "mon": F.month(ts) - 1,
        "year": F.year(ts),
        "wday": F.dayofweek(ts) - 1,
        "yday": F.dayofyear(ts) - 1,
        "isdst": _is_dst(ts, january, offset),
        "ns": (F.pmod(F.unix_micros(ts), F.lit(1_000_000)) * 1000).cast("bigint"),
    }


def _is_dst(ts: Column, january: Column, offset: Column) -> Column:
    # daylight time: the zone's offset differs from its offset in January
    zone = F.current_timezone()

    def shift(t: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(t)

    return (shift(ts) > shift(january)).cast("int")


def time_parse(text: Column, formats: Sequence[str] = PARSE_FORMATS) -> Column:
    """The first format that fits; NULL when none does. A leading weekday is skipped."""
    text = F.regexp_replace(text, "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def time_format(ts: Column, fmt: str) -> Column:
    """``%Y-%m-%d %H:%M:%S`` style output."""
    pieces: list[Column] = []
    i = 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            pieces.append(_format_one(ts, fmt[i + 1]))
            i += 2
        else:
            j = fmt.find("%", i)
            j = len(fmt) if j < 0 else j
            pieces.append(F.lit(fmt[i:j] or "%"))
            i = max(j, i + 1)
    return F.concat(*pieces)


def _format_one(ts: Column, letter: str) -> Column:
    if letter == "%":
        return F.lit("%")
    if letter in ("s", "#"):
        return F.unix_timestamp(ts).cast("string")
    if letter == "a":
        return F.date_format(ts, "EEE")
    return F.date_format(ts, _STRFTIME[letter])


def elapsed_format(ms: Column) -> Column:
    """Milliseconds to ``1d02h03m04.005s`` (leading zero units are left out)."""
    ms = ms.cast("bigint")
    day, hour, minute = (F.floor(ms / u) for u in (86_400_000, 3_600_000, 60_000))
    sec = F.format_string("%02d.%03ds", F.floor(ms / 1000) % 60, ms % 1000)
    return F.concat(
        F.when(day > 0, F.concat(day.cast("string"), F.lit("d"))).otherwise(F.lit("")),
        F.when(hour > 0, F.format_string("%02dh", hour % 24)).otherwise(F.lit("")),
        F.when(minute > 0, F.format_string("%02dm", minute % 60)).otherwise(F.lit("")),
        sec,
    )


def elapsed_parse(text: Column) -> Column:
    """The inverse of ``elapsed_format``; units may be left out."""
    total = F.lit(0).cast("decimal(20,3)")
    for unit, ms in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000)):
        part = F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?){unit}", 1)
        total = total + F.coalesce(F.nullif(part, F.lit("")).cast("decimal(14,3)"), F.lit(0)) * ms
    return total.cast("bigint")
