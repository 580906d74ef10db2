"""Time helpers that keep zone-less timestamps zone-less."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"minute", "hour", "day", "week", "month", "quarter", "year"}
_ALIASES = {"1 minute": "minute", "1 hour": "hour", "hourly": "hour", "1 day": "day",
            "daily": "day", "1 week": "week", "7 days": "week", "weekly": "week",
            "1 month": "month", "monthly": "month"}


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trunc_ntz(unit: str, c) -> Column:
    """``date_trunc`` that returns ``timestamp_ntz`` for ntz input."""
    return F.date_trunc(unit, col_(c)).cast("timestamp_ntz")


def time_bucket(width: str, c) -> Column:
    """Fixed-width bucket start, like a ``time_bucket`` in SQL engines.

    Weeks start on Monday (matching time-series databases' default origin).
    Widths of N days other than 1 and 7 are aligned to 2000-01-03 (a Monday).
    """
    w = _ALIASES.get(width.strip().lower(), width.strip().lower())
    if w in _UNITS:
        return trunc_ntz(w, c)
    n, unit = w.split()
    n = int(n)
    if unit.startswith("day"):
        origin = F.to_date(F.lit("2000-01-03"))
        d = F.to_date(col_(c))
        k = F.floor(F.datediff(d, origin) / n) * n
        return F.date_add(origin, k.cast("int")).cast("timestamp_ntz")
    if unit.startswith("hour") or unit.startswith("minute"):
        w = (3600 if unit.startswith("hour") else 60) * n * 1_000_000
        start = F.floor(epoch_micros(c) / w) * w
        return F.timestamp_add("MICROSECOND", start, F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))
    raise ValueError(f"unsupported bucket width {width!r}")


def bucket_step(width: str) -> str:
    """Interval literal for ``sequence`` spines of a bucket width."""
    w = _ALIASES.get(width.strip().lower(), width.strip().lower())
    return {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days",
            "month": "1 month"}.get(w, w)


# The three timestamp layouts accepted by the historical CSV
# loader, tried in this order (Python strptime spelling in comments).
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",          # %Y-%m-%d %H:%M:%S
    "yyyy-MM-dd'T'HH:mm:ss'Z'",     # %Y-%m-%dT%H:%M:%SZ
    "M/d/yyyy h:mm a",              # %m/%d/%Y %I:%M %p
)


def format_ntz(c, layout: str) -> Column:
    """Render a zone-less timestamp in one of ``TIMESTAMP_FORMATS`` from its
    wall-clock parts (``date_format`` would pass through the session zone)."""
    x = col_(c)
    y, mo, d, h, mi, sec = F.year(x), F.month(x), F.dayofmonth(x), F.hour(x), F.minute(x), F.second(x)
    if layout == TIMESTAMP_FORMATS[0]:
        return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, mo, d, h, mi, sec)
    if layout == TIMESTAMP_FORMATS[1]:
        return F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", y, mo, d, h, mi, sec)
    if layout == TIMESTAMP_FORMATS[2]:
        h12 = (h + 11) % 12 + 1
        return F.format_string("%d/%d/%04d %d:%02d %s", mo, d, y, h12, mi, F.when(h < 12, "AM").otherwise("PM"))
    raise ValueError(f"unsupported layout {layout!r}")


def try_parse_ntz(c, fmt: str | None = None) -> Column:
    """Parse text straight to ``timestamp_ntz`` (no session-zone round trip,
    so wall-clock times inside a DST gap survive); NULL when it does not
    parse.  The zoned ``try_`` parse only guards validity, so ANSI mode
    never raises."""
    if fmt is None:
        ok = F.try_to_timestamp(col_(c))
        return F.when(ok.isNotNull(), F.to_timestamp_ntz(col_(c)))
    ok = F.try_to_timestamp(col_(c), F.lit(fmt))
    return F.when(ok.isNotNull(), F.to_timestamp_ntz(col_(c), F.lit(fmt)))


def parse_timestamp(c, formats=TIMESTAMP_FORMATS) -> Column:
    """First format that parses wins; NULL when none does."""
    return F.coalesce(*[try_parse_ntz(c, f) for f in formats])


def interval(spec: str) -> Column:
    return F.expr(f"INTERVAL {spec}")


_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, computed on the
    wall clock (independent of the session time zone and of DST)."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), col_(c).cast("timestamp_ntz"))


def epoch_hours(c) -> Column:
    """Hours since 1970-01-01 as double (zone-less arithmetic)."""
    return epoch_micros(c) / F.lit(3_600_000_000.0)
