"""Timestamps of publishers, in UTC and whole seconds. `now` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?$"
POSTED = r"(?i)posted\s+(?:<\s*)?(today|yesterday|\d+\s*(?:hour|day|week)s?(?:\s+ago)?)"


def _text(c: Column | str) -> Column:
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))


def to_utc(c: Column | str) -> Column:
    """ISO stamps (without a zone: UTC) or month/day/year, else null. The session's zone must be UTC."""
    t = _text(c)
    iso = F.when(t.rlike(ISO), F.coalesce(t.try_cast("timestamp"), F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")))
    other = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"))]
    return F.date_trunc("second", F.coalesce(iso, *other))


def posted_stamp(c: Column | str) -> Column:
    """The stamp in a card's text: `today`, `3 days ago` or the like, in lower case."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.regexp_extract(_text(c), POSTED, 1)), r"\s+", " ")), F.lit(""))


def posted_to_timestamp(c: Column | str, now: Column) -> Column:
    p = F.lower(_text(c))
    n = F.regexp_extract(p, r"^(\d+)\s*(hour|day|week)", 1).try_cast("int")
    unit = F.regexp_extract(p, r"^(\d+)\s*(hour|day|week)", 2)
    hours = F.when(p == "today", 0).when(p == "yesterday", 24).when(unit == "hour", n).when(unit == "day", n * 24).when(unit == "week", n * 168)
    return F.date_trunc("second", now - F.make_dt_interval(F.lit(0), hours))


def hours_between(start: Column | str, end: Column | str) -> Column:
    a, b = ((F.col(c) if isinstance(c, str) else c).cast("timestamp") for c in (start, end))
    return (F.unix_micros(b) - F.unix_micros(a)) / 3_600_000_000.0
