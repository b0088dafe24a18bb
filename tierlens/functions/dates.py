"""Date and time functions with the conventions of the reference SQL: Sunday is day 0, epoch integers convert."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("YEAR", "MONTH", "DAY", "DOW")


def part(unit: str, value: Column) -> Column:
    """YEAR, MONTH, DAY, DOW (0 on Sundays), HOUR or MINUTE of a date or timestamp."""
    functions = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "DOW": lambda c: F.dayofweek(c) - 1, "HOUR": F.hour, "MINUTE": F.minute}
    if unit.upper() not in functions:
        raise ValueError(f"not a date part: {unit}")
    return functions[unit.upper()](value)


def expand(unit: str, value: Column) -> Column:
    """A date that has *value* as its part: the rest is lost, but part(unit, expand(unit, part(unit, x))) is part(unit, x)."""
    lit = F.lit
    dates = {
        "YEAR": F.make_date(value, lit(1), lit(1)),
        "MONTH": F.make_date(lit(1970), value, lit(1)),
        "DAY": F.make_date(lit(1970), lit(1), value),
        "DOW": F.date_add(lit("1970-01-04").cast("date"), value),
    }
    return dates[unit.upper()]


def date_from_days(days: Column) -> Column:
    """The date so many days after 1970-01-01."""
    return F.date_from_unix_date(days.cast("int"))


def to_timestamp_seconds(value: Column) -> Column:
    return F.timestamp_seconds(value).cast("timestamp_ntz")


def to_timestamp_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def seconds_compare(seconds: Column, op: str, ts: datetime) -> Column:
    """``to_timestamp_seconds(seconds) op ts`` on whole seconds, as a comparison of the column itself, which scans can push down."""
    micros_ = (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    whole, rest = divmod(micros_, 1_000_000)
    if op in ("=", "<>") and rest:
        return F.when(seconds.isNotNull(), F.lit(op == "<>"))
    limit = F.lit(whole + (1 if rest and op in ("<", ">=") else 0))
    return {"=": seconds == limit, "<>": seconds != limit, "<": seconds < limit, "<=": seconds <= limit, ">": seconds > limit, ">=": seconds >= limit}[op]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts, "UTC"))


def date_bin(width_micros: int, ts: Column, origin_micros: int = 0) -> Column:
    """Start of the bucket of *width_micros* that holds *ts*, buckets being counted from the origin."""
    since = micros(ts) - origin_micros
    return to_timestamp_micros(since - F.pmod(since, F.lit(width_micros)) + origin_micros)


def epoch_between(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, with fraction."""
    return (micros(later) - micros(earlier)) / 1e6
