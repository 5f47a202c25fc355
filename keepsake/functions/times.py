"""Wall-clock timestamps (TIMESTAMP_NTZ) as numbers and strings, whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds from 1970 to the fields of the timestamp."""
    t = _col(ts)
    seconds = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def from_micros(us: Column | str) -> Column:
    return F.timestamp_add("MICROSECOND", _col(us), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def day(ts: Column | str) -> Column:
    return F.substring(_col(ts).cast("string"), 1, 10)


def month(ts: Column | str) -> Column:
    return F.substring(_col(ts).cast("string"), 1, 7)


def month_number(ts: Column | str) -> Column:
    """Months since year 0."""
    return (F.year(_col(ts)) * 12 + F.month(_col(ts)) - 1).cast("long")


def weekday(ts: Column | str) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(_col(ts)) - 1).cast("long")
