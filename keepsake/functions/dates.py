"""Dates as exports write them, parsed to TIMESTAMP_NTZ; what isn't a date is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month abbreviations; the first year that a camera or a clock is believed.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FIRST_YEAR = 1990
#: Epochs in this window are dates (1990 to a year from now), longer ones are numbers.
FIRST_EPOCH_MS, YEAR_MS = 631_152_000_000, 31_536_000_000


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _part(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, pattern, group)


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_add("MICROSECOND", ms.cast("long") * 1000, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def _clock(s: Column, pattern: str, groups: tuple[int, ...], sep: str = "-") -> Column:
    """Date and time fields that pattern captures; the time, if none is captured, is noon."""
    y, mo, d, *rest = (_part(s, pattern, g) for g in groups)
    time = F.concat_ws(":", *rest) if rest else F.lit("12:00:00")
    return F.when(s.rlike(pattern), _ntz(F.concat(F.concat_ws("-", y, mo, d), F.lit(" "), time)))


def parse_date(s: Column) -> Column:
    """ISO date and time, any tail; a number of seconds or milliseconds; else whatever casts."""
    t = F.trim(s)
    iso = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
    number = F.when(t.rlike(r"^\d{10,13}$"), t.try_cast("long"))
    ms = F.when(number > 1_000_000_000_000, number).when(number > 1_000_000_000, number * 1000)
    return F.coalesce(_clock(t, iso, (1, 2, 3, 4, 5, 6)), from_epoch_ms(ms), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), _ntz(t)))


def english_date(s: Column) -> Column:
    """`1 March 2024`, `Mar 1, 2024`, with a time of day or not."""
    low = F.lower(s)
    names = "|".join(MONTHS)
    first = rf"(?:^|\W)({names})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
    second = rf"(?:^|\W)(\d{{1,2}})(?:st|nd|rd|th)?\s+({names})[a-z]*\.?,?\s+(\d{{4}})"
    one = low.rlike(first)
    month = F.when(one, _part(low, first, 1)).otherwise(_part(low, second, 2))
    day = F.when(one, _part(low, first, 2)).otherwise(_part(low, second, 1))
    year = F.when(one, _part(low, first, 3)).otherwise(_part(low, second, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("string")
    time = r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap]m)?"
    hour = _part(low, time, 1).try_cast("int")
    half = _part(low, time, 4)
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    second_ = F.when(_part(low, time, 3) == "", "00").otherwise(_part(low, time, 3))
    clock = F.when(low.rlike(time), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), _part(low, time, 2), second_)).otherwise("00:00:00")
    date = F.concat_ws("-", year, F.lpad(number, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(one | low.rlike(second), _ntz(F.concat(date, F.lit(" "), clock)))


def profile_date(value: Column, now_ms: int | None = None) -> Column:
    """The profiler's dates. Fixed order, first hit of: 10 or 13 digits of epoch within living memory, ISO
    with - or /, day first with / or ., eight digits, English month names."""
    s = F.trim(value)
    latest = (F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())) + YEAR_MS
    epoch = F.when(s.rlike(r"^\d{10}$"), s.try_cast("long") * 1000).when(s.rlike(r"^\d{13}$"), s.try_cast("long"))
    inside = F.when(epoch.between(FIRST_EPOCH_MS, latest), from_epoch_ms(epoch))
    iso = r"^\d{4}[-/]\d{2}[-/]\d{2}"
    tidy = F.regexp_replace(F.regexp_replace(s, r"^(\d{4})[-/](\d{2})[-/](\d{2})", "$1-$2-$3"), r"(Z|\s*[+-]\d{2}:?\d{2}|\s*UTC)$", "")
    day_first = r"^(\d{2})[/.](\d{2})[/.](\d{4})"
    eight = r"^(\d{4})(\d{2})(\d{2})$"
    date = lambda p, g: _ntz(F.concat_ws("-", *(_part(s, p, k) for k in g)))
    return (
        F.when(s.rlike(r"^\d{10}$|^\d{13}$"), inside)
        .when(s.rlike(iso), F.coalesce(_ntz(tidy), _ntz(F.substring(tidy, 1, 19))))
        .when(s.rlike(day_first), date(day_first, (3, 2, 1)))
        .when(s.rlike(eight), date(eight, (1, 2, 3)))
        .when(s.rlike(r"(?i)[a-z]{3}") & s.rlike(r"\d{4}"), english_date(s))
    )


def exif_date(s: Column) -> Column:
    at = _clock(F.trim(s), r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})", (1, 2, 3, 4, 5, 6))
    return F.when(F.year(at) >= FIRST_YEAR, at)


def date_from_name(name: Column, latest: Column | None = None) -> Column:
    """The date that a camera or messenger wrote into a file's name; noon where it gives no time.
    Only real days from 1990 to tomorrow (or latest) count."""
    #: Four name shapes, in this order.
    shapes = [
        (r"^(\d{4})-(\d{2})-(\d{2})(?:[._T -]|$)", (1, 2, 3)),
        (r"(?i)^(?:IMG|VID|PXL|MVIMG|Screenshot)?[_-]?(\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})", (1, 2, 3, 4, 5, 6)),
        (r"(?i)^(?:IMG|VID|AUD)-(\d{4})(\d{2})(\d{2})-WA\d+", (1, 2, 3)),
        (r"(?i)^Screenshot[_-](\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})", (1, 2, 3, 4, 5, 6)),
    ]
    end = latest if latest is not None else F.timestamp_add("DAY", F.lit(1), F.localtimestamp())
    tried = []
    for pattern, groups in shapes:
        at = _clock(name, pattern, groups)
        tried.append(F.when((F.year(at) >= FIRST_YEAR) & (at <= end), at))
    return F.coalesce(*tried)


def dos_date(date: Column, time: Column) -> Column:
    """The two 16-bit fields of a zip directory; two-second steps."""
    y = F.shiftright(date, 9) + 1980
    bits = [F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31), F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), time.bitwiseAND(31) * 2]
    mo, d, h, mi, s = (F.lpad(b.cast("string"), 2, "0") for b in bits)
    return F.when(y >= FIRST_YEAR, _ntz(F.concat(F.concat_ws("-", y.cast("string"), mo, d), F.lit(" "), F.concat_ws(":", h, mi, s))))


def ics_date(s: Column) -> Column:
    """struct(at, all_day): `20240301T123000Z`, the same without Z, `20240301`."""
    full = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?"
    only = r"^(\d{4})(\d{2})(\d{2})$"
    sec = F.when(_part(s, full, 6) == "", "00").otherwise(_part(s, full, 6))
    at = F.concat(F.concat_ws("-", *(_part(s, full, k) for k in (1, 2, 3))), F.lit(" "), F.concat_ws(":", _part(s, full, 4), _part(s, full, 5), sec))
    all_day = s.rlike(only)
    return F.struct(
        F.when(s.rlike(full), _ntz(at)).when(all_day, _ntz(F.concat_ws("-", *(_part(s, only, k) for k in (1, 2, 3))))).alias("at"),
        all_day.alias("all_day"),
    )


def best_date(kind: Column, sidecar: Column, exif: Column, movie: Column, name: Column, archive: Column) -> Column:
    """struct(at, at_source): a movie's own header wins for videos, then sidecar, EXIF, name, archive."""
    order = [("mvhd", F.when(kind == "video", movie)), ("sidecar", sidecar), ("exif", exif), ("name", name), ("archive", archive)]
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in order))
    return F.struct(F.coalesce(*(c for _, c in order)).alias("at"), source.alias("at_source"))
