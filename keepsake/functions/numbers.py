"""Numbers as exports write them, and as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an optional code, an optional sign, digits with separators, an optional code.
CURRENCY = r"^\s*([A-Z]{3})?\s*[$£€¥₩₹]?\s*(-?[\d.,]+)\s*([A-Z]{3})?\s*$"
SIGNS = r"[$£€¥₩₹]"


def looks_numeric(s: Column) -> Column:
    return F.coalesce(s.rlike(CURRENCY) & F.regexp_extract(s, CURRENCY, 2).rlike(r"\d"), F.lit(False))


def to_number(s: Column) -> Column:
    """The number, null if there is none; of comma and point, the last one is the decimal sign."""
    raw = F.when(s.rlike(CURRENCY), F.regexp_extract(s, CURRENCY, 2))
    back = F.reverse(raw)
    comma, point = F.locate(",", back), F.locate(".", back)  # from the end; 0: not there
    european = (comma > 0) & ((point == 0) | (comma < point))
    plain = F.when(european, F.regexp_replace(F.regexp_replace(raw, r"\.", ""), "^([^,]*),", "$1.")).otherwise(F.regexp_replace(raw, ",", ""))
    return F.regexp_extract(plain, r"^-?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def total(x: Column, times: Column | None = None) -> Column:
    """The sum of doubles, each counted `times` times, null without any: exact for values under 10^14 of six
    places at most, so neither their number nor their order changes it. What else values have, and
    greater ones, are added as doubles."""
    own = x.try_cast("decimal(20,6)")
    rest = x - F.coalesce(own.cast("double"), F.lit(0.0))
    if times is not None:
        own, rest = own * times.cast("decimal(12,0)"), rest * times
    return F.sum(rest) + F.coalesce(F.sum(own).cast("double"), F.lit(0.0))


def currency_code(s: Column) -> Column:
    """The three-letter code beside a number, null if none."""
    before, after = F.regexp_extract(s, CURRENCY, 1), F.regexp_extract(s, CURRENCY, 3)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))


def _grouped(n: Column, places: int) -> Column:
    return F.regexp_replace(F.format_number(n, places), r"(\.\d*?)0+$", "$1")


def short_number(n: Column) -> Column:
    """12, 1,234, 12k, 1.2M."""
    size = F.abs(n)
    tenth = F.regexp_replace(_grouped(F.floor(n * 10 + 0.5) / 10, 1), r"\.$", "")
    return (
        F.when(n.isNull() | F.isnan(n), "-")
        .when(size >= 1_000_000, F.concat(F.regexp_replace(F.format_number(F.floor(n / 100_000 + 0.5) / 10, 1), r"\.0$|,", ""), F.lit("M")))
        .when(size >= 10_000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k")))
        .otherwise(tenth)
    )


def money(n: Column, code: Column | None = None) -> Column:
    """Never abbreviated: whole from 1,000 on, else two places at most."""
    body = F.when(F.abs(n) >= 1000, F.format_number(F.floor(n + 0.5), 0)).otherwise(F.regexp_replace(_grouped(F.floor(n * 100 + 0.5) / 100, 2), r"\.$", ""))
    return body if code is None else F.concat_ws(" ", body, code)


def bytes_text(n: Column) -> Column:
    """1 decimal from kilobytes on, steps of 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**k, F.concat(F.format_number(n / 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def cents(n: Column) -> Column:
    """A two-place amount as whole hundredths, which add up exactly in any order."""
    return F.round(n * 100).cast("long")
