"""Texts in exports: repaired encodings, folded words, cells that hold documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def is_mangled(s: Column) -> Column:
    """UTF-8 that was read as Latin-1: no character above U+00FF, some above U+007F, valid bytes."""
    return F.coalesce(_repaired(s).isNotNull(), F.lit(False))


def _repaired(s: Column) -> Column:
    latin = ~s.rlike(r"[^\x{0}-\x{FF}]") & s.rlike(r"[\x{80}-\x{FF}]")
    # encoding is only reached by Latin-1 texts, which it can't refuse
    return F.when(latin, F.try_validate_utf8(F.encode(F.when(latin, s), "ISO-8859-1").cast("string")))


def repair(s: Column) -> Column:
    """The text as it was meant; texts that aren't mangled stay as they are."""
    return F.coalesce(_repaired(s), s)


def comment_text(s: Column) -> Column:
    """Comma-joined JSON segments without brackets, put together; other texts stay."""
    parsed = F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<struct<text:string>>")
    joined = F.array_join(F.transform(parsed, lambda x: x["text"]), "")
    return F.when(F.trim(s).startswith("{") & (F.coalesce(joined, F.lit("")) != ""), joined).otherwise(s)


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def first_line(s: Column) -> Column:
    return F.split(s, "\n", 2)[0]


def address_name(s: Column) -> Column:
    """struct(name, address) of `"Name" <a@b>` or `a@b`; the name falls back to the address."""
    angle = r"^\s*\"?([^\"<]*?)\"?\s*<([^>]+)>"
    address = F.lower(F.trim(F.when(s.rlike(angle), F.regexp_extract(s, angle, 2)).otherwise(s)))
    name = F.trim(F.regexp_extract(s, angle, 1))
    return F.struct(F.when(name != "", name).otherwise(address).alias("name"), address.alias("address"))


@F.pandas_udf(StringType())
def decode_words(raw: pd.Series) -> pd.Series:
    """RFC 2047 words in a header, decoded; what can't be decoded stays."""
    from email.errors import HeaderParseError
    from email.header import decode_header, make_header

    def one(s):
        if s is None or "=?" not in s:
            return s
        try:
            return str(make_header(decode_header(s)))
        except (HeaderParseError, LookupError, UnicodeDecodeError):
            return s

    return raw.map(one)


def unescape(s: Column) -> Column:
    r"""`\n`, `\,`, `\;` and `\\` of contact and calendar values."""
    out = F.regexp_replace(s, r"\\[nN]", "\n")
    return F.regexp_replace(out, r"\\([,;\\])", "$1")


def unfold(s: Column) -> Column:
    """Continuation lines joined to the line before; line ends are \\n."""
    return F.regexp_replace(F.regexp_replace(s, "\r\n|\r", "\n"), "\n[ \t]", "")


def find_named(cell: Column) -> Column:
    """The first name-like string in a cell that is a JSON document, without folders and extension;
    other cells as they are; empty where a document names nothing."""
    s = F.trim(cell)
    #: Fixed value: keys that name things.
    name = r'(?i)"(?:path|title|name|subject|filename|file|label|caption)"\s*:\s*"((?:[^"\\]|\\.)*[^\s"\\](?:[^"\\]|\\.)*)"'
    hit = F.regexp_replace(F.regexp_extract(s, name, 1), r"\\(.)", "$1")
    last = F.regexp_extract(hit, r"([^/]+)/*$", 1)
    bare = F.trim(F.regexp_replace(last, r"(?i)\.[a-z0-9]{1,5}$", ""))
    return F.when(s.rlike(r"^[{\[]"), F.when(F.try_parse_json(s).isNotNull(), bare).otherwise("")).otherwise(s)


def nested_summary(cell: Column) -> Column:
    """A short line for a JSON cell: the first three of a list and how many more, an object's name, or
    its first three pairs."""
    s = F.trim(cell)
    items = F.from_json(F.when(s.startswith("["), s), "array<string>")
    more = F.size(items) - 3
    listed = F.concat(F.array_join(F.slice(items, 1, 3), ", "), F.when(more > 0, F.concat(F.lit(", "), more.cast("string"), F.lit(" more"))).otherwise(""))
    pairs = F.map_entries(F.from_json(F.when(s.startswith("{"), s), "map<string,string>"))
    shown = F.array_join(F.transform(F.slice(pairs, 1, 3), lambda p: F.concat_ws(": ", p["key"], p["value"])), ", ")
    named = find_named(s)
    return F.when(s.startswith("["), listed).when(s.startswith("{"), F.when(named != "", named).otherwise(shown)).otherwise(s)
