"""Contents of export files as rows. What expressions can read, they read; Arrow functions are kept to
what they can't: quoted CSV, sheets in zip files, mail bodies, binary headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from keepsake.functions import dates, names, text

from . import records

_TABLE = ArrayType(ArrayType(StringType()))


@F.pandas_udf(_TABLE)
def csv_rows(content: pd.Series) -> pd.Series:
    """Rows of a CSV text; blank rows at the end are dropped, rows may differ in length."""
    import csv
    import io

    def one(s):
        if s is None:
            return None
        csv.field_size_limit(2**31 - 1)
        rows = list(csv.reader(io.StringIO(s.replace("\r\n", "\n").replace("\r", ""))))
        while rows and not any(c.strip() for c in rows[-1]):
            rows.pop()
        return rows

    return content.map(one)


@F.pandas_udf(_TABLE)
def xlsx_rows(content: pd.Series) -> pd.Series:
    """Rows of a workbook's first sheet; cells stand where their reference says."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    words = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")

    def column(ref: str) -> int:
        n = 0
        for ch in re.match("[A-Z]*", ref)[0]:
            n = n * 26 + ord(ch) - 64
        return n - 1

    def one(raw):
        if raw is None:
            return None
        try:
            z = zipfile.ZipFile(io.BytesIO(raw))
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = [words(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
            sheet = min((n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
            out = []
            for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if tag(e) == "row"):
                cells: list[str] = []
                for c in row:
                    at = column(c.get("r", "")) if c.get("r") else len(cells)
                    v = next((x.text or "" for x in c if tag(x) == "v"), "")
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = shared[int(v)] if c.get("t") == "s" else words(c) if c.get("t") == "inlineStr" else v
                out.append(cells)
            return out
        except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError, KeyError):
            return None

    return content.map(one)


def keys_of(files: DataFrame) -> list[str]:
    """What tells files apart: their source, where it is given, and their path."""
    return [c for c in ("source_id", "path") if c in files.columns]


_TABLES = ArrayType(StructType([StructField("section", LongType()), StructField("title", StringType()), StructField("header", ArrayType(StringType())), StructField("rows", _TABLE)]))


@F.pandas_udf(_TABLES)
def tables_in(rows: pd.Series) -> pd.Series:
    """The tables in a file's rows, by records.tables."""
    from itertools import groupby

    def one(found):
        if found is None:
            return None
        by = groupby(records.tables(map(list, found)), lambda t: t[0])
        lists = [list(g) for _, g in by]
        return [{"section": g[0][0], "title": g[0][1], "header": g[0][3], "rows": [t[4] for t in g]} for g in lists]

    return rows.map(one)


def section_rows(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """tables(source_id if any, path, rows) as (source_id if any, path, table_id, title, row_no, header, r): a
    row of a section and its names. A file's rows are there together, so nothing is shuffled or sorted."""
    keys = keys_of(tables)
    found = tables.select(*keys, F.explode(tables_in(rows)).alias("t"))
    flat = found.select(*keys, "t.section", "t.title", "t.header", F.posexplode("t.rows").alias("row_no", "r"))
    return flat.select(*keys, _table_id(), "title", F.col("row_no").cast("long").alias("row_no"), "header", "r")


def _table_id() -> Column:
    return F.concat_ws("#", "path", F.col("section").cast("string")).alias("table_id")


def section_records(read: DataFrame) -> DataFrame:
    """The same of read(source_id if any, path, section, title, row_no, header, fields), as archive_records gives them
    for tables: files of any size, in order as they are read."""
    return read.where("fields IS NOT NULL").select(*keys_of(read), _table_id(), "title", "row_no", "header", F.col("fields").alias("r"))


def section_cells(found: DataFrame) -> DataFrame:
    """Rows of sections as cells: (source_id if any, table_id, title, row_no, col_no, col_name, value)."""
    own = keys_of(found)[:-1]
    cells = found.select(*own, "table_id", "title", "row_no", "header", F.posexplode("r").alias("col_no", "value"))
    name = F.get("header", F.col("col_no"))
    return cells.select(*own, "table_id", "title", "row_no", "col_no", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("column "), (F.col("col_no") + 1).cast("string"))).alias("col_name"), "value")


def sections(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """tables(source_id if any, path, rows) as cells, by section_rows."""
    return section_cells(section_rows(tables, rows))


def stacked_lines(flat: DataFrame) -> DataFrame:
    """flat(source_id if any, path, line, r), rows of sheets, as (source_id if any, path, section, title, columns,
    row_no, r): tables that stand one below the other.

    Rows of one width in a row are a run; a width goes to the last cell that isn't empty. A run of one row
    before a wider run of two rows or more is a title, its last cell that says something. A sheet that
    opens with a title and has two is cut at them, and other runs aren't tables; any other sheet is
    one table, its first row has the column names. Sections of four columns and more have their names
    in their first row, narrower ones none. Windows run over the rows of one file."""
    keys = keys_of(flat)
    last = F.array_max(F.transform("r", lambda c, i: F.when(F.coalesce(c, F.lit("")) != "", i + 1).otherwise(0)))
    by = Window.partitionBy(*keys).orderBy("line")
    wide = flat.select(*keys, "line", "r", F.coalesce(last, F.lit(0)).alias("w"))
    fresh = F.coalesce(F.lag("w").over(by) != F.col("w"), F.lit(True)).cast("int")
    runs = wide.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy(*keys, "run").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(*keys).orderBy("run")
    titled = (F.col("size") == 1) & (F.col("w") < F.lead("w").over(order)) & (F.lead("size").over(order) >= 2)
    per = per.withColumn("titled", F.coalesce(titled, F.lit(False)))
    per = per.withColumn("under", F.coalesce(F.lag("titled").over(order), F.lit(False)))
    whole = Window.partitionBy(*keys)
    per = per.withColumns({"most": F.max("w").over(whole), "cut": (F.sum(F.col("titled").cast("int")).over(whole) >= 2) & F.max(F.col("titled") & (F.col("run") == 1)).over(whole)})
    told = runs.drop("w", "fresh").join(per, [*keys, "run"])
    words = F.filter("r", lambda c: F.coalesce(c, F.lit("")) != "")
    told = told.where("titled OR under OR NOT cut").withColumn("section", F.when(F.col("cut"), F.when(F.col("titled"), F.col("run")).otherwise(F.col("run") - 1)).otherwise(F.lit(0)))
    inside = Window.partitionBy(*keys, "section").orderBy("line")
    told = told.withColumn("title", F.first(F.when(F.col("cut"), F.trim(F.try_element_at(words, F.lit(-1))))).over(inside)).where("under OR NOT cut")
    place = F.row_number().over(inside)
    told = told.withColumns({"place": place, "n_cols": F.when(F.col("cut"), F.col("w")).otherwise(F.col("most")), "head": F.first("r").over(inside)})
    header = ~F.col("cut") | (F.col("n_cols") >= 4)
    columns = F.transform(F.sequence(F.lit(1), F.col("n_cols")), lambda i: F.coalesce(F.when(header, F.nullif(F.get("head", i - 1), F.lit(""))), F.concat(F.lit("Column "), i.cast("string"))))
    told = told.where(~header | (F.col("place") > 1)).where("n_cols > 0")
    return told.select(*keys, "section", F.coalesce("title", F.lit("")).alias("title"), columns.alias("columns"), (F.col("place") - F.when(header, 2).otherwise(1)).cast("long").alias("row_no"), F.slice("r", F.lit(1), F.col("n_cols")).alias("r"))


def stacked_cells(found: DataFrame) -> DataFrame:
    """Rows of stacked tables as cells; titles that are null or equal are told apart by their section."""
    own = keys_of(found)[:-1]
    rows = found.select(*own, F.concat_ws("#", "path", F.col("section").cast("string")).alias("table_id"), "title", "row_no", "columns", F.posexplode("r").alias("col_no", "value"))
    return rows.select(*own, "table_id", "title", "row_no", "col_no", F.get("columns", F.col("col_no")).alias("col_name"), "value")


def under(header: Column, row: Column, pattern: str) -> Column:
    """A row's value under the first column whose name is like this; null without one."""
    return F.get(row, F.array_position(F.transform(header, lambda h: F.trim(h).rlike(pattern)), True).cast("int") - 1)


def json_tables(files: DataFrame) -> DataFrame:
    """files(source_id if any, path, content): arrays of objects, at the top or under any key, as cells;
    columns go by the first object's keys."""
    keys = keys_of(files)
    own = keys[:-1]
    doc = F.try_parse_json("content")
    top = files.select(*keys, F.lit("").alias("key"), F.try_variant_get(doc, "$", "array<map<string,variant>>").alias("list"))
    under = files.select(*keys, F.explode(F.try_variant_get(doc, "$", "map<string,variant>")).alias("key", "v")).select(*keys, "key", F.try_variant_get("v", F.lit("$"), "array<map<string,variant>>").alias("list"))
    lists = top.unionByName(under).where("size(list) > 0")
    first = F.map_keys(F.get("list", F.lit(0)))
    rows = lists.select(*own, F.concat_ws("#", "path", F.nullif("key", F.lit(""))).alias("table_id"), first.alias("names"), F.posexplode("list").alias("row_no", "o"))
    return _object_cells(rows, own)


def json_records(objects: DataFrame) -> DataFrame:
    """The same of objects(source_id if any, path, record, raw, fields), as archive_records gives them for JSON. Rows
    have the numbers of their records."""
    own, key = keys_of(objects)[:-1], F.get("fields", F.lit(0))
    o = F.try_variant_get(F.try_parse_json("raw"), F.lit("$"), "map<string,variant>")
    rows = objects.where("raw IS NOT NULL").select(*own, F.concat_ws("#", "path", F.nullif(key, F.lit(""))).alias("table_id"), F.slice("fields", 2, 2**31 - 2).alias("names"), F.col("record").alias("row_no"), o.alias("o"))
    return _object_cells(rows, own)


def _object_cells(rows: DataFrame, own: list[str]) -> DataFrame:
    cells = rows.select(*own, "table_id", F.col("row_no").cast("long").alias("row_no"), "o", F.posexplode("names").alias("col_no", "col_name"))
    value = F.try_element_at("o", F.col("col_name"))
    return cells.select(*own, "table_id", F.lit(None).cast("string").alias("title"), "row_no", "col_no", "col_name", F.coalesce(F.try_variant_get(value, F.lit("$"), "string"), F.to_json(value)).alias("value"))


# ---- contacts, calendars, mail


def _property(block: Column, name: str) -> Column:
    """The first value of a contact or calendar property."""
    return F.nullif(F.trim(text.unescape(F.regexp_extract(block, rf"(?im)^(?:item\d+\.)?{name}(?:;[^:\n]*)?:(.*)$", 1))), F.lit(""))


def _properties(block: Column, name: str) -> Column:
    return F.transform(F.regexp_extract_all(block, F.lit(rf"(?im)^(?:item\d+\.)?{name}(?:;[^:\n]*)?:(.*)$"), 1), lambda v: F.trim(text.unescape(v)))


def contacts(files: DataFrame) -> DataFrame:
    """files(path, content): a row a vCard that has a name, an address or a number. Without FN the name is
    put together from N: prefix, given, middle, family, suffix."""
    blocks = F.regexp_extract_all(text.unfold(F.col("content")), F.lit(r"(?is)BEGIN:VCARD(.*?)END:VCARD"), 1)
    card = files.select("path", F.explode(blocks).alias("b"))
    parts = F.split(_property(F.col("b"), "N"), ";", -1)
    composed = F.concat_ws(" ", *(F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i in (3, 1, 2, 0, 4)))
    read = card.select(
        "path", F.coalesce(_property(F.col("b"), "FN"), F.nullif(composed, F.lit(""))).alias("name"), _property(F.col("b"), "ORG").alias("org"), _property(F.col("b"), "TITLE").alias("title"),
        _property(F.col("b"), "NOTE").alias("note"), _property(F.col("b"), "BDAY").alias("birthday"), _properties(F.col("b"), "EMAIL").alias("emails"), _properties(F.col("b"), "TEL").alias("phones"),
        F.transform(_properties(F.col("b"), "ADR"), lambda a: F.array_join(F.filter(F.split(a, ";"), lambda x: F.trim(x) != ""), ", ")).alias("addresses"),
    )
    return read.where("name IS NOT NULL OR size(emails) > 0 OR size(phones) > 0")


def calendar(files: DataFrame) -> DataFrame:
    """files(path, content): a row an event or task; repeats is a flag, nothing is expanded."""
    whole = text.unfold(F.col("content"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(whole, F.lit(rf"(?is)BEGIN:{k}(.*?)END:{k}"), 1).alias("blocks")) for k in ("VEVENT", "VTODO")))
    item = files.select("path", F.inline(kinds)).select("path", "kind", F.explode("blocks").alias("b"))
    start = dates.ics_date(F.coalesce(_property(F.col("b"), "DTSTART"), _property(F.col("b"), "DUE")))
    end = dates.ics_date(_property(F.col("b"), "DTEND"))
    return item.select(
        "path", F.when(F.col("kind") == "VTODO", "task").otherwise("event").alias("kind"), _property(F.col("b"), "SUMMARY").alias("title"), _property(F.col("b"), "LOCATION").alias("location"),
        start["at"].alias("at"), end["at"].alias("until"), F.coalesce(start["all_day"], F.lit(False)).alias("all_day"), F.col("b").rlike(r"(?im)^RRULE").alias("repeats"),
    )


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """A mailbox as messages(raw): the text reader splits it at separators, so one file is many tasks."""
    whole = spark.read.option("lineSep", "\nFrom ").text(path)
    return whole.select(F.regexp_replace("value", "^From ", "").alias("raw"))


def mails(raw: DataFrame, *keep: str) -> DataFrame:
    """raw(raw): a message after `From `, as its headers: subject, sender's name and address, date. Columns
    named in keep stay."""
    # one element arrays hold what is worked out once, however often it is asked for, in filters too
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    whole = F.regexp_replace(F.regexp_replace("raw", "\r\n", "\n"), r"^[^\n]*\n", "")
    head = F.regexp_replace(F.split(whole, "\n\n", 2)[0], "\n[ \t]+", " ")
    field = lambda h, n: F.nullif(F.trim(F.regexp_extract(h, rf"(?im)^{n}:\s*(.*)$", 1)), F.lit(""))
    fields = once(head, lambda h: F.struct(field(h, "Subject").alias("subject"), field(h, "From").alias("sender"), once(field(h, "Date"), dates.english_date).alias("at")))
    told = raw.select(*keep, fields.alias("f"))
    read = told.select(*keep, text.decode_words(F.col("f.subject")).alias("subject"), text.address_name(text.decode_words(F.col("f.sender"))).alias("s"), F.col("f.at").alias("at"))
    return read.select(*keep, "subject", F.col("s.name").alias("name"), F.col("s.address").alias("address"), "at")


@F.pandas_udf(StringType())
def mhtml_page(content: pd.Series) -> pd.Series:
    """The largest HTML part of a saved page, decoded."""
    import email
    from email import policy

    def one(raw):
        if raw is None:
            return None
        parts = [p for p in email.message_from_bytes(bytes(raw), policy=policy.default).walk() if p.get_content_type() == "text/html"]
        pages = [p.get_payload(decode=True).decode(p.get_content_charset() or "utf-8", "replace") for p in parts]
        return max(pages, key=len, default=None)

    return content.map(one)


#: Fixed value: the verbs that activity pages begin with.
VERBS = "Watched|Searched for|Visited|Viewed|Used|Liked|Listened to|Subscribed to"
#: Fixed value: what a block of an activity page begins with.
BLOCK = '<div class="outer-cell'


def activity(pages: DataFrame) -> DataFrame:
    """pages(source_id if any, path, content): blocks of an activity page as (product, verb, what, href, at),
    with their file and place in it."""
    cut = F.split("content", BLOCK)
    return activity_of(pages.select(*keys_of(pages), F.posexplode(F.slice(cut, F.lit(2), F.size(cut))).alias("place", "b")))


def activity_of(rows: DataFrame) -> DataFrame:
    """The same of rows(source_id if any, path, place, b), what follows a BLOCK each."""
    keys = keys_of(rows)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&nbsp;| | ", " "), r"\s+", " "))
    b = F.col("b")
    cell = F.regexp_extract(b, r'(?s)class="content-cell[^"]*">(.*?)</div>', 1)
    product = plain(F.regexp_extract(b, r'(?s)class="[^"]*mdl-typography--title[^"]*">(.*?)</p>', 1))
    said = plain(cell)
    when = r"([A-Z][a-z]{2} \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2}\s?[AP]M|\d{1,2} [A-Z][a-z]{2,8} \d{4},? \d{1,2}:\d{2}:\d{2})"
    stamp = F.regexp_extract(said, when, 1)
    verb = F.regexp_extract(said, rf"^({VERBS})", 1)
    what = F.trim(F.regexp_replace(F.replace(F.replace(said, stamp, F.lit("")), verb, F.lit("")), r"\s+[A-Z]{2,5}$", ""))
    return rows.select(*keys, "place", product.alias("product"), F.nullif(verb, F.lit("")).alias("verb"), what.alias("what"), F.nullif(F.regexp_extract(cell, r'href="([^"]*)"', 1), F.lit("")).alias("href"), dates.english_date(stamp).alias("at"))


def notes(files: DataFrame) -> DataFrame:
    """files(path, content) of text notes: title, words, the rest."""
    here = files.where(F.col("path").rlike(r"(?i)notes?/.*\.txt$"))
    return here.select("path", text.first_line(F.col("content")).alias("title"), text.word_count(F.col("content")).alias("words"), F.col("content").alias("body"))


_HEALTH = ["type", "startDate", "endDate", "value", "sourceName"]


def _readings(raw: DataFrame, *keep: str) -> DataFrame:
    kind = F.regexp_replace("type", "^HK(Quantity|Category)TypeIdentifier", "")
    at = lambda c: F.substring(c, 1, 19).try_cast("timestamp_ntz")
    seconds = lambda c: F.unix_date(at(c).cast("date")) * 86_400 + F.hour(at(c)) * 3600 + F.minute(at(c)) * 60 + F.second(at(c))
    hours = (seconds("endDate") - seconds("startDate")) / 3600
    sleep = kind == "SleepAnalysis"
    state = F.regexp_extract("value", "SleepAnalysis(InBed|Asleep)", 1)
    return raw.select(*keep, F.when(sleep, state).otherwise(kind).alias("type"), at("startDate").alias("at"), F.when(sleep, hours).otherwise(F.col("value").try_cast("double")).alias("value"), F.col("sourceName").alias("source"))


def health_records(spark: SparkSession, path: str) -> DataFrame:
    """Readings of a health export (XML): type, at, value. The XML reader splits by record."""
    return _readings(spark.read.format("xml").option("rowTag", "Record").option("attributePrefix", "").schema(", ".join(f"{a} string" for a in _HEALTH)).load(path))


def health_elements(elements: DataFrame, *keep: str) -> DataFrame:
    """The same of elements(raw), the attributes of a record each."""
    found = lambda a: F.nullif(F.regexp_extract("raw", rf'(?:^|\s){a}="([^"]*)"', 1), F.lit(""))
    return _readings(elements.select(*keep, *(found(a).alias(a) for a in _HEALTH)), *keep)


def health_readings(files: DataFrame, *keep: str) -> DataFrame:
    """The same of files(content) that were unzipped already."""
    return health_elements(files.select(*keep, F.explode(F.regexp_extract_all("content", F.lit(r"<Record\s([^>]*)>"), 1)).alias("raw")), *keep)


# ---- binary headers


def sniff(head: Column) -> Column:
    """What a file's first bytes say it is; null if nothing known."""
    h = F.hex(F.substring(head, 1, 16))
    #: Magic numbers.
    known = [("FFD8FF", "jpg"), ("89504E47", "png"), ("47494638", "gif"), ("424D", "bmp"), ("46726F6D20", "mbox"), ("46726F6D3A", "mhtml")]
    out = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    for magic, kind in known:
        out = out.when(h.startswith(magic), F.lit(kind))
    return out


_EXIF = StructType([StructField("taken", StringType()), StructField("lat", DoubleType()), StructField("lon", DoubleType())])


@F.pandas_udf(_EXIF)
def exif(head: pd.Series) -> pd.DataFrame:
    """Original date and position in a JPEG's first bytes; positions out of range or at 0, 0 are none."""
    import struct

    def one(raw):
        if raw is None or raw[:2] != b"\xff\xd8":
            return (None, None, None)
        at = raw.find(b"Exif\0\0")
        if at < 0:
            return (None, None, None)
        t = raw[at + 6 :]
        order = "<" if t[:2] == b"II" else ">"

        def tags(where):
            n = struct.unpack_from(order + "H", t, where)[0]
            return {struct.unpack_from(order + "H", t, where + 2 + 12 * i)[0]: struct.unpack_from(order + "HII", t, where + 4 + 12 * i) + (where + 10 + 12 * i,) for i in range(n)}

        def letters(tag):
            _, n, v, here = tag
            return t[(v if n > 4 else here) :][:n].split(b"\0")[0].decode("latin-1")

        def degrees(tag):
            v = struct.unpack_from(order + "6I", t, tag[2])
            return v[0] / v[1] + v[2] / v[3] / 60 + v[4] / v[5] / 3600

        try:
            top = tags(struct.unpack_from(order + "I", t, 4)[0])
            taken = letters(tags(top[0x8769][2])[0x9003]) if 0x8769 in top and 0x9003 in tags(top[0x8769][2]) else None
            lat = lon = None
            if 0x8825 in top:
                g = tags(top[0x8825][2])
                if {1, 2, 3, 4} <= set(g):
                    lat = degrees(g[2]) * (-1 if letters(g[1]) == "S" else 1)
                    lon = degrees(g[4]) * (-1 if letters(g[3]) == "W" else 1)
                    if abs(lat) > 90 or abs(lon) > 180 or (lat == 0 and lon == 0):
                        lat = lon = None
            return (taken, lat, lon)
        except (struct.error, ZeroDivisionError, IndexError, KeyError):
            return (None, None, None)

    return pd.DataFrame([one(h) for h in head], columns=["taken", "lat", "lon"])


def tidy_columns(cells: DataFrame) -> DataFrame:
    """Cells with readable column names."""
    return cells.withColumn("col_name", names.nice_column(F.col("col_name")))
