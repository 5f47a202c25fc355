"""Names of columns, keys and people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with a spelling of their own, glued words, keys with a reading of their own.
COLUMN_WORDS = {
    "uuid": "UUID", "id": "ID", "url": "URL", "os": "OS", "imei": "IMEI", "ip": "IP", "pkg": "Package", "dt": "Date", "ts": "Time",
    "num": "Number", "no": "Number", "sa": "Samsung account", "tab": "Tab", "app": "App", "sim": "SIM",
}
GLUED = {"datauuid": "data uuid", "pkgname": "package name", "devicetype": "device type", "filename": "file name", "createtime": "create time", "updatetime": "update time"}
KEY_WORDS = {"dob": "Born", "birth": "Born", "birthdate": "Born", "birthday": "Born", "id": "ID", "url": "URL", "uuid": "UUID", "os": "OS", "sa": "Samsung account"}


def _plain(name: Column) -> Column:
    s = F.regexp_replace(F.trim(name), r"^[A-Z]{2,4}@", "")
    s = F.regexp_replace(s, r"(?i)^com\.samsung\.[a-z.]*", "")
    s = F.when((s == F.upper(s)) & s.rlike("[A-Z]"), F.lower(s)).otherwise(s)
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, r"[_.]+", " "), r"\s+", " ")))


def _spelled(s: Column, words: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    out = F.array_join(F.transform(F.split(s, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 100_000))


def nice_column(name: Column) -> Column:
    """`SBR@create_time` reads `Create time`."""
    s = _plain(name)
    for glued, apart in GLUED.items():
        s = F.replace(s, F.lit(glued), F.lit(apart))
    return F.when(s == "", name).otherwise(_spelled(s, COLUMN_WORDS))


def nice_key(name: Column) -> Column:
    s = _plain(name)
    table = F.create_map(*(F.lit(x) for kv in KEY_WORDS.items() for x in kv))
    return F.when(s == "", name).otherwise(F.coalesce(F.try_element_at(table, F.replace(s, F.lit(" "), F.lit(""))), _spelled(s, KEY_WORDS)))


def nice_value(key: Column, value: Column) -> Column:
    """Y, N, true and false as Yes and No; dates under a key that speaks of dates as `5 Oct 1995`."""
    from .dates import MONTHS, profile_date

    s = F.trim(value)
    at = profile_date(s)
    month = F.get(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), F.month(at) - 1)
    date = F.concat_ws(" ", F.dayofmonth(at).cast("string"), month, F.year(at).cast("string"))
    return (
        F.when(s.rlike("(?i)^(y|true)$"), "Yes")
        .when(s.rlike("(?i)^(n|false)$"), "No")
        .when(key.rlike("(?i)date|birth|dob|time|created|updated") & at.isNotNull(), date)
        .otherwise(s)
    )


def person_key(name: Column) -> Column:
    """Lower case, without what is in brackets, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\(.*?\)", " "), r"[^a-z0-9]+", " "))


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    first = F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1)))
    return F.array_join(first, "")


def subreddit(name: Column) -> Column:
    s = F.regexp_replace(F.trim(name), r"(?i)^/?r/", "")
    return F.when(s != "", F.concat(F.lit("r/"), s))


def mask_digits(s: Column) -> Column:
    """Each run of digits as as many #, four at most."""
    return F.regexp_replace(F.regexp_replace(s, r"\d{4,}", "####"), r"\d", "#")


def shape(s: Column) -> Column:
    """Letters and digits by class, runs of one character cut to four."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[A-Z]", "A"), "[a-z]", "a"), r"\d", "9")
    return F.regexp_replace(out, r"(.)\1{3,}", "$1$1$1$1")


#: Fixed value: folders below which names are people's.
PERSONAL = r"(?i)^(inbox|message_requests|archived_threads|filtered_threads|e2ee_cutover|chats|conversations|calls|friends|albums|shared_albums|groups|google photos)$"


def mask_folder(folder: Column) -> Column:
    """Folder names with digits masked; below a folder of people, only shapes."""
    parts = F.split(folder, "/")
    first = F.array_position(F.transform(parts, lambda p: p.rlike(PERSONAL)), F.lit(True))  # 0: none
    return F.array_join(F.transform(parts, lambda p, i: F.when((first > 0) & (i >= first), shape(p)).otherwise(mask_digits(p))), "/")


def mask_path(path: Column) -> Column:
    """Folder and file name without anything a person wrote: names with a space between both cases of
    letters, or with characters beyond ASCII, keep only their shape."""
    folder, base = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    stem, ext = F.regexp_extract(base, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(base, r"^.+?(\.[^.]*)?$", 1)
    same = F.lower(stem) == F.lower(F.regexp_extract(folder, r"([^/]*)$", 1))
    written = (stem.rlike(r"\s") & stem.rlike("[a-z]") & stem.rlike("[A-Z]")) | stem.rlike(r"[^ -~]")
    shown = F.when(~written | same, mask_digits(stem)).otherwise(shape(stem))
    return F.concat(mask_folder(folder), F.when(folder == "", "").otherwise("/"), shown, F.lower(ext))
