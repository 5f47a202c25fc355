"""Browsers, devices and referrers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered ladders of expressions.
BROWSERS = {r"\bEdg/": "Edge", r"\bOPR/|\bOpera/": "Opera", r"\bFirefox/": "Firefox", r"\bChrome/": "Chrome", r"\bSafari/": "Safari"}
APPS = {
    r"(?i)com\.apple\.appstored|^AppStore/|com\.apple\.storekitd": "App Store", "(?i)itunesstored": "iTunes Store",
    r"(?i)com\.apple\.iCloudQuota|icloud": "iCloud", r"(?i)com\.apple\.Preferences": "Settings", r"(?i)com\.apple\.mobilesafari|safari": "Safari",
    r"(?i)com\.apple\.news": "News", r"(?i)com\.apple\.podcasts": "Podcasts", r"(?i)com\.apple\.Music|musicd": "Music", r"(?i)com\.apple\.tv": "TV",
    "(?i)chrome": "Chrome", "(?i)firefox": "Firefox", "(?i)edg[e/]": "Edge",
}
FAMILIES = {"(?i)iPhone": "iPhone", "(?i)iPad": "iPad", "(?i)iPod": "iPod", "(?i)Watch": "Apple Watch", "(?i)Mac": "Mac", "(?i)AppleTV": "Apple TV", "(?i)Android": "Android", "(?i)Windows": "Windows", "(?i)Linux": "Linux"}
LOGIN_FAMILIES = {"(?i)iPhone": "iPhone", "(?i)iPad": "iPad", "(?i)Mac": "Mac", "(?i)Android": "Android", "(?i)Windows": "Windows", "(?i)Linux": "Linux", "(?i)Watch": "Apple Watch", ".": "Other"}
PLACEHOLDER = r"(?i)^(n/?a|null|none|unknown|-)?$"


def first_match(s: Column, ladder: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(s.rlike(p), F.lit(name)) for p, name in ladder.items()))


def browser(agent: Column) -> Column:
    return F.coalesce(first_match(agent, BROWSERS), F.lit("Other"))


def referrer(url: Column, own: str = "") -> Column:
    """Host without www; direct if there is none, it is no URL or the site's own; other if absurd."""
    host = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""))
    return F.when(host.isNull() | (host == "") | (host == own.lower()), "direct").when(F.length(host) > 60, "other").otherwise(host)


def agent_text(agent: Column) -> Column:
    """`App Store on iPhone (iPhone14,2), iOS 17.1`; short plain names and unknown agents stay."""
    s = F.coalesce(agent, F.lit(""))
    model = F.nullif(F.regexp_extract(s, r"model/([A-Za-z0-9,]+)", 1), F.lit(""))
    system = r"(?i)\b(iOS|iPadOS|macOS|watchOS|tvOS|Android)[ /]([0-9._]+)"
    family = first_match(F.coalesce(model, s), FAMILIES)
    where = F.coalesce(F.when(model.isNotNull(), F.concat(family, F.lit(" ("), model, F.lit(")"))), family, model)
    what = F.concat_ws(" on ", first_match(s, APPS), where)
    os = F.when(s.rlike(system), F.concat_ws(" ", F.regexp_extract(s, system, 1), F.regexp_extract(s, system, 2)))
    read = F.concat_ws(", ", F.nullif(what, F.lit("")), os)
    return F.when((F.length(s) < 40) & ~s.rlike("[/;]"), s).when(read == "", s).otherwise(read)


def login_family(agent: Column) -> Column:
    return first_match(F.trim(agent), LOGIN_FAMILIES)
