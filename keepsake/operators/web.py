"""Saved web pages and page views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import web

#: Fixed value: paths that count as page views.
ALLOWED = r"^/(?:index\.html|guides\.html|pricing\.html|privacy\.html|404\.html|guides/[a-z0-9-]{1,60}\.html|)$"


def page_facts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Title, links and host of saved pages, by expressions."""
    doc = F.col(html)
    hrefs = F.regexp_extract_all(doc, F.lit(r'<a [^>]*href="([^"]*)"'), 1)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return pages.withColumns({"title": F.regexp_extract(doc, r"<title>([^<]*)</title>", 1), "n_links": F.size(hrefs).cast("long"), "n_inner": F.size(F.filter(hrefs, lambda h: h.startswith("/"))).cast("long"), "host": host})


def repeated_phrases(rows: DataFrame, phrase: str, longest: int = 80, top: int = 8) -> DataFrame:
    """The phrases of at most `longest` characters that occur more than once, whatever the case."""
    text = F.lower(F.trim(phrase))
    counted = rows.select(text.alias("phrase")).where((F.col("phrase") != "") & (F.length("phrase") <= longest)).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").orderBy(F.desc("n"), "phrase").limit(top)


def valid_views(views: DataFrame, own: str = "") -> DataFrame:
    """views(path, referrer, agent, country): those of real pages, with browser and referring host only."""
    country = F.when(F.col("country").rlike("^[A-Z]{2}$"), F.col("country")).otherwise("??")
    return views.where(F.col("path").rlike(ALLOWED)).withColumns({"browser": web.browser(F.col("agent")), "referrer": web.referrer(F.col("referrer"), own), "country": country, "mobile": F.col("agent").rlike(r"Mobi")})


def counters(views: DataFrame, day: str, dims: list[str]) -> DataFrame:
    """(day, dim, value, n): all views (dim `views`), and views by each dimension, in one pass."""
    keys = F.array(F.struct(F.lit("views").alias("dim"), F.lit("").alias("value")), *(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))
    return views.select(F.col(day).alias("day"), F.inline(keys)).groupBy("day", "dim", "value").agg(F.count(F.lit(1)).alias("n"))
