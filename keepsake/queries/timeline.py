"""Timeline queries over the events table, taken as a library: clicks and views are messages of a
user's thread, sign-ups are photos, purchases are places, errors are events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import times
from keepsake.operators import timeline as tl
from keepsake.tables import read

from .base import query

ITEMS_SQL = """
WITH e AS (SELECT *, 'u' || (user_id % 5) AS src, strftime(ts, '%Y-%m-%d') AS day FROM events),
items AS (
  SELECT max(ts) AS t, 'chat' AS type, 'user ' || user_id AS title, src AS source, day, count(*) AS n FROM e WHERE event_type IN ('click', 'view') GROUP BY src, user_id, day
  UNION ALL SELECT max(ts), 'place', 'places', src, day, count(*) FROM e WHERE event_type = 'purchase' GROUP BY src, day
  UNION ALL SELECT ts, 'photo', props, src, day, 1 FROM e WHERE event_type = 'signup'
  UNION ALL SELECT ts, 'event', props, src, day, 1 FROM e WHERE event_type = 'error')
"""


def library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("source"), F.col("ts").alias("at"), "event_type", "user_id", "props")
    of = lambda *kinds: e.where(F.col("event_type").isin(*kinds))
    thread = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return {
        "messages": of("click", "view").select("source", "at", thread.alias("thread")),
        "places": of("purchase").select("source", "at"),
        "media": of("signup").select("source", "at", F.lit("photo").alias("kind"), F.col("props").alias("title")),
        "events": of("error").select("source", "at", F.lit("record").alias("kind"), F.col("props").alias("title")),
    }


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.timeline(**library(spark, sf_dir))


@query(ITEMS_SQL + "SELECT epoch_us(t) AS at_us, type, title, source, day, n AS records FROM items")
def timeline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(times.epoch_micros("at").alias("at_us"), "type", "title", "source", "day", F.col("count").alias("records"))


@query(ITEMS_SQL + "SELECT day, count(*) AS items, CAST(sum(n) AS BIGINT) AS records, epoch_us(max(t)) AS last_us FROM items GROUP BY day")
def timeline_day_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.day_groups(items(spark, sf_dir)).select("day", "items", "records", times.epoch_micros("last").alias("last_us")).orderBy("day")


@query(ITEMS_SQL + "SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS records, count(DISTINCT source) AS sources, count(DISTINCT type) AS types, min(day) AS first_day, max(day) AS last_day FROM items")
def timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.stats(items(spark, sf_dir))


@query(
    "SELECT month, count(*) AS items FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders) GROUP BY month"
)
def month_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month; those pending count as undated."""
    dated = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"))
    return tl.month_groups(dated)


@query(
    "SELECT event_id, 'u' || (user_id % 5) AS source FROM events WHERE NOT ('u' || (user_id % 5)) IN ('u1', 'u3') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"
)
def scoped_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources off, two weeks, both days included."""
    e = read(spark, sf_dir, "events").withColumn("source", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))
    return tl.scope(e, ["u1", "u3"], "2024-01-05", "2024-01-19", at="ts").select("event_id", "source")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)")
def date_preset_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.preset(read(spark, sf_dir, "orders"), "30d", "o_orderdate").select("o_orderkey", times.day("o_orderdate").alias("day"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(coalesce(text, '')), 'street') OR contains(lower(coalesce(source, '')), 'street') OR contains(lower(coalesce(text, '')), 'the with') ")
def free_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return tl.search(docs, "Street", ["text", "source"]).unionByName(tl.search(docs, "the with", ["text"])).select("doc_id", "source").distinct()


@query("SELECT url, length(html) AS size FROM pages WHERE contains(lower(url), 'example.com') ORDER BY size DESC, url LIMIT 500")
def file_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("url", F.length("html").cast("long").alias("size"))
    return tl.largest(pages, "Example.com", "url", "size")


@query("""
WITH m AS (SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS m FROM orders),
s AS (SELECT max(m) AS hi, max(m) - min(m) + 1 AS span FROM m),
t AS (SELECT hi, (SELECT min(x) FROM (VALUES (1), (2), (3), (6), (12), (24), (60)) v(x) WHERE ceil(span / x) <= 24) AS step FROM s)
SELECT CAST((hi - m) // step AS BIGINT) AS mark, CAST(step AS BIGINT) AS step, CAST((hi - (hi - m) // step * step) // 12 AS BIGINT) AS year, CAST((hi - (hi - m) // step * step) % 12 + 1 AS BIGINT) AS month,
  count(*) AS anchors, min(o_orderkey) AS first
FROM m, t GROUP BY ALL
""")
def adaptive_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.rail_marks(read(spark, sf_dir, "orders"), 24, "o_orderdate", "o_orderkey")
