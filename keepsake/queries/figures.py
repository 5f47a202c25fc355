"""Figures about a whole library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import insights, merge
from keepsake.tables import read

from .base import query


def _cells(rows: DataFrame, source: Column, table: Column, row_no: Column, **columns: Column) -> DataFrame:
    one = F.array(*(F.struct(F.lit(i).alias("col_no"), F.lit(n.replace("_", " ")).alias("col_name"), c.cast("string").alias("value")) for i, (n, c) in enumerate(columns.items())))
    return rows.select(source.cast("int").alias("source_id"), table.alias("table_id"), F.lit(None).cast("string").alias("title"), row_no.cast("long").alias("row_no"), F.inline(one))


@query("""
SELECT * FROM (SELECT 'events' AS figure, count(*) AS n FROM events UNION ALL SELECT 'messages', count(*) FROM conversations UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'media', count(*) FROM part UNION ALL SELECT 'tables', count(DISTINCT c_nationkey) * 2 FROM customer)
""")
def library_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = read(spark, sf_dir, "conversations").select(F.lit(0).alias("source_id"), F.col("conv_id").cast("string").alias("thread"))
    c = read(spark, sf_dir, "customer").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = _cells(c, F.col("s"), F.format_string("t%d", "c_nationkey"), F.col("c_custkey"), a=F.col("c_name"))
    return insights.figures({"events": read(spark, sf_dir, "events"), "messages": talks, "media": read(spark, sf_dir, "part"), "cells": cells})


@query("""
WITH d AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN 'None' ELSE 'Bergen' END AS place, CASE user_id % 4 WHEN 0 THEN 'iPhone' WHEN 1 THEN 'Mac' WHEN 2 THEN 'Other' END AS device FROM events)
SELECT 'place' AS part, place AS label, count(*) AS n FROM d WHERE place IN ('Oslo', 'Bergen') GROUP BY ALL UNION ALL SELECT 'device', device, count(*) FROM d WHERE device IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'time', strftime(ts, '%Y-%m-%d'), count(*) FROM d GROUP BY ALL
""")
def sign_in_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sign-ins of two tables, with a second column that tells devices and doesn't count."""
    e = read(spark, sf_dir, "events")
    place = F.get(F.array(*map(F.lit, ["Oslo", "n/a", "", "None", "Bergen"])), (F.col("event_id") % 5).cast("int"))
    agent = F.get(F.array(*map(F.lit, ["Mozilla (iPhone; U)", " Macintosh ", "curl/8", ""])), (F.col("user_id") % 4).cast("int"))
    return insights.sign_ins(_cells(e, F.lit(0), F.format_string("logins %d", F.col("event_id") % 2), F.col("event_id"), Login_time=F.col("ts"), City=place, User_agent=agent, Device_model=F.lit("iPad")))


@query("SELECT CAST(0 AS INTEGER) AS source_id, 'posts' || user_id % 3 || '.csv' AS table_id, count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY ALL")
def address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts, one in four with an address."""
    e = read(spark, sf_dir, "events")
    return insights.address_rows(_cells(e, F.lit(0), F.format_string("posts%d.csv", F.col("user_id") % 3), F.col("event_id"), id=F.col("event_id"), ip=F.when(F.col("event_id") % 4 == 0, "10.0.0.1").otherwise(" "), zip=F.lit("1")))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'posts' ELSE 'comments' END AS kind, count(*) AS n, count(DISTINCT user_id % 3) AS tables FROM events WHERE user_id % 3 < 2 GROUP BY ALL")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts, comments and what is neither."""
    e = read(spark, sf_dir, "events")
    name = F.get(F.array(*map(F.lit, ["a/posts.csv", "a/comments.csv", "a/posts/else.csv"])), (F.col("user_id") % 3).cast("int"))
    return insights.kinds(_cells(e, F.lit(0), name, F.col("event_id"), id=F.col("event_id"), x=F.lit(None)), {"(?i)^posts": "posts", "(?i)^comments": "comments"})


@query("""
SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'google' ELSE 'other' END AS provider, arg_min(s_name, {'a': s_nationkey, 'b': s_suppkey}) AS name, CAST(arg_min('@' || s_suppkey, {'a': s_nationkey, 'b': s_suppkey}) FILTER (s_suppkey % 3 = 0) AS VARCHAR) AS handle FROM supplier GROUP BY ALL
""")
def channel_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as channels' tables; the first by source and table names its provider."""
    s = read(spark, sf_dir, "supplier")
    rows = s.withColumn("row", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = _cells(rows, F.col("s_nationkey"), F.format_string("t%09d", "s_suppkey"), F.col("row"), Channel_Title_1=F.when(F.col("row") == 0, F.col("s_name")).otherwise("no"), Vanity_URL=F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("@"), F.col("s_suppkey").cast("string"))).otherwise(""))
    provider = s.select(F.col("s_nationkey").cast("int").alias("source_id"), F.when(F.col("s_nationkey") % 2 == 0, "google").otherwise("other").alias("provider")).distinct()
    return insights.identity(cells, provider)


@query("SELECT CAST(c_nationkey AS INTEGER) AS source_id, CAST(c_custkey AS VARCHAR) AS table_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unclaimed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables, those with orders as ones that a view has taken."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("source_id"), "c_custkey")
    tables = c.select("source_id", F.col("c_custkey").cast("string").alias("table_id"))
    claimed = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey").select("source_id", F.col("c_custkey").cast("string").alias("table_id"))
    return insights.unclaimed(tables, claimed)


@query("SELECT p_name || p_partkey AS topic FROM part WHERE p_size % 3 = 0 OR p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)")
def topics_applying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as topics for their brand or for all; the brands of parts of one size are the services there."""
    p = read(spark, sf_dir, "part")
    topics = p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("topic"), F.when(F.col("p_size") % 3 != 0, F.array(F.col("p_brand"), F.lit("x"))).alias("only"))
    return insights.applicable(topics, p.where("p_size = 7").select(F.col("p_brand").alias("provider")))


@query("SELECT CAST(c_nationkey AS INTEGER) AS source_id, count(*) AS files, CAST(sum(c_custkey) AS BIGINT) AS bytes, count(DISTINCT c_mktsegment) AS folders FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL")
def audio_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, every other a recording, a folder a segment."""
    c = read(spark, sf_dir, "customer")
    path = F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".M4A").otherwise(".txt"))
    return insights.audio(c.select(F.col("c_nationkey").cast("int").alias("source_id"), path.alias("path"), F.col("c_custkey").alias("size")))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 97 + 1 AS w, p_size + 1 AS h, p_size % 5 AS ow, p_partkey % 7 + 1 AS oh FROM part), s AS (SELECT *, least(w / ow, h / oh) AS scale FROM p WHERE ow > 0)
SELECT p_partkey, round((w - ow * scale) / 2, 6) AS x, round((h - oh * scale) / 2, 6) AS y, round(ow * scale, 6) AS width, round(oh * scale, 6) AS height FROM p LEFT JOIN s USING (p_partkey, w, h, ow, oh)
""")
def overlay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    at = insights.fitted(F.col("p_partkey") % 97 + 1, F.col("p_size") + 1, F.col("p_size") % 5, F.col("p_partkey") % 7 + 1)
    return p.withColumn("at", at).select("p_partkey", *(F.round(F.col(f"at.{c}"), 6).alias(c) for c in ("x", "y", "width", "height")))


@query("""
WITH p AS (SELECT c_nationkey % 2 AS source_id, 0 AS page, c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_nationkey % 2, 1, c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 > 0),
d AS (SELECT source_id, c_name, c_mktsegment, min({'page': page, 'row': c_custkey}) AS k FROM p GROUP BY ALL)
SELECT CAST(source_id AS INTEGER) AS source_id, 'items.csv#1' AS table_id, CAST(k.page * 1099511627776 + k.row AS BIGINT) AS row_no, c_name AS name, c_mktsegment AS segment FROM d
UNION ALL SELECT CAST(c_nationkey % 2 AS INTEGER), 'lone (2).csv#1', c_custkey, c_name, 'same' FROM customer
""")
def paged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells of two overlapping pages in two sources, and of a table that has one page."""
    c, t = read(spark, sf_dir, "customer"), F.lit
    source, row = F.col("c_nationkey") % 2, F.col("c_custkey")
    both = lambda rows, table: _cells(rows, source, t(table), row, name=F.col("c_name"), segment=F.col("c_mktsegment"))
    lone = _cells(c, source, t("lone (2).csv#1"), row, name=F.col("c_name"), segment=t("same"))
    merged = merge.merge_cells(both(c.where("c_custkey % 3 < 2"), "items.csv#1").unionByName(both(c.where("c_custkey % 3 > 0"), "items (1).csv#1")).unionByName(lone))
    of = lambda n: F.max(F.when(F.col("col_name") == n, F.col("value"))).alias(n)
    return merged.groupBy("source_id", "table_id", "row_no").agg(of("name"), of("segment"))
