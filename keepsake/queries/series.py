"""Measures over time. Amounts are added up in hundredths, which is exact in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import numbers, paths, times, units
from keepsake.operators import series as sr
from keepsake.tables import read

from .base import query


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("series"), times.epoch_micros("ts").alias("t"), numbers.cents(F.col("value")).alias("v"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("t", times.day("ts"))
    return e.groupBy(F.col("event_type").alias("series"), "t").agg((F.sum(numbers.cents(F.col("value"))) / F.count("value") / 100).alias("v"))


@query("SELECT h.hour, count(e.ts) AS n FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN events e ON hour(e.ts) = h.hour GROUP BY h.hour")
def hour_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.hour_histogram(read(spark, sf_dir, "events"), "ts")


@query("""
SELECT g.i // 24 AS weekday, g.i % 24 AS hour, count(e.ts) AS n
FROM (SELECT unnest(range(168)) AS i) g LEFT JOIN events e ON dayofweek(e.ts) = g.i // 24 AND hour(e.ts) = g.i % 24 GROUP BY g.i
""")
def weekday_hour_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.week_grid(read(spark, sf_dir, "events"), "ts")


@query("""
WITH h AS (SELECT g.h, count(e.ts) AS n FROM (SELECT unnest(range(24)) AS h) g LEFT JOIN events e ON hour(e.ts) = g.h GROUP BY g.h),
w AS (SELECT l.len, s.h AS start, CAST(sum(h.n) AS BIGINT) AS n FROM (SELECT unnest(range(3, 9)) AS len) l, h s, h WHERE (h.h - s.h + 24) % 24 < l.len GROUP BY ALL),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM h)
SELECT start, len AS hours, n, total, (SELECT h FROM h WHERE n > 0 ORDER BY n, h LIMIT 1) AS quiet_hour FROM w, t ORDER BY n * 24 - len * total DESC, len, start LIMIT 1
""")
def busiest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.busiest_run(read(spark, sf_dir, "events"), "ts")


BUCKET_SQL = """
WITH p AS (SELECT event_type AS series, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events),
x AS (SELECT series, min(t) AS t0, max(t) - min(t) AS span, count(*) AS c FROM p GROUP BY series),
b AS (
  SELECT p.series, CASE WHEN c <= 60 THEN t - t0 WHEN span <= 0 THEN 0 ELSE least((t - t0) * 60 // span, 59) END AS bucket,
    min(CASE WHEN c <= 60 OR span <= 0 THEN t END) AS raw, min(t0) AS t0, min(span) AS span, sum(v) AS s, count(*) AS n, min(v) AS lo, max(v) AS hi
  FROM p JOIN x USING (series) GROUP BY ALL),
k AS (SELECT series, bucket, CAST(coalesce(raw, t0 + span * (2 * bucket + 1) // 120) AS BIGINT) AS t, CAST(s AS DOUBLE) / n AS v, n, lo, hi FROM b)
"""


@query(BUCKET_SQL + "SELECT series, bucket, t, round(v, 6) AS v, n, lo, hi FROM k")
def series_bucket_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.time_buckets(_points(spark, sf_dir), 60).withColumn("v", F.round("v", 6))


@query(BUCKET_SQL + """
, r AS (SELECT series, min(t) AS t0, max(t) - min(t) AS span FROM k GROUP BY series)
SELECT series, CASE WHEN span <= 0 THEN 0 ELSE least((t - t0) * 12 // span, 11) END AS bucket, round(avg(v), 6) AS v, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM k JOIN r USING (series) GROUP BY ALL
""")
def rebucket_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.rebucket(sr.time_buckets(_points(spark, sf_dir), 60), 12).withColumn("v", F.round("v", 6))


@query("""
WITH c AS (SELECT least(greatest((epoch_us(ts) - 1704067200000000) * 210 // 2592000000000, 0), 209) AS slot, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT max(n) AS top FROM c)
SELECT slot, n, CAST(CASE WHEN n / top > 0.66 THEN 4 WHEN n / top > 0.33 THEN 3 WHEN n / top > 0.12 THEN 2 ELSE 1 END AS BIGINT) AS strength FROM c, m
""")
def density_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January 2024 in 210 slots."""
    return sr.density(_points(spark, sf_dir), 1_704_067_200_000_000, 1_704_067_200_000_000 + 30 * 86_400_000_000)


@query("""
WITH p AS (SELECT event_type AS series, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT series, event_id FROM p WHERE i % CAST(ceil(c / 150) AS BIGINT) = 0
""")
def point_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("at", F.struct("t", "event_id"))
    return sr.thin(p, 150, "series", "at").select("series", "event_id")


@query("""
SELECT event_type AS series, CASE event_type WHEN 'purchase' THEN 'sum' WHEN 'view' THEN 'mean' WHEN 'click' THEN 'last' ELSE 'count' END AS agg,
  round(CASE event_type WHEN 'purchase' THEN CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) WHEN 'view' THEN CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*)
    WHEN 'click' THEN CAST(arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) END, 6) AS value, count(*) AS n
FROM events GROUP BY event_type
""")
def series_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("series") == "purchase", "sum").when(F.col("series") == "view", "mean").when(F.col("series") == "click", "last").otherwise("count")
    p = _points(spark, sf_dir).withColumn("t", F.struct("t", "event_id"))
    return sr.headline(p, rule).withColumn("value", F.round("value", 6))


TREND_SQL = """
WITH d AS (SELECT event_type AS series, strftime(ts, '%Y-%m-%d') AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS v FROM events GROUP BY ALL),
p AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY t) AS i FROM d),
k AS (SELECT *, greatest(2, floor(n / 6 + 0.5)) AS k FROM p),
e AS (SELECT series, max(n) AS n, avg(CASE WHEN i <= k THEN v END) AS "start", avg(CASE WHEN i > n - k THEN v END) AS "end" FROM k GROUP BY series),
r AS (SELECT *, ("end" - "start") / abs("start") * 100 AS pct FROM e WHERE n >= 8 AND "start" <> 0)
"""


@query(TREND_SQL + 'SELECT series, n, round("start", 6) AS "start", round("end", 6) AS "end", round(pct, 6) AS pct, abs(pct) < 3 AS steady FROM r')
def trend_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.trend(_daily(spark, sf_dir)).select("series", "n", *(F.round(c, 6).alias(c) for c in ("start", "end", "pct")), "steady")


@query(TREND_SQL + "SELECT series, round(pct, 6) AS pct FROM r WHERE abs(pct) >= 3 ORDER BY abs(pct) DESC, series LIMIT 3")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.movers(sr.trend(_daily(spark, sf_dir))).select("series", F.round("pct", 6).alias("pct"))


@query(TREND_SQL + "SELECT series, round(avg(v), 6) AS v, count(*) AS n FROM p WHERE i > n - 10 GROUP BY series")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.recent_mean(_daily(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total, CAST(max(round(o_totalprice * 100)) AS BIGINT) AS most FROM orders GROUP BY ALL")
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.per_period(read(spark, sf_dir, "orders"), times.month("o_orderdate"), "month", numbers.cents(F.col("o_totalprice")))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total, CAST(max(round(o_totalprice * 100)) AS BIGINT) AS most FROM orders WHERE o_totalprice > 0 GROUP BY ALL")
def per_year_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 0")
    return sr.per_period(orders, F.year("o_orderdate").cast("long"), "year", numbers.cents(F.col("o_totalprice")))


@query("""
SELECT event_type AS type, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN event_type IN ('purchase', 'click') THEN CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) ELSE CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) END AS value, count(*) AS n
FROM events GROUP BY 1, 2
""")
def health_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: purchases and clicks add up, the others are averaged."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("ts").alias("at"), numbers.cents(F.col("value")).alias("value"))
    return sr.health_days(e, ["purchase", "click"])


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, series, value FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price, l_discount AS rate FROM lineitem) UNPIVOT (value FOR series IN (quantity, price, rate))
""")
def wide_unpivot_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of average, max and min columns of one measure the average is taken."""
    li = read(spark, sf_dir, "lineitem")
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    wide = li.select(*ids, F.col("l_quantity").alias("average quantity"), (F.col("l_quantity") * 2).alias("max quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("min rate"), F.col("l_discount").alias("average rate"))
    return sr.unpivot_best(wide, ids, ["max quantity", "average quantity", "price", "min rate", "average rate"])


@query("""
WITH s AS (SELECT o_orderpriority AS kind, o_orderstatus AS series, count(*) AS n FROM orders GROUP BY ALL)
SELECT kind, series, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, series) AS r FROM s) WHERE r = 1
""")
def best_series_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("series"))
    return sr.best_series(o)


@query("""
WITH m AS (SELECT l_returnflag AS part, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM lineitem GROUP BY ALL)
SELECT part, round(mean, 6) AS mean, round(mean * 100 / sum(mean) OVER (), 6) AS share FROM m
""")
def composition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return sr.composition(li, "l_returnflag", "q").select(F.col("l_returnflag").alias("part"), F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"))


@query("SELECT event_type AS source, count(*) AS n FROM events GROUP BY ALL")
def readings_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT x, y, count(*) AS n, min(vec_id) AS first FROM (
  SELECT vec_id, CAST(floor((CAST(embedding[1] AS DOUBLE) * 180 + 180) / 360 * 1000 + 0.5) AS BIGINT) AS x, CAST(floor((90 - CAST(embedding[2] AS DOUBLE) * 90) / 180 * 500 + 0.5) AS BIGINT) AS y FROM embeddings) GROUP BY ALL
""")
def geo_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components as longitude and latitude, on a map of 1000 x 500 points."""
    from keepsake.operators.places import bins

    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.get("embedding", F.lit(0)).cast("double") * 180).alias("lon"), (F.get("embedding", F.lit(1)).cast("double") * 90).alias("lat"))
    return bins(e, order="vec_id")


@query("""
WITH k AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' heart_rate' WHEN 1 THEN ' step count' WHEN 2 THEN ' weight' ELSE ' thing' END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bpm' WHEN 1 THEN 'steps' WHEN 2 THEN 'kg' END AS unit, CASE p_partkey % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'sum' WHEN 2 THEN 'last' END AS agg FROM k
""")
def unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, [" heart_rate", " step count", " weight", " thing"])), (F.col("p_partkey") % 4).cast("int"))
    named = read(spark, sf_dir, "part").select("p_partkey", units.unit_of(F.concat("p_name", ending)).alias("u"))
    return named.select("p_partkey", "u.unit", "u.agg")


@query("SELECT CASE WHEN p_size < 10 THEN 'photos' WHEN p_size < 20 THEN 'videos' WHEN p_size < 30 THEN 'audio' WHEN p_size < 40 THEN 'records' ELSE 'other' END AS category, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY ALL")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files whose extension goes by their size."""
    ext = F.when(F.col("p_size") < 10, "JPG").when(F.col("p_size") < 20, "mov").when(F.col("p_size") < 30, "mp3").when(F.col("p_size") < 40, "csv").otherwise("xyz")
    files = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit("."), ext).alias("path"), "p_size")
    return files.groupBy(paths.category(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("bytes"))
