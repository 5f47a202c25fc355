"""Cards of eight tables at once: series, totals, rankings, lists, facts and what is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import cards as cd
from keepsake.tables import read

from .base import query

NOW_MS = 1_735_689_600_000


def _cells(table: DataFrame, table_id: str, row_no: Column, **columns: Column) -> DataFrame:
    one = F.array(*(F.struct(F.lit(i).alias("col_no"), F.lit(n).alias("col_name"), c.cast("string").alias("value")) for i, (n, c) in enumerate(columns.items())))
    return table.select(row_no.cast("long").alias("row_no"), one.alias("cells")).select(F.lit(table_id).alias("table_id"), "row_no", F.inline("cells"))


TITLES = {"events": "Weight", "lines": "Step count", "orders": "Purchases", "nations": "Notes", "regions": "Profile", "device": "Device", "customers": "Customers", "suppliers": "Suppliers"}


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {name: read(spark, sf_dir, name) for name in ("events", "lineitem", "orders", "nation", "region", "supplier", "customer")}
    balance = t["supplier"].agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("cents"))
    parts = [
        _cells(t["events"], "events", F.col("event_id"), time=F.col("ts"), user_id=F.col("user_id"), value=F.col("value"), kind=F.col("event_type")),
        _cells(t["lineitem"], "lines", F.monotonically_increasing_id(), order_key=F.col("l_orderkey"), day=F.col("l_shipdate"), steps=F.col("l_quantity")),
        _cells(t["orders"], "orders", F.col("o_orderkey"), date=F.col("o_orderdate"), price=F.format_number("o_totalprice", 2), currency=F.lit("EUR"), status=F.col("o_orderstatus")),
        _cells(t["nation"], "nations", F.col("n_nationkey"), id=F.col("n_regionkey"), title=F.concat(F.lit('{"x": {"path": "a/b/'), "n_name", F.lit('.txt"}}'))),
        _cells(t["region"], "regions", F.col("r_regionkey"), key=F.col("r_name"), value=F.col("r_regionkey") + 10),
        _cells(balance, "device", F.lit(0), suppliers=F.col("n"), balanceCents=F.col("cents"), active=F.lit("y"), deviceid=F.lit("x")),
        _cells(t["customer"], "customers", F.col("c_custkey"), id=F.col("c_custkey")),
        _cells(t["supplier"], "suppliers", F.col("s_suppkey"), uuid=F.col("s_suppkey")),
    ]
    titles = spark.createDataFrame(list(TITLES.items()), "table_id string, title string")
    return cd.cards(reduce(DataFrame.unionByName, parts), titles, now_ms=NOW_MS)


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long").alias(f"{c}_cents")


CARDS = """
WITH e AS (SELECT count(*) AS rows, count(value) AS n, arg_max(value, {'a': ts, 'b': event_id}) FILTER (value IS NOT NULL) AS last, min(value) AS lo, max(value) AS hi, min(ts) AS since, max(ts) AS until FROM events),
l AS (SELECT count(*) AS n, sum(l_quantity) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_shipdate) AS since, max(l_shipdate) AS until FROM lineitem),
o AS (SELECT count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total, max(o_totalprice) AS hi, min(o_orderdate) AS since, max(o_orderdate) AS until FROM orders),
c AS (
  SELECT 'events' AS table_id, 'series' AS kind, 'Weight' AS title, NULL AS subtitle, 'kg' AS unit, CAST(round(last * 100) AS BIGINT) AS stat_cents, 'latest' AS stat_label, CAST(round(lo * 100) AS BIGINT) AS low_cents, CAST(round(hi * 100) AS BIGINT) AS high_cents, n, rows, NULL AS currency, true AS chart, since, until, 100 AS weight FROM e
  UNION ALL SELECT 'events', 'rank', 'Weight', 'By kind', NULL, NULL, NULL, NULL, NULL, rows, rows, NULL, NULL, since, until, 60 FROM e
  UNION ALL SELECT 'lines', 'series', 'Steps', NULL, 'steps', CAST(round(total * 100) AS BIGINT), 'total', CAST(round(lo * 100) AS BIGINT), CAST(round(hi * 100) AS BIGINT), n, n, NULL, true, since, until, 100 FROM l
  UNION ALL SELECT 'orders', 'money', 'Purchases', NULL, NULL, total, 'total', NULL, CAST(round(hi * 100) AS BIGINT), n, n, 'EUR', NULL, since, until, 90 FROM o
  UNION ALL SELECT 'orders', 'rank', 'Purchases', 'By status', NULL, NULL, NULL, NULL, NULL, n, n, NULL, NULL, since, until, 60 FROM o
  UNION ALL SELECT 'nations', 'list', 'Notes', NULL, NULL, NULL, NULL, NULL, NULL, count(*), count(*), NULL, NULL, NULL, NULL, 40 FROM nation
  UNION ALL SELECT 'regions', 'facts', 'Profile', NULL, NULL, NULL, NULL, NULL, NULL, count(*), count(*), NULL, NULL, NULL, NULL, 70 FROM region
  UNION ALL SELECT 'device', 'facts', 'Device', NULL, NULL, NULL, NULL, NULL, NULL, 3, 1, NULL, NULL, NULL, NULL, 70
  UNION ALL SELECT NULL, 'other', 'Also in this export', NULL, NULL, NULL, NULL, NULL, NULL, 2, 2, NULL, NULL, NULL, NULL, 1)
SELECT table_id, kind, title, subtitle, unit, stat_cents, stat_label, low_cents, high_cents, n, rows, currency, chart, since, until, round(weight + least(30, 12 * log10(greatest(1, n))), 4) AS score FROM c
"""


@query(CARDS)
def cards_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of all eight tables; two that only have ids are one card."""
    made, _ = _made(spark, sf_dir)
    return made.select("table_id", "kind", "title", "subtitle", "unit", _cents("stat"), "stat_label", _cents("low"), _cents("high"), "n", "rows", "currency", "chart", "since", "until", F.round("score", 4).alias("score"))


ITEMS = """
WITH p AS (SELECT 'events' AS table_id, epoch_us(ts) AS t, value AS v FROM events WHERE value IS NOT NULL UNION ALL SELECT 'lines', epoch_us(l_shipdate), l_quantity FROM lineitem),
x AS (SELECT *, min(t) OVER (PARTITION BY table_id) AS t0, max(t) OVER (PARTITION BY table_id) AS t1 FROM p),
b AS (SELECT table_id, least((t - t0) * 60 // (t1 - t0), 59) AS slot, count(*) AS n, min(v) AS lo, max(v) AS hi FROM x GROUP BY ALL)
SELECT table_id, 'series' AS kind, CAST(row_number() OVER (PARTITION BY table_id ORDER BY slot) AS INTEGER) AS place, NULL AS label, NULL AS text, n, CAST(round(lo * 100) AS BIGINT) AS low_cents, CAST(round(hi * 100) AS BIGINT) AS high_cents, NULL AS value_cents FROM b
UNION ALL SELECT 'orders', 'money', CAST(row_number() OVER (ORDER BY y) AS INTEGER), y, NULL, n, NULL, NULL, cents FROM (SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1)
UNION ALL SELECT 'orders', 'rank', place, v, NULL, n, NULL, NULL, NULL FROM (SELECT o_orderstatus AS v, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS INTEGER) AS place FROM orders GROUP BY 1) WHERE place <= 8
UNION ALL SELECT 'events', 'rank', place, v, NULL, n, NULL, NULL, NULL FROM (SELECT event_type AS v, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY 1) WHERE place <= 8
UNION ALL SELECT 'nations', 'list', CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER), n_name, NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'regions', 'facts', CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER), upper(left(r_name, 1)) || lower(substr(r_name, 2)), CAST(r_regionkey + 10 AS VARCHAR), NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT 'device', 'facts', 1, 'Suppliers', CAST(count(*) AS VARCHAR), NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'device', 'facts', 2, 'Balance cents', CAST(CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS VARCHAR), NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'device', 'facts', 3, 'Active', 'Yes', NULL, NULL, NULL, NULL
UNION ALL SELECT 'customers', 'other', NULL, 'Customers', NULL, count(*), NULL, NULL, count(*) * 100 FROM customer
UNION ALL SELECT 'suppliers', 'other', NULL, 'Suppliers', NULL, count(*), NULL, NULL, count(*) * 100 FROM supplier
"""


@query(ITEMS)
def cards_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What those cards show: points, years, bars, things, facts, tables left over."""
    _, items = _made(spark, sf_dir)
    return items.select("table_id", "kind", "place", "label", "text", "n", _cents("low"), _cents("high"), _cents("value")).withColumn("value_cents", F.when(F.col("kind") != "series", F.col("value_cents")))
