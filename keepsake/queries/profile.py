"""Column profiles and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import names, numbers
from keepsake.operators import profile as pf
from keepsake.tables import read

from .base import query

PROFILE_SQL = r"""
WITH w AS (SELECT {casts} FROM {table}),
c AS (SELECT name, value FROM w UNPIVOT INCLUDE NULLS (value FOR name IN ({names}))),
v AS (SELECT name, CASE WHEN trim(value) <> '' THEN value END AS v FROM c),
x AS (
  SELECT name, v,
    regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}') AND try_cast(left(v, 19) AS TIMESTAMP) IS NOT NULL OR regexp_matches(v, '^\d{{8}}$') AND try_strptime(v, '%Y%m%d') IS NOT NULL AS d,
    regexp_matches(v, '^\s*([A-Z]{{3}})?\s*[$£€¥₩₹]?\s*(-?[\d.,]+)\s*([A-Z]{{3}})?\s*$') AND regexp_matches(v, '\d') AS k,
    CASE WHEN regexp_matches(v, '^-?[\d.]+$') THEN try_cast(v AS DOUBLE) END AS n
  FROM v),
g AS (
  SELECT name, count(v) AS filled, count(DISTINCT v) AS seen, count(*) FILTER (d) AS dates, count(*) FILTER (k) AS numeric_, min(n) AS least, max(n) AS most, CAST(sum(CAST(round(n * 100) AS BIGINT)) AS BIGINT) AS total
  FROM x GROUP BY name),
t AS (
  SELECT *, CASE WHEN filled = 0 THEN 'empty' WHEN regexp_matches(name, '(?i)key$|^id$| id$|hash|token') THEN 'id' WHEN dates > 0.7 * filled THEN 'date'
    WHEN numeric_ > 0.8 * filled THEN CASE WHEN regexp_matches(name, '(?i)price|amount') THEN 'money' ELSE 'number' END
    WHEN seen > 1 AND seen <= greatest(2, filled / 3) AND seen <= 40 THEN 'category' WHEN regexp_matches(name, '(?i)name|title') THEN 'title' ELSE 'text' END AS type
  FROM g)
SELECT name AS col_name, filled, least(seen, 401) AS "distinct", type, CASE WHEN type IN ('money', 'number') THEN least END AS least, CASE WHEN type IN ('money', 'number') THEN most END AS most,
  CASE WHEN type IN ('money', 'number') THEN total END AS total_cents FROM t
"""


def _sql(table: str, cols: list[str]) -> str:
    return PROFILE_SQL.format(table=table, casts=", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols), names=", ".join(cols))


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _profiled(spark: SparkSession, sf_dir: str, table: str, cols: list[str]) -> DataFrame:
    p = pf.column_profile(pf.cells(read(spark, sf_dir, table), table, cols), now_ms=1_735_689_600_000)
    return p.select("col_name", "filled", "distinct", "type", "least", "most", F.round(F.col("total") * 100).cast("long").alias("total_cents"))


@query(_sql("lineitem", LINE))
def column_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir, "lineitem", LINE)


@query(_sql("part", PART))
def column_profile_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir, "part", PART)


@query("""
SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents, max(o_totalprice) AS most, count(*) AS n, false AS micros, 'EUR' AS currency FROM orders WHERE o_totalprice > 0
""")
def money_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written with a currency code."""
    cell = F.concat(F.format_number("o_totalprice", 2), F.lit(" EUR"))
    card = pf.money_card(read(spark, sf_dir, "orders"), numbers.to_number(cell), numbers.currency_code(cell))
    return card.select(F.round(F.col("total") * 100).cast("long").alias("total_cents"), "most", "n", "micros", "currency")


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 8")
def rank_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.rank_card(read(spark, sf_dir, "part"), "p_type")


@query("SELECT trim(p_brand) AS value, count(*) AS n FROM part WHERE trim(p_brand) <> '' GROUP BY 1")
def tally_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.tally(read(spark, sf_dir, "part"), "p_brand")


@query("""
SELECT * FROM (VALUES ('part', 'money', 'p_retailprice', 'p_brand'), ('orders', 'money', 'o_totalprice', 'o_orderstatus'), ('events', 'series', NULL, 'event_type')) v(table_id, kind, money_col, rank_col)
""")
def table_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card that suits each of three tables; all columns of all of them in one profile."""
    tables = {"part": PART, "orders": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "events": ["event_id", "ts", "event_type", "value"]}
    long, rows = None, None
    for name, cols in tables.items():
        t = read(spark, sf_dir, name)
        one = pf.cells(t, name, cols)
        size = t.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_id", F.lit(name))
        long, rows = (one, size) if long is None else (long.unionByName(one), rows.unionByName(size))
    return pf.table_plan(pf.column_profile(long, now_ms=1_735_689_600_000), rows).select("table_id", "kind", "money_col", "rank_col")


@query(r"""
SELECT p_partkey, upper(left(replace(p_name, '_', ' '), 1)) || substr(replace(p_name, '_', ' '), 2) || ' ID' AS shown, CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS answer FROM part
""")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("SBR@"), F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))), F.lit("_ID"))
    answer = F.when(F.col("p_size") % 2 == 0, "y").otherwise("FALSE")
    return read(spark, sf_dir, "part").select("p_partkey", names.nice_column(raw).alias("shown"), names.nice_value(F.lit("active"), answer).alias("answer"))


@query("SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents, count(*) AS n, true AS micros, CAST(NULL AS VARCHAR) AS currency FROM orders WHERE o_totalprice > 0")
def money_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals in millionths, which the card finds out; two currencies, so none is named."""
    millionths = numbers.cents(F.col("o_totalprice")) * 10_000
    code = F.when(F.col("o_orderkey") % 2 == 0, "EUR").otherwise("NOK")
    card = pf.money_card(read(spark, sf_dir, "orders"), millionths, code)
    return card.select(F.round(F.col("total") * 100).cast("long").alias("total_cents"), "n", "micros", "currency")
