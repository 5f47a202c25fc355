"""Exports that come one after the other, and states that later changes win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.streaming import counters
from keepsake.streaming import library as lb
from keepsake.tables import read, scratch_path

from .base import query


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of downloads, a language each; contents and sizes tell them apart."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha"), F.nullif("n_chars", F.lit(0)).alias("size"))


def _appended(spark: SparkSession, sf_dir: str) -> str:
    """Two exports: the even documents first, then all of them."""
    entries = _entries(spark, sf_dir)
    inbox, (table, checkpoint) = scratch_path(spark, "inbox"), lb.folder(spark)
    for part in (entries.where("doc_id % 2 = 0"), entries):
        part.write.mode("append").parquet(inbox)
        lb.append(counters.event_stream(spark, inbox, entries.schema), table, checkpoint, ["lang", "sha", "size"], ["source", "doc_id"])
    return table


FIRST = """
WITH d AS (SELECT doc_id, lang, source, sha256(text) AS sha, nullif(n_chars, 0) AS size FROM documents),
b AS (SELECT *, 0 AS batch FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT *, 1 FROM d),
f AS (SELECT doc_id, lang, batch, source, sha, size FROM b WHERE lang IS NOT NULL AND sha IS NOT NULL AND size IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, sha, size ORDER BY batch, source, doc_id) = 1
  UNION ALL SELECT doc_id, lang, batch, source, sha, size FROM b WHERE lang IS NULL OR sha IS NULL OR size IS NULL)
"""


@query(FIRST + "SELECT doc_id, lang, CAST(batch AS BIGINT) AS batch FROM f")
def append_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of two exports brought to the library."""
    return lb.library(spark, _appended(spark, sf_dir)).select("doc_id", "lang", "batch")


@query(
    FIRST
    + """, n AS (SELECT source, max(batch) AS last FROM f GROUP BY source)
SELECT doc_id, f.source, CAST(batch AS BIGINT) AS batch FROM f JOIN n ON f.source IS NOT DISTINCT FROM n.source WHERE batch = last OR size IS NULL
  OR NOT EXISTS (SELECT 1 FROM f g WHERE g.source = f.source AND g.batch = n.last AND g.size = f.size)"""
)
def append_supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as providers: an entry of an older export stays where the newest has none of its size."""
    return lb.current(spark, _appended(spark, sf_dir), ["size"], "source").select("doc_id", "source", F.col("batch"))


@query("""
WITH RECURSIVE c AS (SELECT o_custkey AS node, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey - 1 - o_orderkey % 5 END AS parent FROM orders),
l AS (SELECT node, parent FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY o_orderkey DESC) = 1),
e AS (SELECT l.node, p.node AS parent FROM l LEFT JOIN l p ON p.node = l.parent),
r AS (SELECT node, node AS top, 0 AS depth FROM e UNION ALL SELECT r.node, e.parent, depth + 1 FROM r JOIN e ON e.node = r.top WHERE e.parent IS NOT NULL)
SELECT node, arg_max(top, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM r GROUP BY node
""")
def alias_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of a link from their customer to an earlier one, or of its end; the later half comes
    first. The last by order holds, and chains of links are followed to their root."""
    o = read(spark, sf_dir, "orders")
    changes = o.select(F.col("o_custkey").alias("node"), "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") - 1 - F.col("o_orderkey") % 5).alias("parent"))
    inbox, (table, checkpoint) = scratch_path(spark, "inbox"), lb.folder(spark)
    for part in (changes.where("o_orderkey % 2 = 1"), changes.where("o_orderkey % 2 = 0")):
        part.write.mode("append").parquet(inbox)
        lb.run_states(counters.event_stream(spark, inbox, changes.schema), table, checkpoint, "node", ["o_orderkey"])
    return lb.people(lb.states(spark, table, "node"))


@query("""
WITH own AS (SELECT c_custkey AS key, c_mktsegment AS verdict FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS key, 'drop' AS verdict FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(o.key, n.key) AS key, coalesce(n.verdict, o.verdict) AS verdict FROM own o FULL JOIN new n ON o.key = n.key
""")
def imported_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions about customers, some of them replaced by imported ones."""
    c = read(spark, sf_dir, "customer")
    own = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("verdict"))
    return lb.import_states(own, c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"), F.lit("drop").alias("verdict")), "key")
