"""Duplicates over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import duplicates as dp
from keepsake.operators import merge
from keepsake.tables import read

from .base import query


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"))


GROUPS = "SELECT sha256(text) AS sha, n_chars, count(*) AS n, min(doc_id) AS first, (count(*) - 1) * n_chars AS reclaimable FROM documents WHERE text IS NOT NULL AND n_chars > 0 GROUP BY 1, 2 HAVING count(*) > 1"


@query(GROUPS)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dp.exact_groups(_hashed(spark, sf_dir), ["sha"], "n_chars", "doc_id")


@query(f"SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS files, CAST(sum(reclaimable) AS BIGINT) AS bytes FROM ({GROUPS})")
def dup_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dp.duplicate_totals(dp.exact_groups(_hashed(spark, sf_dir), ["sha"], "n_chars", "doc_id"))


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS sha, n_chars FROM documents WHERE text IS NOT NULL AND n_chars > 0),
g AS (SELECT sha, n_chars, min(doc_id) AS first FROM h GROUP BY ALL HAVING count(*) > 1)
SELECT d.doc_id, g.sha AS sha256, coalesce(d.doc_id > g.first, false) AS duplicate FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN g ON h.sha = g.sha AND h.n_chars = g.n_chars
""")
def three_stage_dup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return dp.three_stage(docs, F.col("text"), "n_chars", "doc_id").select("doc_id", "sha256", "duplicate")


@query("""
SELECT doc_id, sha FROM (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r <= 2
""")
def keep_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two of each content."""
    return dp.keep_in_groups(_hashed(spark, sf_dir), "sha", [F.desc("n_chars"), F.asc("doc_id")], 2).select("doc_id", "sha")


@query("""
WITH h AS (SELECT doc_id, lang, source, sha256(text) AS sha, n_chars FROM documents),
l AS (SELECT lang, max(source) AS last FROM h GROUP BY lang),
m AS (SELECT h.*, source = last AS newest FROM h JOIN l USING (lang))
SELECT doc_id, lang, newest FROM m a WHERE newest OR sha IS NULL OR NOT EXISTS (SELECT 1 FROM m b WHERE b.newest AND a.lang = b.lang AND a.sha = b.sha AND a.n_chars = b.n_chars)
""")
def supersede_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as providers, sources as their downloads."""
    return dp.superseded(_hashed(spark, sf_dir), ["sha", "n_chars"], "lang", "source").select("doc_id", "lang", "newest")


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, sha256(text), n_chars ORDER BY source, doc_id) AS r FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL) WHERE r = 1
UNION ALL SELECT doc_id, lang FROM documents WHERE text IS NULL OR lang IS NULL OR n_chars IS NULL
""")
def cross_part_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as downloads, sources as their parts."""
    return dp.first_of_parts(_hashed(spark, sf_dir), ["lang", "sha", "n_chars"], ["source", "doc_id"]).select("doc_id", "lang")


@query("""
SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
""")
def paged_table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in three overlapping pages, merged."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    pages = {"items": li.where("l_quantity <= 20"), "items (1)": li.where("l_quantity BETWEEN 15 AND 35"), "items (2)": li.where("l_quantity >= 30")}
    return merge.merge_pages(pages)["items"]


PRINTS = """
WITH f AS (
  SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i] > embedding[i + 1] THEN (1::UBIGINT << (i - 1)::UBIGINT)::BIGINT ELSE 0 END FOR i IN range(1, 64)]) AS BIGINT) AS bits,
    list_avg(embedding::DOUBLE[]) AS mean, list_stddev_pop(embedding::DOUBLE[]) AS sd FROM embeddings)
"""
NEAR = PRINTS + "SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance FROM f a JOIN f b ON a.vec_id < b.vec_id AND a.sd >= 0.1 AND b.sd >= 0.1 AND abs(a.mean - b.mean) <= 0.05 AND bit_count(xor(a.bits, b.bits)) <= 16"


def _near(spark: SparkSession, sf_dir: str, distance: int = 16) -> DataFrame:
    """Distance and gates are those that suit these vectors; pictures take the defaults."""
    prints = dp.fingerprints(read(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    return dp.near_pairs(prints, "vec_id", distance, 0.1, 0.05, width=63)


@query(NEAR)
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)


@query()
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups around seeds in order of id, over pairs within 20 bits."""
    return dp.near_groups(_near(spark, sf_dir, 20)).select(F.col("node").alias("vec_id"), "seed")


@query()
def lookalike_minus_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of alike vectors without those that have an exact double."""
    e = read(spark, sf_dir, "embeddings")
    twice = e.groupBy(F.xxhash64("embedding").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    exact = e.select(F.col("vec_id").alias("node"), F.xxhash64("embedding").alias("h")).join(twice, "h", "left_semi")
    return dp.without_exact(dp.near_groups(_near(spark, sf_dir, 20)), exact).select(F.col("node").alias("vec_id"), "seed")


@query("""
WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (ORDER BY doc_id) AS place FROM documents)
SELECT doc_id, CAST(running AS BIGINT) AS running, running <= 1000000 AND place <= 1500 AS taken FROM r
""")
def cumulative_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return merge.within_budget(docs, ["doc_id"], "n_chars", 1_000_000, 1500).select("doc_id", "running", "taken")


@query("""
SELECT 'news' AS source, n_nationkey AS key, n_name AS name, CAST(NULL AS VARCHAR) AS segment FROM nation UNION ALL SELECT 'shop', c_custkey, c_name, c_mktsegment FROM customer
""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    shop = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return merge.union_sources({"news": nation, "shop": shop})
