"""Records that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import paths
from keepsake.operators import joins
from keepsake.tables import read

from .base import query


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.concat(F.lit("Photos/IMG_"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("path"))


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as sidecars, named in the two ways that exports use."""
    tail = F.when(F.col("doc_id") % 2 == 0, ".jpg.supplemental-metadata.json").otherwise(".jpg.json")
    return read(spark, sf_dir, "labels").select("doc_id", "quality", F.concat(F.lit("Photos/IMG_"), F.col("doc_id").cast("string"), tail).alias("path"))


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS paired FROM documents d LEFT JOIN labels l USING (doc_id)")
def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_sidecars(_media(spark, sf_dir), _sidecars(spark, sf_dir).drop("doc_id"), ["quality"]).select("doc_id", "quality", "paired")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only English photos are there."""
    return joins.orphan_sidecars(_media(spark, sf_dir).where("lang = 'en'"), _sidecars(spark, sf_dir)).select("doc_id")


OVERLAYS = """
WITH p AS (
  SELECT 'memories/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '' ELSE '-main' END || '.jpg' AS base, 'memories/' || p_partkey || '-overlay.png' AS overlay, p_size FROM part)
SELECT CASE WHEN p_size % 5 <> 0 THEN base END AS base, CASE WHEN p_size % 2 = 0 THEN overlay END AS overlay FROM p WHERE p_size % 5 <> 0 OR p_size % 2 = 0
"""


@query(OVERLAYS)
def overlay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as memories: four in five have a picture, the even ones an overlay."""
    p = read(spark, sf_dir, "part").withColumn("key", F.concat(F.lit("memories/"), F.col("p_partkey").cast("string")))
    main = p.where("p_size % 5 <> 0").select(F.concat("key", F.when(F.col("p_size") % 3 == 0, ".jpg").otherwise("-main.jpg")).alias("path"))
    over = p.where("p_size % 2 = 0").select(F.concat("key", F.lit("-overlay.png")).alias("path"))
    return joins.with_overlays(main.unionByName(over))


@query("SELECT 'd/IMG_' || p_partkey || '.MOV' AS path FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0")
def live_photo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("stem", F.concat(F.lit("d/IMG_"), F.col("p_partkey").cast("string")))
    movies = p.where("p_size % 2 = 0").select(F.concat("stem", F.lit(".MOV")).alias("path"))
    stills = p.where("p_size % 3 = 0").select(F.concat(F.lower("stem"), F.lit(".heic")).alias("path"))
    return joins.live_pairs(movies.unionByName(stills)).select("path")


@query("""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, conv_id * 1000 + turn AS id, conv_id * 1000 + turn AS root, 0::BIGINT AS depth FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
  UNION ALL SELECT c.conv_id, c.turn, c.conv_id * 1000 + c.turn, t.root, t.depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
SELECT id, root, depth, depth = 0 AND turn > 0 AS orphan FROM t
""")
def reply_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn replies to the one before."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return joins.reply_tree(c)


@query("SELECT a.event_id AS a, b.event_id AS b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS apart_us FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 10800000000")
def nearby_3h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearby(read(spark, sf_dir, "events"), "event_id", "ts", ["user_id"], 3)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return joins.with_titles(li, read(spark, sf_dir, "part"), "p_partkey", "p_name").withColumnRenamed("p_partkey", "l_partkey")


@query("SELECT d.doc_id, sha256(d.text) AS digest, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE text IS NOT NULL AND d.doc_id > 0")
def hint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hint to digest to record: documents with their id as crc; records are labels."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id > 0").select("doc_id", paths.hint(F.col("doc_id"), F.lit(1)).alias("hint"), F.sha2("text", 256).alias("digest"))
    index = d.select("hint", F.concat("digest", F.lit("-"), "hint").alias("digest"))
    labels = read(spark, sf_dir, "labels").select(paths.hint(F.col("doc_id"), F.lit(1)).alias("hint"), "quality")
    records = labels.join(index, "hint").select("digest", "quality")
    return joins.by_hint(d.select("doc_id", "hint"), index, records).select("doc_id", F.split("digest", "-")[0].alias("digest"), "quality")


@query("SELECT doc_id, doc_id % 7 <> 0 AS verified FROM documents WHERE text IS NOT NULL")
def digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record in seven names another content."""
    said = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", said.alias("digest"))
    return joins.verified(d, "text").select("doc_id", "verified")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def login_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_rows(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
