"""Rules, sorting plans and export layouts over documents and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import paths
from keepsake.operators import duplicates as dp
from keepsake.plans import buckets, layouts, rules
from keepsake.tables import read

from .base import query

RULES = [
    rules.Rule("keep everything German", "keep", {"name_glob": "*.de"}),
    rules.Rule("delete duplicates", "delete", {"duplicates_only": True}),
    rules.Rule("move large files", "move", {"larger_than_mb": 0.005}, "Large"),
    rules.Rule("delete chat media named src1*", "delete", {"categories": ["chat_media"], "name_glob": "SRC1*"}),
    rules.Rule("transfer what is old", "transfer", {"older_than_days": 365}, "Archive"),
]
NOW = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"

PLANNED = """
WITH h AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS sha, text IS NOT NULL AND n_chars > 0 AS ok FROM documents),
g AS (SELECT sha, n_chars, min(doc_id) AS first FROM h WHERE ok GROUP BY ALL HAVING count(*) > 1),
f AS (SELECT h.doc_id, source || '-' || h.doc_id || '.' || lang AS name, h.n_chars, lang, coalesce(h.doc_id > g.first, false) AS dup FROM h LEFT JOIN g ON h.sha = g.sha AND h.n_chars = g.n_chars AND ok),
p AS (
  SELECT doc_id, n_chars, CASE WHEN lang = 'de' THEN 0 WHEN dup THEN 1 WHEN n_chars > 5242 THEN 2 WHEN lang = 'fr' AND starts_with(name, 'src1') THEN 3 WHEN doc_id % 3 = 0 THEN 4 END AS rule FROM f),
a AS (SELECT *, CASE rule WHEN 0 THEN 'keep' WHEN 1 THEN 'delete' WHEN 2 THEN 'move' WHEN 3 THEN 'delete' WHEN 4 THEN 'transfer' ELSE 'none' END AS action FROM p)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scanned files; every third is from 2020, the others have no date."""
    docs = read(spark, sf_dir, "documents")
    flagged = dp.three_stage(docs.select("doc_id", "text", "n_chars"), F.col("text"), "n_chars", "doc_id").select("doc_id", "duplicate")
    name = F.concat(F.lit("scan/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    files = docs.select(
        "doc_id", name.alias("path"), F.col("n_chars").alias("size"), F.when(F.col("lang") == "fr", "chat_media").otherwise("other").alias("category"),
        F.when(F.col("doc_id") % 3 == 0, F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'")).alias("modified"),
    )
    return files.join(flagged, "doc_id")


@query(PLANNED + "SELECT doc_id, rule, action FROM a")
def rules_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_files(spark, sf_dir), RULES, F.expr(NOW)).select("doc_id", "rule", "action")


@query(PLANNED + "SELECT v.action, count(a.doc_id) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM (VALUES ('keep'), ('delete'), ('move'), ('transfer'), ('none')) v(action) LEFT JOIN a USING (action) GROUP BY v.action")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.plan_summary(rules.apply_rules(_files(spark, sf_dir), RULES, F.expr(NOW)))


PLAN = {
    "buckets": [
        {"name": "Odd sources", "folder": "Odd", "match": {"field": "source", "any": ["src1", "src3"]}},
        {"name": "Streets", "action": "drop", "match": {"field": "caption", "any": ["street", " avenue"]}},
        {"name": "Films", "match": {"field": "kind", "any": ["video"]}},
    ]
}
BUCKETS = """
WITH b AS (
  SELECT doc_id, n_chars, CASE WHEN contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(source, '')), 'src3') THEN 'Odd sources'
    WHEN contains(lower(coalesce(text, '')), 'street') OR contains(lower(coalesce(text, '')), ' avenue') THEN 'Streets' WHEN lang = 'es' THEN 'Films' ELSE 'Everything else' END AS bucket FROM documents)
"""


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("caption"), "source", F.when(F.col("lang") == "es", "video").otherwise("photo").alias("kind"), F.lit("").alias("name"), F.col("n_chars").alias("size"))
    return buckets.sort_media(docs, buckets.checked(PLAN))


@query(BUCKETS + "SELECT doc_id, bucket, CASE WHEN bucket = 'Streets' THEN 'drop' ELSE 'keep' END AS action FROM b")
def bucket_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir).select("doc_id", "bucket", "action")


@query(BUCKETS + "SELECT bucket, CASE WHEN bucket = 'Streets' THEN 'drop' ELSE 'keep' END AS action, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM b GROUP BY bucket")
def cleanup_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.preview(_sorted(spark, sf_dir))


@query("""
WITH f AS (SELECT p_partkey, p_size % 8 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'junk' WHEN 1 THEN 'snapchat_overlay' WHEN 2 THEN 'snapchat_memory' WHEN 3 THEN 'chat_media' WHEN 4 THEN 'screenshot' WHEN 5 THEN 'camera_photo' WHEN 6 THEN 'live_photo_pair' ELSE 'camera_video' END AS category FROM f
UNION ALL SELECT p_partkey, 'camera_photo' FROM f WHERE k = 6
""")
def scan_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scanned files of every category; live photos have their still beside them."""
    n = F.col("p_partkey").cast("string")
    shapes = [
        F.concat(F.lit("a/"), n, F.lit(".tmp")), F.concat(F.lit("a/2023-05-01_"), n, F.lit("-overlay.png")), F.concat(F.lit("a/2023-05-01_"), n, F.lit("-main.mp4")),
        F.concat(F.lit("a/cm-chat-media-"), n, F.lit(".bin")), F.concat(F.lit("a/IMG_"), n, F.lit(".PNG")), F.concat(F.lit("a/IMG_"), n, F.lit(".jpeg")),
        F.concat(F.lit("a/IMG_"), n, F.lit(".MOV")), F.concat(F.lit("b/VID_"), n, F.lit(".mp4")),
    ]
    p = read(spark, sf_dir, "part")
    files = p.select("p_partkey", F.get(F.array(*shapes), F.col("p_size") % 8).alias("path"), F.lit(9).alias("size"))
    stills = p.where("p_size % 8 = 6").select("p_partkey", F.concat(F.lit("a/img_"), n, F.lit(".heic")).alias("path"), F.lit(9).alias("size"))
    return rules.scan_categories(files.unionByName(stills)).select("p_partkey", "category")


@query("SELECT strftime(o_orderdate, '%Y/%m') AS folder, count(*) AS n FROM orders GROUP BY 1")
def export_layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.folder_counts(read(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "at"), "year-month")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'undated' ELSE strftime(o_orderdate, '%Y') END || '/file' || (o_orderkey % 1000) AS t FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS r FROM o)
SELECT o_orderkey, t || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END || '.jpg' AS target FROM r
""")
def export_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photos whose names repeat; pending ones have no date."""
    path = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("/file"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".jpg"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"))
    return layouts.placed(o, "year").select("o_orderkey", "target")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without line items are what is still to do."""
    todo = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("path"))
    return layouts.not_yet_done(todo, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"))).select("o_orderkey")


@query("""
WITH f AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'takeout-20260731T101500Z-1-00' || (p_partkey % 9) WHEN 1 THEN 'instagram-me-2026-07-31-x' || p_partkey WHEN 2 THEN 'Other Data Part ' || (p_partkey % 5) || ' of 5' ELSE 'backup-' || (p_partkey % 9) END AS stem FROM part)
SELECT p_partkey, 'x:' || CASE WHEN starts_with(stem, 'takeout') THEN '20260731T101500Z' WHEN starts_with(stem, 'insta') THEN 'instagram-me-2026-07-31' WHEN starts_with(stem, 'Other') THEN 'other data' ELSE 'backup' END AS export_key,
  CASE WHEN starts_with(stem, 'takeout') THEN 'google' WHEN starts_with(stem, 'Other') THEN 'apple' END AS provider FROM f
""")
def export_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as archives of four kinds, a third of them second copies."""
    n = F.col("p_partkey")
    copy = F.when(n % 3 == 0, " (1).zip").otherwise(".zip")
    shapes = [
        F.concat(F.lit("takeout-20260731T101500Z-1-00"), (n % 9).cast("string"), copy), F.concat(F.lit("instagram-me-2026-07-31-x"), n.cast("string"), copy),
        F.concat(F.lit("Other Data Part "), (n % 5).cast("string"), F.lit(" of 5"), copy), F.concat(F.lit("backup-"), (n % 9).cast("string"), copy),
    ]
    named = read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*shapes), F.col("p_size") % 4).alias("archive"))
    return named.select("p_partkey", paths.export_key(F.col("archive"), F.lit("x")).alias("export_key"), paths.provider_by_name(F.col("archive")).alias("provider"))


@query("SELECT lang AS source_id, CASE lang WHEN 'de' THEN 'google' WHEN 'en' THEN 'reddit' WHEN 'es' THEN 'snapchat' END AS provider, CASE WHEN lang IN ('de', 'en', 'es') THEN n ELSE 0 END AS score FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def provider_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of four archives, one a language."""
    from keepsake.sources.detect import detect_providers

    n = F.col("doc_id").cast("string")
    path = F.when(F.col("lang") == "de", F.concat(F.lit("Takeout/x/"), n)).when(F.col("lang") == "en", F.concat(F.lit("reddit/"), n)).when(F.col("lang") == "es", F.concat(F.lit("memories/2024-01-01_0123456789-main."), n)).otherwise(n)
    return detect_providers(read(spark, sf_dir, "documents").select(F.col("lang").alias("source_id"), path.alias("path")))
