"""Accounting, coverage, structure; page views and saved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import names
from keepsake.functions import web as web_names
from keepsake.operators import quality, web
from keepsake.streaming import counters
from keepsake.tables import read

from .base import query

LADDER_SQL = """
WITH e AS (
  SELECT d.doc_id, n_chars, CASE WHEN l.quality = 1 THEN 'media' WHEN l.quality = 0 THEN 'messages' WHEN b.item_id IS NOT NULL THEN 'view' WHEN lang = 'fr' THEN 'noise' WHEN n_chars <= 2 THEN 'empty' ELSE 'unread' END AS bucket
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON d.doc_id = b.item_id)
"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: labels and benchmark items claim some, French ones are named like junk."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    path = lambda c: F.concat(F.lit("e/"), F.col(c).cast("string"))
    named = docs.select("doc_id", "lang", F.col("n_chars").alias("size"), path("doc_id").alias("key"))
    noisy = F.when(F.col("lang") == "fr", F.concat("key", F.lit("/.DS_Store"))).otherwise(F.col("key"))
    entries = named.withColumn("path", noisy)
    said = labels.select(path("doc_id").alias("key"), F.when(F.col("quality") == 1, "media").when(F.col("quality") == 0, "messages").alias("bucket"))
    said = said.unionByName(read(spark, sf_dir, "benchmark").select(path("item_id").alias("key"), F.lit("view").alias("bucket")))
    used = said.join(entries.select("key", "path"), "key").select("path", "bucket")
    return quality.reconcile(entries.select("doc_id", "lang", "path", "size"), used)


@query(LADDER_SQL + "SELECT doc_id, bucket FROM e")
def reconcile_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("doc_id", "bucket")


@query(LADDER_SQL + "SELECT bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM e GROUP BY bucket")
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bucket_totals(_reconciled(spark, sf_dir))


@query(LADDER_SQL + "SELECT count(*) AS total, count(*) FILTER (bucket = 'unread') AS unread, CAST(floor(count(*) FILTER (bucket <> 'unread') * 100 / count(*) + 0.5) AS BIGINT) AS percent FROM e")
def coverage_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.read_share(_reconciled(spark, sf_dir))


@query(LADDER_SQL + "SELECT lang AS area, count(*) FILTER (bucket = 'unread') AS unread, count(*) AS entries FROM e JOIN documents USING (doc_id) GROUP BY lang HAVING unread > 0 ORDER BY unread DESC, area LIMIT 5")
def unread_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unread_report(_reconciled(spark, sf_dir), F.col("lang"), least=1, share=0.01)


@query("""
WITH s AS (SELECT 'src' || i AS name FROM (SELECT unnest([0, 3, 7, 99]) AS i)), d AS (SELECT source FROM documents WHERE lang = 'de')
SELECT name, count(source) AS n, count(source) > 0 AS found FROM s LEFT JOIN d ON source = name GROUP BY name
""")
def coverage_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of four sources against those of German documents."""
    catalogue = spark.createDataFrame([(f"src{i}", f"^src{i}$") for i in (0, 3, 7, 99)], "name string, pattern string")
    return quality.coverage(catalogue, read(spark, sf_dir, "documents").where("lang = 'de'"), "name", "pattern", "source")


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es')")
def missing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.missing(docs.select("source").distinct(), docs.where("lang = 'es'"), "source")


@query("""
WITH d AS (SELECT l.doc_id IS NOT NULL AS a, b.item_id IS NOT NULL AS b FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON d.doc_id = b.item_id)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' WHEN b THEN 'right' ELSE 'neither' END AS "case", count(*) AS n FROM d GROUP BY 1
""")
def survey_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("a"))
    bench = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("b"))
    both = read(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").join(bench, "doc_id", "left")
    return quality.crosstab(both, F.col("a").isNotNull(), F.col("b").isNotNull())


@query("""
WITH d AS (SELECT count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY CAST(o_orderdate AS DATE))
SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, count(*) >= 8 AND sum(n) >= 8 AND max(n) * 2 <= sum(n) AS trusted FROM d
""")
def archive_date_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dates_trusted(read(spark, sf_dir, "orders"), "o_orderdate")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_replace(regexp_replace(path, '\d{4,}', '####', 'g'), '\d', '#', 'g') AS shape FROM p
""")
def structure_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of pages, masked as folders are."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", names.mask_folder(path).alias("shape"))


@query("""
WITH f AS (SELECT 'Data/' || lang AS folder, CASE WHEN doc_id % 2 = 0 THEN 'csv' ELSE 'json' END AS ext, n_chars FROM documents),
e AS (SELECT folder, ext, count(*) AS n, sum(n_chars) AS bytes FROM f GROUP BY ALL)
SELECT folder, CAST(sum(n) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(ext || ':' || n, ',' ORDER BY ext) AS extensions FROM e GROUP BY folder
""")
def extension_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("Data/"), "lang", F.lit("/file"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".CSV").otherwise(".json"))
    return quality.structure(read(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("size")))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n_links,
  len(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda h: starts_with(h, '/'))) AS n_inner, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages
""")
def activity_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.page_facts(read(spark, sf_dir, "pages")).select("page_id", "title", "n_links", "n_inner", "host")


@query("SELECT lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '')) AS host, count(*) AS n FROM pages GROUP BY 1")
def beacon_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referring hosts of pages."""
    return read(spark, sf_dir, "pages").groupBy(web_names.referrer(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'Chrome' WHEN 'view' THEN 'Edge' WHEN 'purchase' THEN 'Firefox' ELSE 'Other' END AS browser, event_type = 'signup' AS mobile FROM events WHERE event_type <> 'error'
""")
def beacon_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page views; errors ask for a page that isn't there."""
    agent = F.when(F.col("event_type") == "click", "x Chrome/1 Safari/2").when(F.col("event_type") == "view", "x Chrome/1 Safari/2 Edg/1").when(F.col("event_type") == "purchase", "Firefox/9").otherwise("Mobi")
    path = F.when(F.col("event_type") == "error", "/wp-login.php").otherwise("/guides/a-b.html")
    views = read(spark, sf_dir, "events").select("event_id", path.alias("path"), F.lit("").alias("referrer"), agent.alias("agent"), F.lit("DE").alias("country"))
    return web.valid_views(views).select("event_id", "browser", "mobile")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, 'views' AS dim, '' AS value, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'event_type', event_type, count(*) FROM events GROUP BY 1, 3")
def counter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters by one run of the stream over all events. The pattern lets the path be one file."""
    schema = read(spark, sf_dir, "events").schema
    return counters.count_available(spark, f"{sf_dir}/events.parque[t]", schema, ["event_type"])


@query("SELECT lower(trim(p_name)) AS phrase, count(*) AS n FROM part WHERE length(trim(p_name)) BETWEEN 1 AND 80 GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, phrase LIMIT 8")
def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.repeated_phrases(read(spark, sf_dir, "part"), "p_name")


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'iPhone' WHEN '2-HIGH' THEN 'Mac' WHEN '3-MEDIUM' THEN 'Android' ELSE 'Other' END AS family, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def device_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.when(F.col("o_orderpriority") == "1-URGENT", "Mozilla/5 (iPhone; Mac OS)").when(F.col("o_orderpriority") == "2-HIGH", "Macintosh").when(F.col("o_orderpriority") == "3-MEDIUM", "Linux; Android 14").when(F.col("o_orderpriority") == "5-LOW", "").otherwise("toaster")
    seen = read(spark, sf_dir, "orders").select(web_names.login_family(agent).alias("family"))
    return seen.where("family IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT lang AS company, source AS download, count(*) AS parts, sum(n_chars) AS bytes, bool_and(doc_id % 2 = 0) AS gone FROM documents GROUP BY ALL)
SELECT company, count(*) AS downloads, CAST(sum(parts) AS BIGINT) AS parts, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (gone) AS superseded FROM p GROUP BY company
""")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parts of downloads (sources) of companies (languages); even ones are superseded."""
    from keepsake.operators.sources import rollup

    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("company"), F.col("source").alias("download"), F.col("n_chars").alias("bytes"), (F.col("doc_id") % 2 == 0).alias("superseded"))
    return rollup(d)
