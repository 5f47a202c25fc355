"""What files are made of: JSON shapes, stacked sheets, sidecars by name, folders, box trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import joins, quality, structure
from keepsake.sources import boxes, formats, sinks, stamps, walk
from keepsake.tables import read, scratch_path

from .base import query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON files: open ones have no list, every seventh is broken, keys of even ones are texts."""
    o = read(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"k'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise(F.col("o_orderkey").cast("string"))
    tags = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(', "tags": ["'), "o_orderstatus", F.lit('", "x"]')))
    body = F.concat(F.lit('{"id": '), key, tags, F.lit(', "at": {"n": 1.5, "deep": {"x": [1]}}, "no": null, "none": [], "ok": true}'))
    content = F.when(F.col("o_orderkey") % 7 == 0, F.lit("{broken")).otherwise(body)
    return o.select(F.format_string("data/file_%d.json", F.col("o_orderkey") % 10_000 + 10_000).alias("path"), content.alias("content"), "o_orderkey")


@query("""
SELECT 'data/file_####.json' AS path, CASE WHEN o_orderkey % 7 <> 0 THEN '{"at":{"deep":"object","n":"number"},"id":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'string' ELSE 'number' END || '","no":"null","none":"array(0)","ok":"boolean"'
  || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"tags":{"_array":2,"of":"string"}' END || '}' END AS shape, count(*) AS files FROM orders GROUP BY ALL
""")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.json_shapes(_documents(spark, sf_dir)).select("path", "shape", "files")


@query("""
SELECT 'data/file_####.json' AS path, count(*) FILTER (o_orderkey % 7 <> 0) AS files, count(*) FILTER (o_orderkey % 7 = 0) AS unreadable,
  'OBJECT<at: OBJECT<deep: OBJECT<x: ARRAY<BIGINT>>, n: DECIMAL(2,1)>, id: VARIANT, no: VOID, none: ARRAY<VOID>, ok: BOOLEAN, tags: ARRAY<STRING>>' AS schema FROM orders
""")
def json_merged_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.merged_schemas(_documents(spark, sf_dir)).select("path", "files", "unreadable", "schema")


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_no, c_name, c_mktsegment, c_custkey AS k, 'x' AS x FROM customer),
n AS (SELECT c_nationkey FROM c GROUP BY 1 HAVING count(*) >= 2)
SELECT 'n' || c_nationkey || '.xlsx' AS path, 'Customers' AS title, row_no, 'Name' AS first_name, c_name AS first, 4 AS n_cols FROM c JOIN n USING (c_nationkey)
UNION ALL SELECT 'n' || c_nationkey || '.xlsx', 'Keys', row_no, 'Column 1', CAST(k AS VARCHAR), 2 FROM c JOIN n USING (c_nationkey)
""")
def stacked_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as two tables one below the other, a sheet a nation; the second has no names."""
    c = read(spark, sf_dir, "customer")
    several = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    path = F.format_string("n%d.xlsx", "c_nationkey").alias("path")
    big = 10**9
    line = lambda rows, at, *cells: rows.select(path, at.cast("long").alias("line"), F.array(*(x.cast("string") for x in cells)).alias("r"))
    own = c.join(several, "c_nationkey")
    t = F.lit
    rows = [
        line(several, t(0), t("Customers")), line(several, t(1), t("Name"), t("Segment"), t("Key"), t("X"), t("")), line(own, F.col("c_custkey") + 2, F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"), t("x")),
        line(several, t(big), t(""), t("")), line(several, t(big + 1), t(" Keys ")), line(own, F.col("c_custkey") + big + 2, F.col("c_custkey"), F.col("c_name")), line(several, t(3 * big), t("the end")),
    ]
    flat = rows[0]
    for r in rows[1:]:
        flat = flat.unionByName(r)
    return formats.stacked_lines(flat).select("path", "title", "row_no", F.get("columns", F.lit(0)).alias("first_name"), F.get("r", F.lit(0)).alias("first"), F.size("columns").alias("n_cols"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'basename' WHEN 2 THEN 'counter-moved' WHEN 3 THEN 'supplemental' WHEN 4 THEN 'exact' END AS form,
  'd/' || CASE k WHEN 0 THEN 'IMG_' || p_partkey || '.JPG.json' WHEN 1 THEN 'IMG_' || p_partkey || '.json' WHEN 2 THEN 'IMG_' || p_partkey || '.JPG(1).json' WHEN 3 THEN 'IMG_' || p_partkey || '.JPG.supp.json' WHEN 4 THEN 'IMG_' || p_partkey || '.JPG.json' END AS sidecar FROM p
""")
def sidecar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as photos of one folder, each with a sidecar named in another way, or none; some have several."""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("k"), F.format_string("d/IMG_%d", "p_partkey").alias("stem"))
    photos = p.select("p_partkey", F.concat("stem", F.when(F.col("k") == 2, "(1).JPG").otherwise(".JPG")).alias("path"))
    tails = {0: [".JPG.json"], 1: [".json", ".JPG.s.json"], 2: [".JPG(1).json"], 3: [".JPG.supp.json", ".JPG.supplemental-metadata.json"], 4: [".JPG.json", ".json", ".JPG.x.json"], 5: [".JPG.txt"]}
    listed = F.coalesce(*(F.when(F.col("k") == k, F.array(*map(F.lit, t))) for k, t in tails.items()))
    sidecars = p.select("stem", F.explode(listed).alias("tail")).select(F.concat("stem", "tail").alias("path"))
    return joins.sidecar_forms(photos, sidecars).select("p_partkey", "form", "sidecar")


@query("""
SELECT lang || '/' || source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '' END AS path, octet_length(encode(coalesce(text, ''))) AS bytes, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END AS ext FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
""")
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of folders in folders, and listed again."""
    docs = read(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    name = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise("")))
    root = scratch_path(spark, "tree")
    sinks.write_files(docs.select(name.alias("target"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), root)
    return walk.walk(spark, root).where("category IS NULL").select("path", "bytes", "ext")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderdate + INTERVAL 1 HOUR END AS at FROM orders
""")
def movie_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as movies with both versions of the header; every third only has its letters elsewhere."""
    seconds = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400 + 3600 + 2_082_844_800
    short = F.concat(F.lit("0000006C6D76686400000000"), F.lpad(F.hex(seconds), 8, "0"))
    long_ = F.concat(F.lit("000000786D76686401000000"), F.lpad(F.hex(seconds), 16, "0"))
    trap = F.concat(F.lit("0000001C66726565"), short, F.lit("00000000"))  # a free box that holds the letters of a header
    moov = lambda inner: F.concat(F.lit("000002006D6F6F76"), inner)
    head = F.concat(F.lit("000000146674797069736F6D0000000069736F6D"), trap, F.when(F.col("o_orderkey") % 3 == 0, moov(short)).when(F.col("o_orderkey") % 3 == 1, moov(long_)).otherwise(moov(F.lit("0000000866726565"))))
    return read(spark, sf_dir, "orders").select("o_orderkey", boxes.movie_date(F.unhex(head)).alias("at"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate + INTERVAL 3661 SECOND, '%Y:%m:%d %H:%M:%S') END AS taken, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderkey % 179 - 89.25 END AS lat,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderkey % 359 - 179.5 END AS lon, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ' <é> & ' || o_orderkey END AS said FROM orders
""")
def stamped_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pictures into which date, position and description are written twice; every fifth is none."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    jpeg = F.when(key % 5 != 0, F.unhex(F.lit("FFD8FFE000104A46494600010100000100010000FFDA0000FFD9"))).otherwise(F.unhex(F.lit("89504E470D0A")))
    at = F.timestamp_add("SECOND", F.lit(3661), F.col("o_orderdate").cast("timestamp_ntz"))
    lat, lon = F.when(key % 3 != 0, key % 179 - 89.25), F.when(key % 3 != 0, key % 359 - 179.5)
    said = F.concat("o_orderpriority", F.lit(" <é> & "), key.cast("string"))
    first = stamps.stamped(jpeg, F.timestamp_add("DAY", F.lit(1), at), F.lit(1.0), F.lit(2.0), F.lit("before"))
    twice = o.select("o_orderkey", at.alias("at"), lat.alias("lat"), lon.alias("lon"), said.alias("said"), first.alias("c"))
    done = twice.select("o_orderkey", stamps.stamped("c", "at", F.col("lat").cast("double"), F.col("lon").cast("double"), "said").alias("c"))
    read_ = done.select("o_orderkey", formats.exif("c").alias("e"), stamps.description("c").alias("said"))
    return read_.select("o_orderkey", "e.taken", F.round("e.lat", 6).alias("lat"), F.round("e.lon", 6).alias("lon"), "said")


@query("""
WITH e AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'json' ELSE 'txt' END AS ext, n_chars AS size FROM documents)
SELECT 'archive' AS part, '{"files":' || count(*) || ',"bytes":' || sum(size) || ',"methods":[0,8]}' AS body FROM e UNION ALL SELECT 'ending', '{"ext":"' || ext || '","n":' || count(*) || '}' FROM e GROUP BY ext
UNION ALL SELECT 'folder', '{"folder":"notes","files":' || count(*) || ',"bytes":' || sum(size) || ',"extensions":"json:' || count(*) FILTER (ext = 'json') || ',txt:' || count(*) FILTER (ext = 'txt') || '"}' FROM e
UNION ALL SELECT 'document', '{"path":"data/file_####.json","shape":"{\\"a\\":\\"number\\"}","files":' || count(*) || ',"chars":' || count(*) * 8 || '}' FROM region
UNION ALL SELECT 'schema', '{"path":"data/file_####.json","schema":"OBJECT<a: BIGINT>","files":' || count(*) || ',"unreadable":0}' FROM region
""")
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of an export, regions as its JSON files, in one report."""
    d = read(spark, sf_dir, "documents")
    entries = d.select(F.concat(F.lit("notes/n"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".json").otherwise(".txt")).alias("path"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(8).alias("method"))
    files = read(spark, sf_dir, "region").select(F.format_string("data/file_%d.json", F.col("r_regionkey") + 1000).alias("path"), F.format_string('{"a": %d}', F.col("r_regionkey") % 10).alias("content"))
    return structure.report(entries, files)


@query("""
WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(a.k, b.k) AS c_custkey, a.v AS expected, b.v AS found, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'new' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status, b.k IS NULL AS fails FROM a FULL JOIN b ON a.k = b.k
""")
def golden_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as figures of two runs."""
    c = read(spark, sf_dir, "customer")
    found = c.where("c_custkey % 7 <> 0").select("c_custkey", (F.col("c_nationkey") + F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0)).alias("v"))
    return quality.golden(c.where("c_custkey % 5 <> 0").select("c_custkey", F.col("c_nationkey").alias("v")), found, ["c_custkey"], "v")
