"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import dates, names, numbers, paths, text, times
from keepsake.tables import read

from .base import query


@query("""
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(numbers.cents(F.col("value"))).alias("total"))


@query("""
SELECT event_id, epoch_us(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END) AS at_us FROM events
""")
def date_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps written in six shapes, and read again."""
    s = F.col("ts").cast("string")
    part = lambda a, n: F.substring(s, a, n)
    month = F.get(F.array(*(F.lit(m.capitalize()) for m in dates.MONTHS)), F.month("ts") - 1)
    shapes = [
        F.concat(part(1, 19), F.lit(" UTC")),
        F.floor(times.epoch_micros("ts") / 1_000_000).cast("string"),
        F.concat_ws("/", part(9, 2), part(6, 2), part(1, 4)),
        F.concat(part(1, 4), part(6, 2), part(9, 2)),
        F.floor(F.floor(times.epoch_micros("ts") / 1_000_000) * 1000).cast("string"),
        F.concat(month, F.lit(" "), F.dayofmonth("ts").cast("string"), F.lit(", "), part(1, 4), F.lit(", "), part(12, 5)),
    ]
    written = F.get(F.array(*shapes), (F.col("event_id") % 6).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", times.epoch_micros(dates.profile_date(written, 1_735_689_600_000)).alias("at_us"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in three ways."""
    us = F.format_number("o_totalprice", 2)
    eu = F.concat(F.translate(us, ",.", ".,"), F.lit(" EUR"))
    signed = F.concat(F.lit("$"), us)
    written = F.get(F.array(us, eu, signed), (F.col("o_orderkey") % 3).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.cents(numbers.to_number(written)).alias("cents"))


@query(r"""
SELECT doc_id, split_part(text, chr(10), 1) AS title, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS words FROM documents
""")
def notes_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("title"), text.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, sha256(text) AS repaired_sha, regexp_matches(text, '[^\x00-\x7F]') AS was_mangled FROM documents WHERE text IS NOT NULL")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read in the wrong encoding, and repaired."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", wrong.alias("t"))
    return docs.select("doc_id", F.sha2(text.repair(F.col("t")), 256).alias("repaired_sha"), text.is_mangled(F.col("t")).alias("was_mangled"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS ts FROM orders)
SELECT o_orderkey, epoch_us(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', ts) + INTERVAL 12 HOUR WHEN 1 THEN ts ELSE date_trunc('day', ts) + INTERVAL 12 HOUR END) AS at_us FROM o
""")
def date_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as cameras and messengers give them."""
    ts = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", ts.alias("ts"))
    s = F.col("ts").cast("string")
    day, clock = F.replace(F.substring(s, 1, 10), F.lit("-"), F.lit("")), F.replace(F.substring(s, 12, 8), F.lit(":"), F.lit(""))
    shapes = [F.concat(F.substring(s, 1, 10), F.lit("_abc.jpg")), F.concat(F.lit("IMG_"), day, F.lit("_"), clock, F.lit(".jpg")), F.concat(F.lit("IMG-"), day, F.lit("-WA0001.jpg"))]
    name = F.get(F.array(*shapes), (F.col("o_orderkey") % 3).cast("int"))
    return o.select("o_orderkey", times.epoch_micros(dates.date_from_name(name)).alias("at_us"))


@query("""
SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate) + INTERVAL 2 SECOND * (o_orderkey % 30)) AS at_us FROM orders
""")
def dos_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the two fields of a zip directory."""
    date = F.shiftleft(F.year("o_orderdate") - 1980, 9) + F.shiftleft(F.month("o_orderdate"), 5) + F.dayofmonth("o_orderdate")
    time = (F.col("o_orderkey") % 30).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", times.epoch_micros(dates.dos_date(date, time)).alias("at_us"))


@query("SELECT p_partkey, CASE WHEN p_size < 15 THEN 'photo' WHEN p_size < 30 THEN 'video' WHEN p_size < 40 THEN 'audio' END AS kind FROM part")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("p_size") < 15, "HEIC").when(F.col("p_size") < 30, "mp4").when(F.col("p_size") < 40, "opus").otherwise("json")
    return read(spark, sf_dir, "part").select("p_partkey", paths.media_kind(F.concat("p_name", F.lit("."), ext)).alias("kind"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 1000 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 90 + 10 AS VARCHAR) || 'k' ELSE CAST(p_partkey % 9 + 1 AS VARCHAR) || '.5M' END AS shown FROM part
""")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = F.when(k % 3 == 0, k % 1000).when(k % 3 == 1, (k % 90 + 10) * 1000).otherwise((k % 9 + 1) * 1_000_000 + 500_000).cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", numbers.short_number(n).alias("shown"))


@query("SELECT c_custkey, upper(left(c_mktsegment, 1)) || upper(left(c_name, 1)) AS initials FROM customer")
def person_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", names.initials(F.concat_ws(" ", F.lower("c_mktsegment"), "c_name", F.lit("third"))).alias("initials"))


@query("SELECT 'e' || event_id AS path, 'k' AS field, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS value FROM events")
def json_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as rows of field and value."""
    from keepsake.operators.topics import key_values

    objects = read(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), F.col("props").alias("content"))
    return key_values(objects)


@query("SELECT c_custkey, c_name AS name, 'c' || c_custkey || '@x.org' AS address FROM customer")
def mail_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as mail headers write them, taken apart."""
    header = F.concat(F.lit('"'), "c_name", F.lit('" <C'), F.col("c_custkey").cast("string"), F.lit("@X.org>"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.address_name(header).alias("a")).select("c_custkey", "a.name", "a.address")
