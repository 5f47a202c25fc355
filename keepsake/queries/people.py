"""People."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import names
from keepsake.operators import graph
from keepsake.operators import people as pp
from keepsake.tables import read

from .base import query


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: the sender's name is spelled in two ways, services are event types."""
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "User ").otherwise("USER-"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, " (work)").otherwise(""))
    e = read(spark, sf_dir, "events").select(name.alias("sender"), F.col("event_type").alias("platform"), F.dayofmonth("ts").alias("thread"), F.col("ts").alias("at"))
    return pp.with_person(e)


@query("""
SELECT 'user ' || user_id AS person, count(*) AS messages, count(DISTINCT day(ts)) AS threads, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS platforms, count(DISTINCT event_type) AS n_platforms,
  count(DISTINCT (event_id % 2) * 2 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS names, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY user_id
""")
def people_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.people(_messages(spark, sf_dir))


@query("""
WITH p AS (SELECT 'user ' || user_id AS person, count(DISTINCT strftime(ts, '%Y-%W')) AS periods, count(*) AS messages FROM events GROUP BY user_id),
s AS (SELECT count(DISTINCT strftime(ts, '%Y-%W')) AS span FROM events)
SELECT person, periods, messages, span FROM (SELECT * FROM p ORDER BY periods DESC, messages DESC, person LIMIT 1), s WHERE periods >= greatest(2, span - 1)
""")
def constant_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By weeks from Monday on."""
    week = F.date_sub(F.col("at").cast("date"), F.weekday(F.col("at").cast("date")))
    return pp.constant_person(_messages(spark, sf_dir), week)


@query("SELECT count(*) AS people FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1)")
def multi_platform_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.people(_messages(spark, sf_dir)).where("n_platforms > 1").agg(F.count(F.lit(1)).alias("people"))


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: what a system says is sent; a thread is called after its assistant."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("thread"), F.lit("The Assistant").alias("title"), F.initcap("role").alias("sender"), F.when(F.col("role") == "system", "sent").alias("direction"))


VOTES = """
WITH p AS (SELECT conv_id, role AS name, count(*) FILTER (role = 'system') AS sent FROM conversations WHERE role <> '' GROUP BY ALL),
t AS (SELECT conv_id, count(*) AS senders, count(*) FILTER (NOT contains('the assistant', name)) AS others, max(sent) AS any_sent FROM p GROUP BY conv_id),
v AS (
  SELECT name, CAST(sum(sent) * 100 AS BIGINT) AS sent, CAST(max(CASE WHEN any_sent = 0 AND senders = 2 AND others = 1 AND NOT contains('the assistant', name) THEN 10 ELSE 0 END) AS BIGINT) AS deduced,
    CAST(sum(CASE WHEN any_sent = 0 AND NOT (senders = 2 AND others = 1) THEN 1 ELSE 0 END) AS BIGINT) AS in_groups FROM p JOIN t USING (conv_id) GROUP BY name)
"""


@query(VOTES + "SELECT name, sent, deduced, in_groups, greatest(sent, deduced) >= 10 AS owner FROM v")
def self_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.owner_votes(_threads(spark, sf_dir))


@query(VOTES + ", o AS (SELECT name FROM v WHERE greatest(sent, deduced) >= 10) SELECT conv_id, count(*) FILTER (role IN (SELECT name FROM o)) AS sent, count(*) FILTER (role NOT IN (SELECT name FROM o)) AS received FROM conversations GROUP BY conv_id")
def message_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _threads(spark, sf_dir)
    told = pp.with_direction(m, pp.owner_votes(m))
    return told.groupBy(F.col("thread").alias("conv_id")).agg(F.count_if(F.col("direction") == "sent").alias("sent"), F.count_if(F.col("direction") == "received").alias("received"))


@query("""
WITH RECURSIVE c AS (
  SELECT n_nationkey AS node, n_nationkey AS here, 0::BIGINT AS depth FROM nation
  UNION ALL SELECT node, here // 2, depth + 1 FROM c WHERE here > 0)
SELECT node, max(depth) AS depth, 0 AS root FROM c GROUP BY node
""")
def alias_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's key is linked with half of it."""
    n = read(spark, sf_dir, "nation")
    return graph.roots(n.select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("parent"))).select("node", "depth", "root")


@query(r"""
WITH n AS (SELECT c_name || ' (' || c_mktsegment || ')' AS name FROM customer UNION ALL SELECT s_name || '!' FROM supplier UNION ALL SELECT upper(p_name) || '__' || p_brand FROM part)
SELECT name, trim(regexp_replace(regexp_replace(lower(name), '\(.*?\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS person FROM n
""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("name"))
    s = read(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("!")).alias("name"))
    p = read(spark, sf_dir, "part").select(F.concat(F.upper("p_name"), F.lit("__"), "p_brand").alias("name"))
    return c.unionByName(s).unionByName(p).select("name", names.person_key(F.col("name")).alias("person"))


@query("SELECT c_mktsegment AS name, count(*) AS n, 'c' || min(c_custkey) || '@example.com' AS address FROM customer GROUP BY 1")
def mail_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("address"))
    return pp.mail_senders(c, "c_mktsegment", "address", "c_custkey")


@query("SELECT n_name AS name, n FROM (SELECT n_name, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1) ORDER BY n DESC, name LIMIT 1")
def account_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    sides = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    named = sides.join(nation, "k").select(F.col("n_name").alias("from"), F.lit("").alias("to"))
    return pp.account_holder(named, ["from", "to"])
