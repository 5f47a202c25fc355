"""People across services: one person's names, threads and messages; who the account's owner is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import names, times

from . import graph

#: Votes for being the account's owner, and how many make one.
SENT, DEDUCED, GROUP, ENOUGH = 100, 10, 1, 10


def with_person(messages: DataFrame, name: str = "sender", aliases: DataFrame | None = None) -> DataFrame:
    """messages with person: the normalised name or, where aliases(node, parent) link names, its root."""
    keyed = messages.withColumn("person", names.person_key(F.col(name)))
    if aliases is None:
        return keyed
    roots = graph.roots(aliases).select(F.col("node").alias("person"), "root")
    return keyed.join(roots, "person", "left").withColumn("person", F.coalesce("root", "person")).drop("root")


def people(messages: DataFrame, at: str = "at") -> DataFrame:
    """messages(person, sender, platform, thread, at): a row a person."""
    return messages.where("person <> ''").groupBy("person").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("thread").alias("threads"),
        F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"), F.count_distinct("platform").alias("n_platforms"),
        F.count_distinct("sender").alias("names"), F.min(times.day(at)).alias("first_day"), F.max(times.day(at)).alias("last_day"),
    )


def constant_person(messages: DataFrame, period: Column) -> DataFrame:
    """Who is there in most periods, then with most messages, then the first by name. Only reported if
    there in all periods but one, two at least."""
    per = messages.where("person <> ''").groupBy("person").agg(F.count_distinct(period).alias("periods"), F.count(F.lit(1)).alias("messages"))
    best = per.orderBy(F.desc("periods"), F.desc("messages"), "person").limit(1)
    span = messages.agg(F.count_distinct(period).alias("span"))
    return best.join(F.broadcast(span)).where(F.col("periods") >= F.greatest(F.lit(2), F.col("span") - 1))  # one row


def owner_votes(messages: DataFrame) -> DataFrame:
    """messages(thread, title, sender, direction): per normalised name sent, deduced and in_groups votes,
    and owner. A sent message is a sure vote. In a thread without any, of two senders of whom one
    is named by the title the other is deduced to be the owner; other threads only say that their
    senders are there. Deductions are compared as they are: many groups don't make an owner."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    said = messages.select("thread", norm(F.col("title")).alias("title"), norm(F.col("sender")).alias("name"), (F.col("direction") == "sent").alias("sent"))
    pairs = said.where("name <> ''").groupBy("thread", "title", "name").agg(F.count_if("sent").alias("sent"))
    other = (F.col("name") != F.col("title")) & ~F.contains("title", "name") & ~F.contains("name", "title")
    threads = pairs.groupBy("thread").agg(F.count(F.lit(1)).alias("senders"), F.count_if(other).alias("others"), F.max("sent").alias("any_sent"))
    told = pairs.join(threads, "thread")
    silent = F.col("any_sent") == 0
    two = silent & (F.col("senders") == 2) & (F.col("others") == 1)
    votes = told.groupBy("name").agg(
        (F.sum("sent") * SENT).alias("sent"), F.max(F.when(two & other, DEDUCED).otherwise(0)).cast("long").alias("deduced"),
        F.sum(F.when(silent & ~two, GROUP).otherwise(0)).alias("in_groups"),
    )
    return votes.withColumn("owner", F.greatest("sent", "deduced") >= ENOUGH)


def with_direction(messages: DataFrame, votes: DataFrame) -> DataFrame:
    """messages with direction set: what owners wrote is sent, all else received."""
    norm = F.trim(F.regexp_replace(F.lower("sender"), "[^a-z0-9]+", " "))
    mine = votes.where("owner").select(F.col("name").alias("_me"))
    hit = messages.withColumn("_name", norm).join(mine, F.col("_name") == F.col("_me"), "left")
    return hit.withColumn("direction", F.when(F.col("_me").isNotNull(), "sent").otherwise("received")).drop("_name", "_me")


def account_holder(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent name over from and to columns: the account's own."""
    one = rows.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("name")).where("name <> ''")
    return one.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(1)


def mail_senders(mails: DataFrame, name: str, address: str, order: str) -> DataFrame:
    """Mails by the name shown; the first address that came with it."""
    return mails.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min_by(address, order).alias("address"))
