"""One timeline out of all kinds of records, and its filters and measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import times

ITEM = ["at", "type", "title", "source", "day", "count"]
#: Month steps of a timeline rail.
STEPS = [1, 2, 3, 6, 12, 24, 60]


def chat_days(messages: DataFrame) -> DataFrame:
    """messages(source, thread, at): a thread is one item a day, at its last message."""
    dated = messages.where("at IS NOT NULL").withColumn("day", times.day("at"))
    one = dated.groupBy("source", F.col("thread").alias("title"), "day").agg(F.count(F.lit(1)).alias("count"), F.max("at").alias("at"))
    return one.withColumn("type", F.lit("chat")).select(*ITEM)


def place_days(places: DataFrame) -> DataFrame:
    """places(source, at): all points of a source on a day are one item, at the last of them."""
    dated = places.where("at IS NOT NULL").withColumn("day", times.day("at"))
    one = dated.groupBy("source", "day").agg(F.count(F.lit(1)).alias("count"), F.max("at").alias("at"))
    return one.withColumns({"type": F.lit("place"), "title": F.lit("places")}).select(*ITEM)


def single_items(records: DataFrame, kind: str | None = None) -> DataFrame:
    """records(source, at, kind, title): an item each; their type is kind, or their own kind."""
    dated = records.where("at IS NOT NULL").withColumns({"day": times.day("at"), "count": F.lit(1).cast("long")})
    return dated.withColumn("type", F.lit(kind) if kind else F.col("kind")).select(*ITEM)


def timeline(media: DataFrame | None = None, messages: DataFrame | None = None, places: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """All dated records as items. Events that only announce a photo or video are left out: the
    picture is there itself."""
    parts = []
    if media is not None:
        parts.append(single_items(media))
    if messages is not None:
        parts.append(chat_days(messages))
    if places is not None:
        parts.append(place_days(places))
    if events is not None:
        parts.append(single_items(events.where("NOT kind IN ('photo', 'video')"), "event"))
    return reduce(DataFrame.unionByName, parts)


def day_groups(items: DataFrame) -> DataFrame:
    return items.groupBy("day").agg(F.count(F.lit(1)).alias("items"), F.sum("count").alias("records"), F.max("at").alias("last"))


def month_groups(items: DataFrame, at: str = "at") -> DataFrame:
    """Per month: items; what has no date is its own group, month null."""
    return items.groupBy(times.month(at).alias("month")).agg(F.count(F.lit(1)).alias("items"))


def stats(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("items"), F.sum("count").alias("records"), F.count_distinct("source").alias("sources"),
        F.count_distinct("type").alias("types"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


def scope(df: DataFrame, sources_off: list | None = None, start: str | None = None, end: str | None = None, at: str | None = "at", source: str = "source") -> DataFrame:
    """Rows of sources that are on, between two dates, both included. A bound leaves undated rows out;
    tables and files (at=None) are only scoped by source."""
    if sources_off:
        df = df.where(~F.col(source).isin(sources_off) | F.col(source).isNull())
    if at and start:
        df = df.where(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    if at and end:
        df = df.where(F.col(at) < F.timestamp_add("DAY", F.lit(1), F.lit(end).cast("timestamp_ntz")))
    return df


def preset(df: DataFrame, name: str, at: str = "at") -> DataFrame:
    """`year` (the newest row's calendar year), `12m` and `30d`, back from the newest row, not from now."""
    newest = df.agg(F.max(at).alias("_newest"))
    begin = {"year": F.date_trunc("year", F.col("_newest")).cast("timestamp_ntz"), "12m": F.timestamp_add("MONTH", F.lit(-12), F.col("_newest")), "30d": F.timestamp_add("DAY", F.lit(-30), F.col("_newest"))}[name]
    # one row against all: a scalar, broadcast
    return df.join(F.broadcast(newest.select(begin.alias("_begin"))), F.col(at) >= F.col("_begin"), "inner").drop("_begin")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that hold the text, whatever the case, in one of the columns."""
    hit = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in columns]
    return df.where(reduce(Column.__or__, hit))


def largest(df: DataFrame, text: str, name: str, size: str, limit: int = 500) -> DataFrame:
    """The largest files whose name holds the text: a top-k."""
    return search(df, text, [name]).orderBy(F.desc(size), name).limit(limit)


def rail_marks(anchors: DataFrame, capacity: int, at: str = "at", order: str = "ord") -> DataFrame:
    """Marks of a timeline rail: from the newest month back in steps, the smallest step that needs at
    most `capacity` marks; each mark with how many anchors its period has and the first of them."""
    months = anchors.where(F.col(at).isNotNull()).withColumn("_m", times.month_number(at))
    span = months.agg(F.min("_m").alias("lo"), F.max("_m").alias("hi")).withColumn("span", F.col("hi") - F.col("lo") + 1)
    step = F.coalesce(*(F.when(F.ceil(F.col("span") / s) <= capacity, F.lit(s)) for s in STEPS), F.ceil(F.col("span") / max(1, capacity)))
    ruled = months.join(F.broadcast(span.withColumn("step", step.cast("long"))))  # one row
    mark = F.floor((F.col("hi") - F.col("_m")) / F.col("step"))
    marked = ruled.groupBy(mark.alias("mark"), "step", "hi").agg(F.count(F.lit(1)).alias("anchors"), F.min(order).alias("first"))
    key = F.col("hi") - F.col("mark") * F.col("step")
    return marked.select("mark", "step", F.floor(key / 12).alias("year"), (key % 12 + 1).alias("month"), "anchors", "first")
