"""Figures about a whole library: what was read, sign-ins, addresses, who the account is, which topics apply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import dates, paths, web

TABLE = ["source_id", "table_id"]


def figures(library: dict[str, DataFrame]) -> DataFrame:
    """(figure, n) of what readers made of an export: rows of each table, conversations, and tables of cells."""
    parts = []
    for name, table in sorted(library.items()):
        if name == "cells":
            parts.append(table.select(*TABLE).distinct().agg(F.lit("tables").alias("figure"), F.count(F.lit(1)).alias("n")))
            continue
        parts.append(table.agg(F.lit(name).alias("figure"), F.count(F.lit(1)).alias("n")))
        if name == "messages":
            parts.append(table.select("source_id", "thread").distinct().agg(F.lit("conversations").alias("figure"), F.count(F.lit(1)).alias("n")))
        if name == "sidecars":
            parts.append(table.where("taken IS NOT NULL").agg(F.lit("dates recoverable").alias("figure"), F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def table_sizes(cells: DataFrame) -> DataFrame:
    """Per table its columns and rows; a row counts once, by the column that most rows have."""
    per = cells.groupBy(*TABLE, "col_no").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("columns"), F.max("n").alias("rows"))


def _columns(cells: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(source_id, table_id, what, value, row_no): cells of the first column of each table that is named so."""
    named = F.explode(F.filter(F.array(*(F.when(F.col("col_name").rlike(p), F.lit(k)) for k, p in wanted.items())), lambda k: k.isNotNull())).alias("what")
    hits = cells.select(*TABLE, "row_no", "col_no", F.trim("value").alias("value"), named)
    first = hits.groupBy(*TABLE, "what").agg(F.min("col_no").alias("col_no"))
    return hits.join(first, [*TABLE, "what", "col_no"]).select(*TABLE, "what", "value", "row_no")


#: Columns with the address someone was connected from, and with a channel's title and handle.
ADDRESS, CHANNEL = r"(?i)^ip[ _]?(address)?$", {"name": "(?i)^channel title", "handle": "(?i)vanity url"}
#: The columns of a table of sign-ins that tell when, where and with what.
SIGN_IN = {"time": "(?i)time|date|when", "place": "(?i)country|city|region|location", "device": "(?i)agent|device|browser|platform|model"}


def sign_ins(cells: DataFrame) -> DataFrame:
    """(part, label, n) of the cells of tables of sign-ins: by place, without what stands for none, by family
    of devices, and by day."""
    c = _columns(cells, SIGN_IN)
    label = (
        F.when(F.col("what") == "time", F.date_format(dates.profile_date(F.col("value")), "yyyy-MM-dd"))
        .when(F.col("what") == "place", F.when(~F.col("value").rlike(web.PLACEHOLDER), F.col("value")))
        .otherwise(web.login_family(F.col("value")))
    )
    return c.select(F.col("what").alias("part"), label.alias("label")).where("label IS NOT NULL").groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


def address_rows(cells: DataFrame) -> DataFrame:
    """Per table that has any: the rows that carry the address someone was connected from."""
    ip = _columns(cells, {"ip": ADDRESS}).where("value <> ''")
    return ip.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"))


def kinds(cells: DataFrame, ladder: dict[str, str]) -> DataFrame:
    """Rows of tables by what their name says they hold; tables of no kind aren't counted."""
    kind = web.first_match(paths.base(F.col("table_id")), ladder)
    sizes = table_sizes(cells).withColumn("kind", kind).where("kind IS NOT NULL")
    return sizes.groupBy("kind").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("tables"))


def identity(cells: DataFrame, provider: DataFrame) -> DataFrame:
    """provider(source_id, provider): per provider its channel's title and handle, the first that any of its
    tables' first rows has, by source and table; no row without either."""
    first = _columns(cells.where("row_no = 0"), CHANNEL).where("value <> ''")
    of = lambda what: F.min_by("value", F.when(F.col("what") == what, F.struct(*TABLE))).alias(what)
    return first.join(provider, "source_id").groupBy("provider").agg(of("name"), of("handle"))


def unclaimed(tables: DataFrame, claimed: DataFrame) -> DataFrame:
    """Tables that no view has taken already."""
    return tables.join(claimed.select(*TABLE).distinct(), TABLE, "left_anti")


def applicable(topics: DataFrame, sources: DataFrame) -> DataFrame:
    """topics(topic, only array<string>) that apply to a library of sources(provider): those for any service,
    those for one that is there, and all where no service is known. One row of services is sent to
    all topics; their number is fixed by the program."""
    there = sources.agg(F.collect_set(F.coalesce("provider", F.lit(""))).alias("_there"))
    unknown = (F.size("_there") == 0) | ((F.size("_there") == 1) & (F.get("_there", F.lit(0)) == ""))
    return topics.join(F.broadcast(there)).where(F.col("only").isNull() | unknown | F.arrays_overlap("only", "_there")).select("topic")  # one row


def audio(entries: DataFrame) -> DataFrame:
    """Per source with recordings: their number, bytes and folders."""
    own = entries.where(paths.media_kind(F.col("path")) == "audio").groupBy("source_id", paths.folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return own.groupBy("source_id").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("folders"))


def fitted(width: Column, height: Column, over_width: Column, over_height: Column) -> Column:
    """Where an overlay goes on a picture: struct(x, y, width, height), as large as fits, in the middle; null
    for an overlay without a size."""
    scale = F.least(width / over_width, height / over_height)
    w, h = over_width * scale, over_height * scale
    return F.when((over_width > 0) & (over_height > 0), F.struct(((width - w) / 2).alias("x"), ((height - h) / 2).alias("y"), w.alias("width"), h.alias("height")))
