"""Where exported files go: folders, names, sidecars, the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import paths, times

LAYOUTS = ["bucket", "year-month", "year", "source-year", "type", "flat"]


def folder(layout: str) -> Column:
    """The folder of a row of media(at, source, kind, bucket) by layout; without a date, `undated`."""
    year = F.coalesce(F.substring(F.col("at").cast("string"), 1, 4), F.lit("undated"))
    if layout == "bucket":
        return F.coalesce(F.nullif("bucket", F.lit("")), F.lit("Other"))
    if layout == "year-month":
        return F.when(F.col("at").isNull(), "undated").otherwise(F.replace(times.month("at"), F.lit("-"), F.lit("/")))
    if layout == "year":
        return year
    if layout == "source-year":
        return F.concat_ws("/", F.regexp_replace(F.coalesce("source", F.lit("unknown")), r'[\\/:*?"<>|]', "-"), year)
    if layout == "type":
        return F.concat_ws("/", F.when(F.col("kind") == "video", "Videos").otherwise("Photos"), year)
    if layout == "flat":
        return F.lit("")
    raise ValueError(f"unknown layout {layout!r}")


def file_name(dated: bool = False, converted: bool = False) -> Column:
    """The base name, with the day before it if asked; .jpg where HEIC is converted."""
    name = paths.base(F.col("path"))
    if converted:
        name = F.regexp_replace(name, r"(?i)\.hei[cf]$", ".jpg")
    return F.when(F.col("at").isNotNull(), F.concat_ws("_", times.day("at"), name)).otherwise(name) if dated else name


def placed(media: DataFrame, layout: str, **names: bool) -> DataFrame:
    """media with target, no two alike: files that would meet get ` (2)`, ` (3)` in order of path. Groups
    are files of one name in one folder."""
    where = folder(layout)
    target = F.concat_ws("/", F.nullif(where, F.lit("")), file_name(**names))
    first = media.withColumn("_target", target)
    place = F.row_number().over(Window.partitionBy(F.lower("_target")).orderBy("path"))
    ext = F.regexp_extract("_target", r"[^/](\.[^./]*)$", 1)
    bare = F.substring(F.col("_target"), F.lit(1), F.length("_target") - F.length(ext))
    numbered = F.concat(bare, F.lit(" ("), F.col("_place").cast("string"), F.lit(")"), ext)
    return first.withColumn("_place", place).withColumn("target", F.when(F.col("_place") == 1, F.col("_target")).otherwise(numbered)).drop("_target", "_place")


def sidecar_json() -> Column:
    """The sidecar of a row of placed media."""
    return F.to_json(F.struct(F.col("target").alias("file"), F.col("path").alias("originalPath"), F.col("at").cast("string").alias("taken"), "at_source", "source", "kind", "size", "caption"))


def manifest(placed_media: DataFrame) -> DataFrame:
    return placed_media.select(
        F.col("target").alias("path"), paths.base(F.col("target")).alias("name"), F.col("at").cast("string").alias("taken"), F.col("source").alias("service"), F.col("size").alias("bytes"), F.col("path").alias("originalPath")
    )


def write_manifest(placed_media: DataFrame, path: str) -> None:
    manifest(placed_media).write.csv(path, header=True, quoteAll=True, mode="overwrite")


def folder_counts(media: DataFrame, layout: str) -> DataFrame:
    return media.groupBy(folder(layout).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def not_yet_done(media: DataFrame, done: DataFrame) -> DataFrame:
    """What a stopped export still has to write: media whose path the done log lacks."""
    return media.join(done.select("path").distinct(), "path", "left_anti")
