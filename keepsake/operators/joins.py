"""Records that belong together: sidecars, overlays, replies, neighbours in time, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import paths, times

from . import graph


def with_sidecars(media: DataFrame, sidecars: DataFrame, carry: list[str], by: list[str] | None = None) -> DataFrame:
    """media(path) with the columns `carry` of its sidecar(path), null without one. A sidecar's own key
    counts before its alternative with the counter moved; of several, the first by path. Parts of a
    download are joined after their union, so a photo and its sidecar may come from different parts;
    by: columns of both that tell downloads apart, whose paths may be equal."""
    own = by or []
    keys = sidecars.select(*own, F.col("path").alias("_side"), *carry, F.posexplode(paths.sidecar_keys(F.col("path"))).alias("_rank", "_key")).where("_key IS NOT NULL")
    best = keys.groupBy(*own, "_key").agg(F.min_by(F.struct(*carry), F.struct("_rank", "_side")).alias("_c"), F.count(F.lit(1)).alias("_n"))
    return media.withColumn("_key", F.lower("path")).join(best, [*own, "_key"], "left").select(*media.columns, *(F.col(f"_c.{c}").alias(c) for c in carry), F.col("_n").isNotNull().alias("paired"))


def orphan_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars whose photo isn't there, by neither of their keys."""
    keys = sidecars.select("path", F.explode(paths.sidecar_keys(F.col("path"))).alias("_key")).where("_key IS NOT NULL")
    matched = keys.join(media.select(F.lower("path").alias("_key")).distinct(), "_key", "left_semi").select("path").distinct()
    return sidecars.join(matched, "path", "left_anti")


#: How a sidecar may be named after its photo, the first that is there counts.
FORMS = ("exact", "basename", "counter-moved", "supplemental")
#: Names that a task takes: paths of a folder are so alike that their stored size says little about their memory.
NAMES_EACH = 50_000


def sidecar_forms(photos: DataFrame, sidecars: DataFrame) -> DataFrame:
    """photos(path) with form and sidecar, null without one; sidecars(path) are JSON files of the same folder.

    exact: the photo's name and `.json`; basename: the name without its ending; counter-moved: `a.JPG(1)` for
    `a(1).JPG`; supplemental: any longer name that begins with the photo's and a point, the first by name.
    A beginning is a join too: each sidecar is listed under what stands before each of its points, so
    nothing is compared with all names of a folder. Tasks are as many as NAMES_EACH names each make."""
    parts = max(1, -(-(photos.count() + sidecars.count()) // NAMES_EACH))
    folder, base = paths.folder(F.col("path")), paths.base(F.col("path"))
    named = sidecars.select(folder.alias("_dir"), base.alias("_name")).where(F.col("_name").endswith(".json")).repartition(parts, "_dir", "_name").distinct()
    points = F.filter(F.sequence(F.lit(2), F.length("_name")), lambda i: F.substring(F.col("_name"), i, F.lit(1)) == ".")
    beginnings = named.select("_dir", "_name", F.explode(F.transform(points, lambda i: F.substring(F.col("_name"), F.lit(1), i - 1))).alias("_key")).repartition(parts, "_dir", "_key").groupBy("_dir", "_key").agg(F.min("_name").alias("_name"))
    known = named.select("_dir", F.lit(True).alias("_whole"), F.col("_name").alias("_key"), "_name").unionByName(beginnings.select("_dir", F.lit(False).alias("_whole"), "_key", "_name")).repartition(parts, "_dir", "_whole", "_key")
    counter = r"^(.*)(\(\d+\))(\.[^.]+)$"
    moved = F.when(F.col("_base").rlike(counter), F.concat(F.regexp_replace("_base", counter, "$1$3$2"), F.lit(".json")))
    keys = [F.concat("_base", F.lit(".json")), F.concat(F.regexp_replace("_base", r"\.[^.]+$", ""), F.lit(".json")), moved, F.col("_base")]
    asked = photos.select("path", folder.alias("_dir"), base.alias("_base")).repartition(parts, "path").distinct()
    asked = asked.select("path", "_dir", F.posexplode(F.array(*keys)).alias("_form", "_key")).where("_key IS NOT NULL").withColumn("_whole", F.col("_form") < 3).repartition(parts, "_dir", "_whole", "_key")
    best = asked.join(known, ["_dir", "_whole", "_key"]).repartition(parts, "path").groupBy("path").agg(F.min_by(F.struct("_form", "_dir", "_name"), "_form").alias("_s"))
    full = F.when(F.col("_s._dir") == "", F.col("_s._name")).otherwise(F.concat_ws("/", "_s._dir", "_s._name"))
    return photos.repartition(parts, "path").join(best.select("path", F.get(F.array(*map(F.lit, FORMS)), F.col("_s._form")).alias("form"), full.alias("sidecar")), "path", "left")


def with_overlays(memories: DataFrame) -> DataFrame:
    """memories(path): pictures with their overlay's path, and overlays that no picture took (base null).
    `<stem>-main.ext` and a bare `<stem>.ext` pair with `<stem>-overlay.ext`; the bare one first, and
    an overlay is used once."""
    stem = paths.stem(F.lower("path"))
    named = memories.select("path", F.regexp_replace(stem, "-(main|overlay)$", "").alias("_stem"), stem.rlike("-overlay$").alias("_over"), stem.rlike("-main$").alias("_full"))
    over = named.where("_over").groupBy("_stem").agg(F.min("path").alias("overlay"))
    base = named.where("NOT _over")
    first = base.groupBy("_stem").agg(F.min_by("path", F.struct("_full", "path")).alias("path"))
    paired = first.join(over, "_stem").select("path", "overlay")
    bases = base.select(F.col("path").alias("base")).join(paired.withColumnRenamed("path", "base"), "base", "left")
    used = paired.select(F.col("overlay").alias("path"))
    stranded = named.where("_over").select("path").join(used, "path", "left_anti").select(F.lit(None).cast("string").alias("base"), F.col("path").alias("overlay"))
    return bases.unionByName(stranded)


def live_pairs(files: DataFrame) -> DataFrame:
    """files(path) that are the movie of a live photo: a .mov with a .heic of the same name beside it."""
    key = [F.lower(paths.folder(F.col("path"))).alias("_dir"), F.lower(paths.stem(F.col("path"))).alias("_stem")]
    ext = paths.extension(F.col("path"))
    stills = files.where(ext == "heic").select(*key).distinct()
    return files.select("*", *key).where(ext == "mov").join(stills, ["_dir", "_stem"], "left_semi").drop("_dir", "_stem")


def reply_tree(comments: DataFrame) -> DataFrame:
    """comments(id, parent): per comment its root, depth and whether its parent is missing (then it is a
    root itself)."""
    found = graph.roots(comments.select(F.col("id").alias("node"), "parent"))
    tree = comments.select("id", "parent").join(found.withColumnRenamed("node", "id"), "id")
    return tree.select("id", "root", "depth", ((F.col("depth") == 0) & F.col("parent").isNotNull()).alias("orphan"))


def nearby(items: DataFrame, id_col: str, at: str = "at", by: list[str] | None = None, hours: float = 3) -> DataFrame:
    """Pairs (a, b) of items at most `hours` apart, within the columns of `by`, a the smaller id, with the
    distance in microseconds. Items meet in blocks of that many hours: b's block is a's or beside it,
    so the join is an equi-join, and each pair meets once."""
    by = by or []
    span = int(hours * 3_600_000_000)
    at_us = times.epoch_micros(at)
    base = items.select(F.col(id_col).alias("id"), *by, at_us.alias("us")).where("us IS NOT NULL").withColumn("block", F.floor(F.col("us") / span))
    a = base.select("*", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("ask")).alias("a")
    b = base.alias("b")
    on = (F.col("a.ask") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.us") - F.col("b.us")) <= span)
    for c in by:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.abs(F.col("a.us") - F.col("b.us")).alias("apart_us"))


def with_titles(rows: DataFrame, names: DataFrame, key: str, title: str) -> DataFrame:
    """rows with the title that another table gives for their key; of several, the first in order."""
    known = names.where(F.col(title).isNotNull()).groupBy(key).agg(F.min(title).alias(title))
    return rows.join(known, key, "left")


def by_hint(media: DataFrame, index: DataFrame, records: DataFrame) -> DataFrame:
    """media(hint) with what is recorded for their content: hint to digest, digest to record. Records are
    only believed under the digest that they name."""
    return media.join(index.select("hint", "digest"), "hint", "left").join(records, "digest", "left")


def verified(contents: DataFrame, content: str = "content", digest: str = "digest") -> DataFrame:
    """Whether each content's SHA-256 is what its record says."""
    return contents.withColumn("verified", F.sha2(F.col(content), 256) == F.col(digest))


def first_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by order; rows whose key columns are all empty are left out."""
    filled = rows.where(F.concat_ws("", *(F.col(k).cast("string") for k in key)) != "")
    return filled.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
