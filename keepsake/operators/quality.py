"""Accounting: every entry in exactly one bucket, what is covered, what is trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import names, paths, times

#: Buckets of the reconciliation, the first that claims an entry has it.
LADDER = ["media", "table", "messages", "view", "sidecar", "orphan_sidecar", "opened", "part", "nested", "noise", "empty", "unread"]
NOISE = r"(?i)(^|/)(\.ds_store|thumbs\.db|desktop\.ini|__macosx/.*|\._[^/]*)$"


def reconcile(entries: DataFrame, used: DataFrame) -> DataFrame:
    """entries(path, size) with bucket. used(path, bucket): what readers claim; of several claims the one
    first on the ladder counts, claims on other paths none. The buckets add up to all entries."""
    place = F.array_position(F.array(*map(F.lit, LADDER)), F.col("bucket"))
    claims = used.withColumn("_p", place).where("_p > 0").groupBy("path").agg(F.min("_p").alias("_p"))
    own = F.when(F.col("path").rlike(NOISE), "noise").when(F.col("size") <= 2, "empty").otherwise("unread")
    claimed = F.get(F.array(*map(F.lit, LADDER)), (F.col("_p") - 1).cast("int"))
    return entries.join(claims, "path", "left").withColumn("bucket", F.coalesce(claimed, own)).drop("_p")


def bucket_totals(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def read_share(reconciled: DataFrame) -> DataFrame:
    """Entries read, in all and in percent."""
    one = reconciled.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bucket") == "unread").alias("unread"))
    return one.select("total", "unread", F.floor((F.col("total") - F.col("unread")) * 100 / F.col("total") + 0.5).alias("percent"))


def unread_report(entries: DataFrame, area: Column, least: int = 40, share: float = 0.25, top: int = 5) -> DataFrame:
    """The areas with most unread entries, if the whole has enough of them to be worth a report."""
    per = entries.groupBy(area.alias("area")).agg(F.count_if(F.col("bucket") == "unread").alias("unread"), F.count(F.lit(1)).alias("entries"))
    whole = per.agg(F.sum("unread").alias("_u"), F.sum("entries").alias("_n")).where((F.col("_u") >= least) & (F.col("_u") >= F.col("_n") * share))
    return per.where("unread > 0").join(F.broadcast(whole)).drop("_u", "_n").orderBy(F.desc("unread"), "area").limit(top)  # one row


def coverage(catalogue: DataFrame, seen: DataFrame, name: str, pattern: str, value: str) -> DataFrame:
    """catalogue(name, pattern) with found and how many seen values match. The catalogue is a small table
    of the program, not of the data: its rows become expressions over one scan."""
    rows = [(r[name], r[pattern]) for r in catalogue.collect()]
    counts = seen.agg(*(F.count_if(F.col(value).rlike(p)).alias(str(i)) for i, (_, p) in enumerate(rows)))
    table = F.array(*(F.struct(F.lit(n).alias(name), F.col(f"`{i}`").alias("n")) for i, (n, _) in enumerate(rows)))
    return counts.select(F.inline(table)).withColumn("found", F.col("n") > 0)


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def crosstab(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """Both, only the left, only the right, neither."""
    case = F.when(left & right, "both").when(left, "left").when(right, "right").otherwise("neither")
    return rows.groupBy(case.alias("case")).agg(F.count(F.lit(1)).alias("n"))


def dates_trusted(rows: DataFrame, at: str) -> DataFrame:
    """Whether archive dates tell when things happened: eight days and rows at least, no day with over
    half of them."""
    days = rows.where(F.col(at).isNotNull()).groupBy(times.day(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    one = days.agg(F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return one.withColumn("trusted", (F.col("days") >= 8) & (F.col("total") >= 8) & (F.col("most") * 2 <= F.col("total")))


def structure(entries: DataFrame, size: str = "size") -> DataFrame:
    """Per masked folder: files, bytes and files by extension; nothing that a person wrote."""
    folder, ext = names.mask_folder(paths.folder(F.col("path"))), paths.extension(F.col("path"))
    per = entries.groupBy(folder.alias("folder"), ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ext", "n"))), lambda x: F.concat_ws(":", x["ext"], x["n"].cast("string"))), ",")
    return per.groupBy("folder").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), kinds.alias("extensions"))


def one_per_shape(entries: DataFrame) -> DataFrame:
    """One entry, the first by path, of each masked name."""
    return entries.groupBy(names.mask_path(F.col("path")).alias("shape")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))


def golden(expected: DataFrame, found: DataFrame, key: list[str], value: str) -> DataFrame:
    """Figures against those of a trusted run, by key: same, changed, missing (which fails) or new (which is only
    reported), with both values."""
    a, b = expected.select(*key, F.col(value).alias("expected"), F.lit(True).alias("_a")), found.select(*key, F.col(value).alias("found"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("expected").eqNullSafe(F.col("found")), "same").otherwise("changed")
    return both.select(*key, "expected", "found", status.alias("status"), F.col("_b").isNull().alias("fails"))
