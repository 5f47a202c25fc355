"""A library that later exports are appended to, and states that later changes win.

Tables are kept by batch: each batch of a stream writes its own part, under its own number, from its rows
and the parts before it. A batch that runs again finds the same parts before it and writes the same part
in its place, so nothing is there twice and nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import duplicates, graph
from keepsake.tables import scratch_path

#: Parts of what has been seen: a batch reads those that its own keys fall in.
BUCKETS = 64


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def _parts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What is written below path, of batches before a number if given; None where there is nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    parts = spark.read.parquet(path)
    return parts if before is None else parts.where(F.col("batch") < before)


def append_batch(batch: DataFrame, number: int, table: str, key: list[str], order: list[str]) -> None:
    """Write what of a batch of entries is new: of its entries with one key the first by order, unless an
    earlier batch had the key. Entries with a null in the key are always new.

    key holds what tells downloads apart too, so a part that repeats another, or the same archive
    opened again, adds nothing. Keys are kept by bucket beside the entries, so a small batch reads
    a small share of them."""
    spark = batch.sparkSession
    fresh = duplicates.first_of_parts(batch, key, order)
    seen = _parts(spark, f"{table}/seen", number)
    if seen is not None:
        known = seen.select("bucket", *key)
        fresh = fresh.withColumn("bucket", _bucket(key)).join(known, ["bucket", *key], "left_anti").drop("bucket")
    fresh.write.mode("overwrite").parquet(f"{table}/entries/batch={number}")
    written = spark.read.schema(fresh.schema).parquet(f"{table}/entries/batch={number}").dropna(subset=key)
    written.select(*key, _bucket(key).alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/seen/batch={number}")


def append(entries: DataFrame, table: str, checkpoint: str, key: list[str], order: list[str]) -> None:
    """Append all that a stream of entries has now, and stop."""
    put = lambda batch, number: append_batch(batch, number, table, key, order)
    entries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def library(spark: SparkSession, table: str) -> DataFrame:
    """All entries, with the number of the batch that brought them."""
    return spark.read.parquet(f"{table}/entries").withColumn("batch", F.col("batch").cast("long"))


def current(spark: SparkSession, table: str, same: list[str], provider: str) -> DataFrame:
    """The entries that stay when a provider's newest batch replaces its older ones: all of the newest, and of
    the older ones what the newest lacks. Replaced again at each reading, so the table itself only grows."""
    return duplicates.superseded(library(spark, table), same, provider, "batch")


def compact(spark: SparkSession, table: str, target: str) -> None:
    """A copy of the table whose batches are one file a bucket of seen keys; numbers stay, so streams go on
    with it."""
    library(spark, table).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{target}/entries")
    spark.read.parquet(f"{table}/seen").repartition("batch", "bucket").write.mode("overwrite").partitionBy("batch", "bucket").parquet(f"{target}/seen")


# ---- states: links between people, decisions about files


def run_states(changes: DataFrame, table: str, checkpoint: str, key: str, order: list[str]) -> None:
    """Take in all that a stream of changes(key, order, ...) has now, and stop. The stream's state holds the
    latest change of each key, by order; a change that comes late loses to a later one that came
    before it. Each batch writes the keys that it changed."""
    rest = [c for c in changes.columns if c != key]
    latest = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("change"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def states(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The latest change of each key."""
    parts = spark.read.parquet(table)
    return parts.groupBy(key).agg(F.max_by("change", "batch").alias("change")).select(key, "change.*")


def import_states(own: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Two tables of states as one: what is imported replaces what was there."""
    both = own.withColumn("_from", F.lit(0)).unionByName(imported.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_from")]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_from").alias("_r")).select(key, "_r.*")


def people(links: DataFrame) -> DataFrame:
    """(node, root, depth) of links(node, parent) in force: a link to nobody is none, chains are followed."""
    return graph.roots(links.select("node", "parent"))


def folder(spark: SparkSession) -> tuple[str, str]:
    """A table's place and a checkpoint's, in the shared folder."""
    return scratch_path(spark, "library"), scratch_path(spark, "stream")
