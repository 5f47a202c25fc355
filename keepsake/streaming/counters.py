"""Daily counters of a stream of events, kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepsake.functions import times
from keepsake.operators import web
from keepsake.tables import scratch, scratch_path


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files under path as a stream, new ones as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def run_counters(events: DataFrame, table: str, checkpoint: str, dims: list[str], at: str = "ts") -> None:
    """Count all there is now by day and dimension, and stop. The state holds a row a counter. Each
    batch writes the counters that it changed under its own number, so a batch that runs again
    replaces what it wrote; read_counters takes the latest of each."""
    counted = web.counters(events.withColumn("day", times.day(at)), "day", dims)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number:09d}")

    query = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def read_counters(spark: SparkSession, table: str, keep_days: int | None = None) -> DataFrame:
    """(day, dim, value, n), the latest count of each; only the last keep_days days if given."""
    rows = spark.read.parquet(table)
    latest = rows.groupBy("day", "dim", "value").agg(F.max_by("n", "batch").alias("n"))
    if keep_days is None:
        return latest
    newest = latest.agg(F.date_sub(F.max("day").cast("date"), keep_days).alias("_from"))
    return latest.join(F.broadcast(newest)).where(F.col("day").cast("date") > F.col("_from")).drop("_from")  # one row


def count_available(spark: SparkSession, path: str, schema: StructType, dims: list[str], at: str = "ts") -> DataFrame:
    """Counters of all events under path, by one run of the stream."""
    scratch(spark)
    table, checkpoint = scratch_path(spark, "counters"), scratch_path(spark, "stream")
    run_counters(event_stream(spark, path, schema), table, checkpoint, dims, at)
    return read_counters(spark, table)


def first_seen(entries: DataFrame, key: list[str]) -> DataFrame:
    """The streaming twin of taking each entry of a download once."""
    return entries.dropDuplicates(key)
