"""Work that can be called off: jobs run under a tag, and what an interrupted one has written goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.sources.archives import _filesystem


class Cancelled(RuntimeError):
    """The work was called off; nothing of it is left."""


def write_all_or_nothing(df: DataFrame, path: str, tag: str) -> None:
    """Write df as Parquet below path, under a tag by which another thread may call it off. Tasks write beside
    the place and the result is moved there at the end: path is there whole or not at all. Raises
    Cancelled where the tag was cancelled; other errors pass through, and leave nothing either."""
    spark = df.sparkSession
    context = spark.sparkContext
    store, place = _filesystem(path)
    beside = f"{place}.partial-{tag}"
    context.addJobTag(tag)
    try:
        df.write.mode("overwrite").parquet(f"{path}.partial-{tag}")
    except Exception as problem:
        _drop(store, beside)
        if "cancel" in str(problem).lower():
            raise Cancelled(tag) from problem
        raise
    finally:
        context.removeJobTag(tag)
    store.move(beside, place)


def _drop(store, place: str) -> None:
    from pyarrow import fs

    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


def cancel(spark: SparkSession, tag: str) -> None:
    """Call off all jobs under the tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
