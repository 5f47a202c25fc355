"""Several downloads, or several pages of a table, as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.tables import stash


def union_sources(parts: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows of all sources, with where they come from; columns that a source lacks are null."""
    named = [df.withColumn(source, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def merge_pages(pages: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Pages of one table, `name (1)`, `name (2)`, that have the same columns: a union of distinct rows. A
    table of one page keeps its repeated rows."""
    import re

    groups: dict[tuple, list[DataFrame]] = {}
    for name, df in pages.items():
        groups.setdefault((re.sub(r"\s*\(\d+\)$", "", name), tuple(df.columns)), []).append(df)
    return {stem: dfs[0] if len(dfs) == 1 else reduce(DataFrame.unionByName, dfs).distinct() for (stem, _), dfs in groups.items()}


#: Page numbers are kept above this in row numbers of merged tables.
PAGE = 1 << 40


def merge_cells(cells: DataFrame) -> DataFrame:
    """cells(source_id, table_id, title, row_no, col_no, col_name, value) with pages of one table as one: tables of a
    source whose names only differ in a bracketed number and that have the same columns. Their distinct
    rows stay, in order of page and row, numbered by both; other tables keep repeated rows. A row
    is told by a hash of its cells, so cells are moved once and rows are never put together."""
    keys = ["source_id", "table_id"]
    stem = F.regexp_replace("table_id", r"\s*\(\d+\)(?=\.[A-Za-z0-9]+(#|$)|#|$)", "")
    page = F.coalesce(F.regexp_extract("table_id", r"\((\d+)\)(?:\.[A-Za-z0-9]+)?(?:#|$)", 1).try_cast("long"), F.lit(0))
    shapes = cells.groupBy(*keys, "col_no", "col_name").agg(F.lit(1)).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("col_no", "col_name"))).alias("_shape"))
    shapes = shapes.select(*keys, stem.alias("_stem"), page.alias("_page"), F.xxhash64("_shape").alias("_like"))
    pages = shapes.groupBy("source_id", "_stem", "_like").agg(F.count(F.lit(1)).alias("_n"), F.min_by("table_id", F.struct("_page", "table_id")).alias("_first")).where("_n > 1")
    paged = stash(shapes.join(pages, ["source_id", "_stem", "_like"]).select(*keys, "_page", "_first"), "pages")
    own = cells.join(paged, keys)
    # the sum of a row's cells' hashes is the same in any order, and so in any partial aggregate
    one = F.xxhash64("col_no", F.coalesce("value", F.lit("")), F.col("value").isNull()).cast("decimal(38,0)")
    two = F.xxhash64(F.lit(7), "col_no", F.coalesce("value", F.lit("")), F.col("value").isNull()).cast("decimal(38,0)")
    rows = own.groupBy(*keys, "_first", "_page", "row_no").agg(F.sum(one).alias("_h1"), F.sum(two).alias("_h2"))
    kept = rows.groupBy("source_id", "_first", "_h1", "_h2").agg(F.min(F.struct("_page", "table_id", "row_no")).alias("k")).select("source_id", F.col("k.table_id").alias("table_id"), F.col("k.row_no").alias("row_no"))
    merged = own.join(kept, [*keys, "row_no"]).withColumns({"table_id": F.col("_first"), "row_no": F.col("_page") * PAGE + F.col("row_no")}).select(*cells.columns)
    return cells.join(paged.select(*keys), keys, "left_anti").unionByName(merged)


def running_total(rows: DataFrame, order: list[str], value: str, name: str = "running", parts: int | None = None) -> DataFrame:
    """rows with the sum of value up to and with each, in order, over all rows. Rows are range-partitioned
    in order; parts add up by themselves, and only their sums, a row each, meet in one window."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def within_budget(entries: DataFrame, order: list[str], size: str, most_bytes: int, most_entries: int | None = None) -> DataFrame:
    """entries with taken: the longest beginning that fits both budgets."""
    summed = running_total(entries.withColumn("_one", F.lit(1).cast("long")), order, size, "running")
    taken = F.col("running") <= most_bytes
    if most_entries is not None:
        summed = running_total(summed, order, "_one", "_place")
        taken = taken & (F.col("_place") <= most_entries)
    return summed.withColumn("taken", taken).drop("_one", "_place")
