"""What the training-data operators share: scratch tables, whole-text words, components."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every contract takes them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session. Where that is unset a session of one
    machine, as in tests, takes a new temporary folder; on a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="keepsake-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/keepsake-{name}-{uuid.uuid4().hex}"


#: Stored tables of this process: a weak reference to the relation that every plan over a table holds, and its path.
_STORED: list[tuple] = []


def stash(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED.append((spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation()), path))
    return out


def sweep(spark: SparkSession) -> int:
    """Delete the stored tables that no DataFrame refers to any more, neither itself nor one made of it; returns
    how many went. Tables that may still be read stay, so it may be called at any time."""
    gc.collect()
    spark._jvm.System.gc()
    gone = [path for ref, path in _STORED if ref.get() is None]
    discard(*gone)
    _STORED[:] = [(ref, path) for ref, path in _STORED if path not in gone]
    return len(gone)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, Python in tasks gets at most so many rows at once: less memory for long texts, same results."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_fs(uri: str):
    """(filesystem, path) of a folder in the shared store, for tasks that write or read files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def discard(*paths: str) -> None:
    """Delete scratch tables that no DataFrame still to be computed reads."""
    from pyarrow import fs as pafs

    for p in paths:
        fs, folder = local_fs(p)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


def free_name(taken: Iterable[str], name: str) -> str:
    """name, or name with underscores before it when a column is called that already."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


#: A sieve has this many bits, whatever the keys: 4 MB in 4 KB rows.
SIEVE_BITS, ROW_BITS = 25, 15


def sieve(keys: DataFrame, *cols: str):
    """Tells rows that can't have one of the keys (columns cols) from those that may, by bits of a hash.

    Returns split(df, *cols) -> (rows that may, rows that can't). The bits are one broadcast of at
    most 4 MB, so few rows may where there are few keys, and all rows may where there are very many:
    what may has to be joined with the keys in any case."""

    def place(names) -> Column:
        return F.xxhash64(*names).bitwiseAND((1 << SIEVE_BITS) - 1)

    at = keys.select(place(cols).alias("p")).select(F.shiftright("p", ROW_BITS).alias("_sieve"), F.col("p").bitwiseAND((1 << ROW_BITS) - 1).alias("bit"))
    table = stash(at.groupBy("_sieve").agg(F.bitmap_construct_agg("bit").alias("_bits")), "sieve")

    def split(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
        p = place(names or cols)
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright(p.bitwiseAND((1 << ROW_BITS) - 1), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), p.bitwiseAND(7).cast("int"))) > 0, F.lit(False))
        met = df.withColumn("_sieve", F.shiftright(p, ROW_BITS)).join(F.broadcast(table), "_sieve", "left").withColumn("_may", there).drop("_sieve", "_bits")
        return met.where("_may").drop("_may"), met.where("NOT _may").drop("_may")

    return split


def forest(a, b):
    """(node, root) of a spanning forest of the pairs (numpy arrays of ids): the same components with a
    link a node, whatever the pairs."""
    import numpy as np

    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) per node that has a link,
    root being the component's smallest node. Each round takes the smallest label among the
    neighbours and then the label's own label, so labels travel over doubling distances; each
    round's labels are a table in the shared folder. Links and labels never pass the driver."""
    both = stash(
        links.select("a", "b").where("a <> b").unionAll(links.selectExpr("b AS a", "a AS b").where("a <> b")).distinct(),
        "links",
    )
    label = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "label")
    for _ in range(rounds):
        near = (
            both.join(label.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = stash(
            step.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("root"), F.col("root").alias("was")),
            "label",
        )
        moved = new.where("root <> was").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
