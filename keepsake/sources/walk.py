"""A folder's files, listed by tasks: a round lists all folders that the round before found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.tables import stash

from .archives import _filesystem

FOUND = "path string, folder boolean, bytes long, mtime timestamp, error string"
#: Folders that a task lists.
EACH = 64


def walk(spark: SparkSession, root: str, recurse: bool = True, rounds: int = 200) -> DataFrame:
    """(path, bytes, mtime, ext, category, error) of the files below root, paths from there.

    A folder or a file that can't be read is a row of category `error`, and the others go on. Each
    round is a table in the shared folder, so neither folders nor files pass the driver. Links to
    folders aren't followed."""

    def listed(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = _filesystem(root)
        local = isinstance(store, fs.LocalFileSystem)
        for b in batches:
            for folder in b.column(0).to_pylist():
                try:
                    rows = _local(base, folder) if local else _stored(store, base, folder)
                except OSError as problem:
                    rows = [(folder, False, 0, None, str(problem))]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()), strict=True)], names=["path", "folder", "bytes", "mtime", "error"])

    parts, frontier = [], spark.createDataFrame([("",)], "path string")
    for _ in range(rounds):
        found = stash(frontier.mapInArrow(listed, FOUND), "walk")
        parts.append(found.where("NOT folder").drop("folder"))
        folders = found.where("folder").select("path")
        n = folders.count() if recurse else 0
        if not n:
            break
        frontier = folders.repartition(-(-n // EACH))
    else:
        raise RuntimeError(f"folders are deeper than {rounds}")
    ext = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    return reduce(DataFrame.unionByName, parts).select("path", "bytes", "mtime", ext.alias("ext"), F.when(F.col("error").isNotNull(), "error").alias("category"), "error")


def _local(base: str, folder: str) -> list[tuple]:
    import datetime
    import os

    rows = []
    with os.scandir(f"{base}/{folder}" if folder else base) as entries:
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    rows.append((path, True, 0, None, None))
                elif e.is_symlink() and not os.path.exists(e.path):
                    rows.append((path, False, 0, None, "a link to nothing"))
                elif e.is_file():
                    s = e.stat()
                    rows.append((path, False, s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC), None))
            except OSError as problem:
                rows.append((path, False, 0, None, str(problem)))
    return rows


def _stored(store, base: str, folder: str) -> list[tuple]:
    from pyarrow import fs

    at = f"{base}/{folder}" if folder else base
    infos = store.get_file_info(fs.FileSelector(at, recursive=False))
    return [(f"{folder}/{i.base_name}" if folder else i.base_name, i.type == fs.FileType.Directory, max(0, i.size or 0), i.mtime, None) for i in infos]
