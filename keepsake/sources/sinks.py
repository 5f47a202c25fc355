"""Writing a library out: files in folders, zip files, tables as JSON, work that can be taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.tables import stash

from .archives import _filesystem


def write_files(placed: DataFrame, root: str) -> DataFrame:
    """placed(target, content) as files below root, by tasks; returns (target, status, error). A file that
    fails is a row with its error, the others go on; each is written beside its place and then
    moved there, so nobody sees half a file and a task may run twice."""

    def run(batches):
        import pyarrow as pa

        store, base = _filesystem(root)
        for b in batches:
            out = []
            for target, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    path = f"{base}/{target}"
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(f"{path}.part") as f:
                        f.write(content)
                    store.move(f"{path}.part", path)
                    out.append((target, "written", None))
                except (OSError, ValueError) as problem:
                    out.append((target, "failed", str(problem)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, names=["target", "status", "error"])

    return stash(placed.select("target", "content").mapInArrow(run, "target string, status string, error string"), "written")


#: Members and bytes after which a zip file is closed and the next one begun.
ZIP_MEMBERS, ZIP_BYTES = 10_000, 256 << 20


def write_zips(placed: DataFrame, root: str, name: str = "export") -> DataFrame:
    """placed(target, content) as zip files of each partition below root; returns (file, entries, bytes). Members
    are written as they come, a content at a time; a file is followed by the next one after ZIP_MEMBERS members or
    ZIP_BYTES bytes, because writers and readers hold a file's directory in memory."""

    def run(batches):
        import zipfile

        import pyarrow as pa
        from pyspark import TaskContext

        store, base = _filesystem(root)
        part, attempt, k, sink, out = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None, None

        def closed():
            out.close()
            sink.close()
            store.move(f"{base}/{file}.part-{attempt}", f"{base}/{file}")
            return pa.RecordBatch.from_pydict({"file": [file], "entries": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for target, content in zip(b.column(0), b.column(1), strict=True):
                if out is None:
                    file, n, size = f"{name}-{part:05d}{f'-{k:03d}' if k else ''}.zip", 0, 0
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/{file}.part-{attempt}")
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = content.as_py() or b""
                out.writestr(target.as_py(), data)
                n, size = n + 1, size + len(data)
                if n >= ZIP_MEMBERS or size >= ZIP_BYTES:
                    yield closed()
                    out, k = None, k + 1
        if out is not None:
            yield closed()

    return stash(placed.select("target", "content").mapInArrow(run, "file string, entries long, bytes long"), "zips")


#: Bytes of lines that a part of an export takes.
PART_BYTES = 32 << 20


def write_streams(lines: DataFrame, root: str, name: str = "export", parts: int | None = None, whole: str | None = None) -> DataFrame:
    """lines(target, place, line) as members of zip files below root, a zip file a partition; returns (file,
    entries, bytes). A member's lines (strings, written as they are) are in order of place; they come
    sorted and are written as they come. Partitions are ranges of target and place, as many as PART_BYTES
    of lines each make unless parts is given: a member that is larger goes on under its name in the next zip
    file, in order of their names, as exports in parts do, so neither writing nor reading is one task's.
    archives.one_export puts such records together. Members whose path is like whole aren't cut: a part of
    a JSON text or of a table can't be read without what comes before it."""

    def run(batches):
        import zipfile

        import pyarrow as pa
        from pyspark import TaskContext

        store, base = _filesystem(root)
        file, n, size, open_, member, sink, out = f"{name}-{TaskContext.get().partitionId():05d}.zip", 0, 0, None, None, None, None
        part = f"{base}/{file}.part-{TaskContext.get().taskAttemptId()}"
        for b in batches:
            for target, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(part)
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, allowZip64=True, compresslevel=1)
                if target != open_:
                    if member is not None:
                        member.close()
                    member, open_, n = out.open(target, "w", force_zip64=True), target, n + 1
                data = (line or "").encode()
                member.write(data)
                size += len(data)
        if out is not None:
            member.close()
            out.close()
            sink.close()
            store.move(part, f"{base}/{file}")
            yield pa.RecordBatch.from_pydict({"file": [file], "entries": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    held = lines.where("target IS NOT NULL").select("target", "place", "line")
    if parts is None:
        parts = max(1, -(-(held.agg(F.sum(F.octet_length("line"))).first()[0] or 0) // PART_BYTES))
    cut = F.col("place") if whole is None else F.when(~F.col("target").rlike(whole), F.col("place"))
    dealt = held.repartitionByRange(parts, F.col("target"), cut).sortWithinPartitions("target", "place")
    return stash(dealt.select("target", "line").mapInArrow(run, "file string, entries long, bytes long"), "zips")


def save_library(library: dict[str, DataFrame], path: str, version: int) -> None:
    """Each table as compressed JSON lines, with the version of the readers that made it."""
    for name, table in library.items():
        table.withColumn("parse_version", F.lit(version)).write.json(f"{path}/{name}", mode="overwrite", compression="gzip")


def load_library(spark: SparkSession, path: str, schemas: dict[str, str], version: int) -> dict[str, DataFrame]:
    """Tables saved by readers of this version; older rows are stale and left out."""
    return {name: spark.read.schema(f"{ddl}, parse_version INT").json(f"{path}/{name}").where(F.col("parse_version") == version).drop("parse_version") for name, ddl in schemas.items()}
