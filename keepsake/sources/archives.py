"""Archives as data sources: `archive_dir` lists zip and tar files, `archive_content` reads members,
`archive_records` reads the mails, XML elements, CSV rows, JSON objects or blocks of members as they stream by.

Both kinds only need seeks: the directory of a zip file is at its end. Listing costs a task an archive;
members are read in shares of an archive's bytes, so a large archive is spread over tasks, and an
archive within it is unpacked by the one task whose share it lies in. The driver only lists files.
Archives are found where executors find them too, by URI; one that can't be read is a row with
an error.
"""

from __future__ import annotations

import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY_DDL = "source_id INT, archive STRING, path STRING, size BIGINT, comp_size BIGINT, crc32 BIGINT, method INT, encrypted BOOLEAN, mod_date INT, mod_time INT, nested_in STRING, skipped STRING"
CONTENT_DDL = "source_id INT, path STRING, nested_in STRING, size BIGINT, crc32 BIGINT, method INT, content BINARY, error STRING"
RECORD_DDL = "source_id INT, path STRING, nested_in STRING, record BIGINT, raw STRING, fields ARRAY<STRING>, error STRING"
#: What rows of tables in CSV members have besides.
TABLE_DDL = "section BIGINT, title STRING, row_no BIGINT, header ARRAY<STRING>"

NESTED = re.compile(r"\.(zip|spd)$", re.IGNORECASE)
#: What an archive or a member that is no good raises.
BROKEN = (zipfile.BadZipFile, tarfile.TarError, NotImplementedError, EOFError, KeyError, OSError, zlib.error, ValueError)
#: Stored bytes of an archive that a task takes; what an unpacked archive may have in memory before it goes to a temporary file.
SHARE_BYTES, IN_MEMORY = 64 << 20, 32 << 20

#: Contents that Python hands to Spark at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


@dataclass(frozen=True)
class Guards:
    """Against archives that expand without end: how deep archives are opened within archives, how many of one
    archive's, of which size together and each. Options of the same names lift them."""

    max_depth: int = 3
    max_nested: int = 40
    max_nested_bytes: int = 6 << 30
    max_nested_each: int = 1500 << 20

    @classmethod
    def of(cls, options: dict) -> Guards:
        return cls(**{k: int(options[k]) for k in ("max_depth", "max_nested", "max_nested_bytes", "max_nested_each") if k in options})


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def archives_at(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archive itself, or of all archives below a folder, by name."""
    from pyarrow import fs

    store, path = _filesystem(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and re.search(r"\.(zip|tar|tgz|tar\.gz)$", i.path, re.IGNORECASE))


@dataclass
class Entry:
    path: str
    size: int
    comp_size: int
    crc32: int
    method: int
    encrypted: bool
    mod_date: int
    mod_time: int
    nested_in: str | None = None
    skipped: str | None = None


def _zip_entry(i: zipfile.ZipInfo, nested_in: str | None) -> Entry:
    y, mo, d, h, mi, s = i.date_time
    return Entry(i.filename, i.file_size, i.compress_size, i.CRC, i.compress_type, bool(i.flag_bits & 1), (y - 1980) << 9 | mo << 5 | d, h << 11 | mi << 5 | s // 2, nested_in)


@dataclass(frozen=True)
class Share:
    """The k-th of `parts` parts of an archive: by stored bytes, or by number if `each` members make a part."""

    k: int = 0
    parts: int = 1
    each: int = 0

    def has(self, place: int, before: int, total: int) -> bool:
        if self.each:
            return place // self.each == self.k
        return self.parts == 1 or before * self.parts // max(1, total) == self.k


def _spooled(member):
    """A seekable copy of a stream; large ones are in a temporary file of the task, gone when it is closed."""
    import shutil
    import tempfile

    held = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)
    shutil.copyfileobj(member, held, 1 << 20)
    held.seek(0)
    return held


def walk(source, name: str, password: bytes | None = None, guards: Guards = Guards(), share: Share = Share()) -> Iterator[tuple[Entry, object]]:
    """(entry, open function) of an archive's members in a share of it, and of the archives in those, within
    the guards. Archives that are left unopened are entries with the reason in `skipped`. A function
    is good until the next entry is asked for."""
    if re.search(r"\.(tar|tgz|tar\.gz)$", name, re.IGNORECASE):
        yield from _walk_tar(source, password, guards, share)
        return
    with zipfile.ZipFile(source) as z:
        yield from _walk_zip(z, None, 0, password, guards, share)


def _opened(e: Entry, opener, within: str | None, depth: int, left: list[int], password: bytes | None, guards: Guards):
    """Members of an archive in an archive, or none where a guard or the archive itself forbids it (then e
    says why)."""
    if not NESTED.search(e.path) or depth >= guards.max_depth or e.method == 99:
        return None
    if e.size > guards.max_nested_each:
        e.skipped = "size"
        return None
    if left[0] < 1 or left[1] < e.size:
        e.skipped = "budget"
        return None
    left[0], left[1] = left[0] - 1, left[1] - e.size
    return lambda: _inside(e, opener, f"{within}/{e.path}" if within else e.path, depth + 1, password, guards)


def _inside(e: Entry, opener, within: str, depth: int, password: bytes | None, guards: Guards):
    try:
        with opener() as member, _spooled(member) as held, zipfile.ZipFile(held) as z:
            yield from _walk_zip(z, within, depth, password, guards, Share())
    except (*BROKEN, RuntimeError):
        e.skipped = "unreadable"
        yield e, opener


def _walk_zip(z: zipfile.ZipFile, within: str | None, depth: int, password: bytes | None, guards: Guards, share: Share):
    infos = [i for i in z.infolist() if not i.is_dir()]
    total, before, left = sum(i.compress_size + 1 for i in infos), 0, [guards.max_nested, guards.max_nested_bytes]
    for place, i in enumerate(infos):
        mine = share.has(place, before, total)
        before += i.compress_size + 1
        e, opener = _zip_entry(i, within), (lambda i=i: z.open(i, pwd=password))
        members = _opened(e, opener, within, depth, left, password, guards)  # budgets count alike in every share
        if mine and members:
            yield from members()
        elif mine:
            yield e, opener


def _walk_tar(source, password: bytes | None, guards: Guards, share: Share):
    left, place, total = [guards.max_nested, guards.max_nested_bytes], -1, 0
    if share.parts > 1:
        total = source.seek(0, 2)
        source.seek(0)
    with tarfile.open(fileobj=source) as tar:
        for m in tar:
            if not m.isfile():
                continue
            place += 1
            e, opener = Entry(m.name, m.size, m.size, 0, 0, False, 0, 0), (lambda m=m: tar.extractfile(m))
            members = _opened(e, opener, None, 0, left, password, guards)
            if not share.has(place, m.offset, total):
                continue
            if members:
                yield from members()
            else:
                yield e, opener


@dataclass
class Part(InputPartition):
    source_id: int
    archive: str
    share: Share = Share()


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.guards = options["path"], Guards.of(options)

    def partitions(self):
        return [Part(i, a) for i, (a, _) in enumerate(archives_at(self.path))]

    def read(self, part: Part):
        store, _ = _filesystem(self.path)
        name = part.archive.rsplit("/", 1)[-1]
        try:
            with store.open_input_file(part.archive) as f:
                for e, _ in walk(f, part.archive, None, self.guards):
                    yield (part.source_id, name, e.path, e.size, e.comp_size, e.crc32, e.method, e.encrypted, e.mod_date, e.mod_time, e.nested_in, e.skipped)
        except BROKEN as problem:
            yield (part.source_id, name, *[None] * 9, f"unreadable: {type(problem).__name__}")


class ArchiveDirectory(DataSource):
    """`spark.read.format("archive_dir").load(folder)`: a row a member, nothing unpacked but nested archives.
    An archive that can't be read has a row without a path. Options: those of Guards."""

    @classmethod
    def name(cls) -> str:
        return "archive_dir"

    def schema(self) -> str:
        return ENTRY_DDL

    def reader(self, schema) -> DataSourceReader:
        return DirectoryReader(self.options)


class MemberReader(DataSourceReader):
    """Shares of archives, and the members in them that match."""

    def __init__(self, options: dict):
        self.path, self.guards = options["path"], Guards.of(options)
        self.match = re.compile(options.get("match", ""), re.IGNORECASE)
        self.password = options["password"].encode() if "password" in options else None
        self.each = int(options.get("entries_per_partition", 0))
        self.bytes = int(options.get("bytes_per_partition", SHARE_BYTES))

    def partitions(self):
        store, _ = _filesystem(self.path)
        out = []
        for i, (a, size) in enumerate(archives_at(self.path)):
            parts = 1 if re.search(r"\.(tgz|tar\.gz)$", a, re.IGNORECASE) else max(1, -(-size // self.bytes))
            if self.each and a.lower().endswith(".zip"):
                try:
                    with store.open_input_file(a) as f, zipfile.ZipFile(f) as z:
                        parts = max(1, -(-sum(not e.is_dir() for e in z.infolist()) // self.each))
                except BROKEN:
                    parts = 1  # its task tells
            out += [Part(i, a, Share(k, parts, self.each if a.lower().endswith(".zip") else 0)) for k in range(parts)]
        return out

    def rows(self, part: Part, f, e: Entry, opened):
        raise NotImplementedError

    def failed(self, part: Part, e: Entry | None, error: str):
        raise NotImplementedError

    def read(self, part: Part):
        store, _ = _filesystem(self.path)
        try:
            with store.open_input_file(part.archive) as f:
                for e, opened in walk(f, part.archive, self.password, self.guards, part.share):
                    if self.match.search(e.path):
                        yield from self.rows(part, f, e, opened)
        except BROKEN as problem:
            if part.share.k == 0:
                yield self.failed(part, None, f"unreadable: {type(problem).__name__}")


class ContentReader(MemberReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.head = int(options.get("headbytes", options.get("head_bytes", 0)))

    def rows(self, part: Part, f, e: Entry, opened):
        content, error = None, e.skipped
        try:
            if e.method == 99 and e.nested_in:
                error = "aes in a nested archive"
            elif e.method == 99:
                content, error = raw_member(f, e.path), "aes"
            else:
                with opened() as member:
                    content = member.read(self.head) if self.head else member.read()
        except RuntimeError:
            error = "locked"
        except BROKEN as problem:
            error = type(problem).__name__
        yield (part.source_id, e.path, e.nested_in, e.size, e.crc32, e.method, content, error)

    def read(self, part: Part):
        """Rows in batches of BATCH_BYTES of contents or BATCH_ROWS rows, whatever Spark takes by default."""
        import pyarrow as pa

        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
        names = [c.split(" ")[0] for c in CONTENT_DDL.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        held, size = [], 0
        for row in super().read(part):
            held.append(row)
            size += len(row[6] or b"")
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def failed(self, part: Part, e: Entry | None, error: str):
        return (part.source_id, None, None, None, None, None, None, error)


class RecordReader(MemberReader):
    """A member is read in pieces as it is inflated; what a record lacks at the end of a piece comes with the
    next one, so a task holds a piece and a record, whatever the member's size."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.kind, self.headers = options.get("records", "mbox"), options.get("headers", "false").lower() == "true"

    def rows(self, part: Part, f, e: Entry, opened):
        from . import records

        n, none = 0, (None,) * 4 * (self.kind == "tables")
        try:
            if e.method == 99:
                raise RuntimeError
            with opened() as member:
                for n, (raw, fields, *table) in enumerate(records.read(self.kind, member, self.headers), 1):
                    yield (part.source_id, e.path, e.nested_in, n - 1, raw, fields, None, *table)
        except RuntimeError:
            yield (part.source_id, e.path, e.nested_in, n, None, None, "locked", *none)
        except BROKEN as problem:
            yield (part.source_id, e.path, e.nested_in, n, None, None, type(problem).__name__, *none)

    def failed(self, part: Part, e: Entry | None, error: str):
        return (part.source_id, None, None, None, None, None, error, *(None,) * 4 * (self.kind == "tables"))


def raw_member(source, path: str) -> bytes:
    """A member's bytes as they are stored, with the AES extra field's strength and method before them."""
    info = zipfile.ZipFile(source).getinfo(path)
    source.seek(info.header_offset + 26)
    name, extra = (int.from_bytes(source.read(2), "little") for _ in range(2))
    source.seek(info.header_offset + 30 + name + extra)
    field = re.search(rb"\x01\x99\x07\x00..AE(.)(..)", info.extra, re.DOTALL)
    return (field[1] + field[2] if field else b"\x03\x08\x00") + source.read(info.compress_size)


class ArchiveContent(DataSource):
    """`spark.read.format("archive_content").option("match", r"\\.json$").load(folder)`: members with content.
    Options: match (an expression on paths), head_bytes, password, bytes_per_partition or
    entries_per_partition (for which the driver opens each archive), and those of Guards. A member
    that can't be read has a null content and an error, an archive no path either."""

    @classmethod
    def name(cls) -> str:
        return "archive_content"

    def schema(self) -> str:
        return CONTENT_DDL

    def reader(self, schema) -> DataSourceReader:
        return ContentReader(self.options)


class ArchiveRecords(DataSource):
    """`spark.read.format("archive_records").option("records", "mbox").option("match", r"\\.mbox$").load(folder)`:
    a row a record of each member: its number, and raw (a mail, an element's attributes, a JSON object, a
    block) or fields (a CSV row; a JSON object's key and the names of its array's first element). tables
    are CSV rows with section, title, row_no and header of their table. Options: records (mbox, csv,
    tables, json, xml:TAG, or after:MARK for what follows each mark), headers (true: mails without bodies), and
    those of archive_content but head_bytes. After a member's last good record comes a row with an
    error, if it ends too soon; an empty member has no row."""

    @classmethod
    def name(cls) -> str:
        return "archive_records"

    def schema(self) -> str:
        return f"{RECORD_DDL}, {TABLE_DDL}" if self.options.get("records") == "tables" else RECORD_DDL

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (ArchiveDirectory, ArchiveContent, ArchiveRecords):
        spark.dataSource.register(source)


def one_export(records: DataFrame) -> DataFrame:
    """Records of archives that are the parts of one export, as if they were one archive: a member that goes on
    in a later part goes on in number, with gaps. A source has 2^40 records of a member at most."""
    return records.withColumns({"record": F.shiftleft(F.col("source_id").cast("long"), 40) + F.col("record"), "source_id": F.lit(0)})
