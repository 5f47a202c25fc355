"""Token-id shards as sorted string tables.

A shard holds documents in key order. Keys are prefix-compressed within blocks; a sparse index
has each block's first key; a Bloom filter answers most lookups of absent keys; the footer says
where all of this lies. Layout, little-endian:

    block    entries of (shared u16, suffix length u16, value length u32, suffix, value)
    index    per block (key length u16, key, offset u64, length u64, entries u32)
    bloom    bit array, HASHES probes a key
    footer   index offset and length, bloom offset and length, entries, tokens (u64 each),
             bytes an id (u32), magic

A value is the document's ids, 2 bytes each where the vocabulary allows it, else 4. Keys are
8-byte big-endian integers with the sign bit turned, or a 1 and an UTF-8 string; null is the empty key
and so comes first, as in Spark's ascending order.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, FOOTER, ENTRY, HASHES = b"KSST0001", struct.Struct("<6QI8s"), struct.Struct("<HHI"), 7


def key_bytes(key) -> bytes:
    return b"" if key is None else b"\x01" + key.encode() if isinstance(key, str) else (int(key) + (1 << 63)).to_bytes(8, "big")


def key_value(raw: bytes, kind: str):
    return None if not raw else raw[1:].decode() if kind == "string" else int.from_bytes(raw, "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes one shard front to back; keeps a block, the index and the keys' hashes in memory."""

    def __init__(self, sink, id_bytes: int, block_bytes: int):
        self.sink, self.id_bytes, self.block_bytes = sink, id_bytes, block_bytes
        self.block, self.index, self.keys, self.at, self.tokens = [], [], [], 0, 0
        self.size, self.first, self.last = 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block.append(ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // self.id_bytes
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.sink.write(b"".join(self.block))
            self.index.append(struct.pack("<H", len(self.first)) + self.first + struct.pack("<QQI", self.at, self.size, len(self.block)))
            self.at += self.size
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray(bits // 8 + 1)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", bits) + bytes(bloom)
        self.sink.write(index + bloom)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, self.id_bytes, MAGIC))


class ShardReader:
    """Random access to one shard: footer and index are read at once, blocks when needed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, n, bloom_at, bloom_n, self.entries, self.tokens, self.id_bytes, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, self.keys, self.blocks, i = source.read_at(n, at), [], [], 0
        while i < len(raw):
            k = struct.unpack_from("<H", raw, i)[0]
            self.keys.append(raw[i + 2 : i + 2 + k])
            self.blocks.append(struct.unpack_from("<QQI", raw, i + 2 + k))
            i += 2 + k + 20
        self._bloom = (bloom_at, bloom_n)

    def _entries(self, b: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, _ = self.blocks[b]
        raw, i, key = self.source.read_at(n, at), 0, b""
        while i < n:
            shared, own, size = ENTRY.unpack_from(raw, i)
            i += ENTRY.size
            key = key[:shared] + raw[i : i + own]
            yield key, raw[i + own : i + own + size]
            i += own + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.blocks)):
            yield from self._entries(b)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key, in file order."""
        raw = self.source.read_at(self._bloom[1], self._bloom[0])
        bits = struct.unpack_from("<Q", raw)[0]
        if not all(raw[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        found: list[bytes] = []
        for b in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.blocks)):
            if self.keys[b] > key:
                break
            found += [v for k, v in self._entries(b) if k == key]
        return found


MANIFEST = "shard long, file string, n_docs long, n_tokens long, first_key binary, last_key binary"


def write_shards(
    docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, shards: int | None = None,
    block_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str | None = None, shard_bytes: int = 1 << 28,
) -> DataFrame:
    """Encode whole texts (null: empty) and write them as shards under path, in key order.

    Returns the manifest: shard long (ascending in key order), file string, n_docs, n_tokens long,
    first_key, last_key binary, in a table of the shared folder. Documents are range-partitioned by key
    and a hash of the text into `shards` tasks (as many as shuffle partitions if not said), so a key that
    holds many rows is spread too, its rows in the order of that hash; an empty table gives no
    shard. A task ends a shard once it has shard_bytes of entries and begins the next, so files and
    the keys in memory don't grow with the table. A file name holds the task attempt, and the
    manifest only names files of attempts that ended well, so a lost executor costs its own
    shards again and nothing else. Other columns are not read."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        import pyarrow as pa

        own, out, sink, done = tokens.encoder(tokenizer, tokenizer_dir), None, None, []
        width = 2 if own.width == "H" else 4
        end = end_id.to_bytes(width, "little")
        task = TaskContext.get()
        fs, folder = common.local_fs(path)

        def close() -> None:
            out.close()
            sink.close()
            done.append(((task.partitionId() << 32) + len(done), file, len(out.keys), out.tokens, out.keys[0], out.keys[-1]))

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(keys), 256):
                for k, v in zip(keys[i : i + 256], own.batch(texts[i : i + 256]), strict=True):
                    if out is None:
                        file = f"shard-{task.partitionId():05d}-{len(done):05d}-{task.taskAttemptId()}.sst"
                        fs.create_dir(folder, recursive=True)
                        sink = fs.open_output_stream(f"{folder}/{file}")
                        out = ShardWriter(sink, width, block_bytes)
                    out.add(key_bytes(k), v + end)
                    if out.at + out.size >= shard_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        if done:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["shard", "file", "n_docs", "n_tokens", "first_key", "last_key"])

    rows = docs.select(F.col(id_col).alias("key"), common.text_of(text_col).alias("text")).withColumn("salt", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "key", "salt").sortWithinPartitions("key", "salt").select("key", "text")
    return common.stash(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, path: str, kind: str = "bigint", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, from the files alone: key, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian 32-bit integers), and the ids themselves if asked."""
    spark: SparkSession = manifest.sparkSession
    ids = ", ids array<int>" if with_ids else ""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        fs, folder = common.local_fs(path)
        for b in batches:
            for shard, file in zip(b.column("shard").to_pylist(), b.column("file").to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{file}") as source:
                    reader, start, rows = ShardReader(source), 0, []
                    for key, value in reader:
                        v = np.frombuffer(value, "<u2" if reader.id_bytes == 2 else "<u4").astype("<u4")
                        rows.append((shard, key_value(key, kind), start, len(v), zlib.crc32(v.tobytes()), *([v.astype("int32")] if with_ids else [])))
                        start += len(v)
                        if len(rows) == (200 if with_ids else 20_000):
                            yield batch(rows, pa)
                            rows = []
                    if rows:
                        yield batch(rows, pa)

    def batch(rows, pa):
        kinds = [pa.int64(), pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=["shard", id_col, "begin", "n_tokens", "ids_crc32", "ids"][: len(rows[0])])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = manifest.select("shard", "file").repartition(n).mapInArrow(read, f"shard long, {id_col} {kind}, begin long, n_tokens long, ids_crc32 long{ids}")
    # One row a shard, a shard being shard_bytes of ids or a task: the running sum over them is the only
    # step that isn't spread out. Spark broadcasts it only while its size is below its own threshold.
    before = manifest.selectExpr("shard", "CAST(coalesce(sum(n_tokens) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before")
    out = docs.join(before, "shard")
    return out.select(id_col, (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def lookup(manifest: DataFrame, path: str, keys: list) -> dict:
    """ids of a few keys, absent ones left out: shards whose first and last key are around a key are opened,
    there Bloom filter and binary search answer. A repeated key may be in several shards."""
    import numpy as np

    fs, folder = common.local_fs(path)
    found: dict = {}
    if not keys:
        return found
    around = reduce(Column.__or__, (F.lit(bytearray(key_bytes(k))).between(F.col("first_key"), F.col("last_key")) for k in keys))
    for file, first, last in manifest.where(around).orderBy("shard").select("file", "first_key", "last_key").collect():
        with fs.open_input_file(f"{folder}/{file}") as source:
            reader = ShardReader(source)
            for k in keys:
                if bytes(first) <= key_bytes(k) <= bytes(last):
                    for v in reader.get(key_bytes(k)):
                        found.setdefault(k, []).append(np.frombuffer(v, "<u2" if reader.id_bytes == 2 else "<u4").tolist())
    return found


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode documents, write shards, read them back."""
    path = common.scratch_path(spark, "shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, path), path, kind=dict(docs.dtypes)["doc_id"])
