"""Best-fit packing of token pieces into sequences, by hierarchical residual packing."""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

_MEMBER = "struct<doc_id: {kind}, piece: int, start: long, length: long, ids_crc32: long, offset: long>"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str | None = None) -> DataFrame:
    """One row a piece: a document's ids with end_id after them, cut only beyond capacity, into
    pieces of capacity ids of which the first holds what is left over."""
    kind = dict(docs.dtypes)[id_col]

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        own = tokens.encoder(tokenizer, tokenizer_dir)
        for b in batches:
            keys, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i in range(0, len(keys), 256):
                for k, ids in zip(keys[i : i + 256], own.batch(texts[i : i + 256]), strict=True):
                    v = np.append(np.frombuffer(ids, "<u2" if own.width == "H" else "<u4"), end_id).astype("<u4")
                    n, at = -(-len(v) // capacity), 0
                    for p in range(n):
                        end = len(v) - (n - 1 - p) * capacity
                        rows.append((k, p, at, end - at, zlib.crc32(v[at:end].tobytes())))
                        at = end
            if rows:
                kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of positions. A bit for each residual that some bin has finds the
    tightest bin that still takes the item."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        fits = rooms >> sizes[i]
        if fits:
            room = (fits & -fits).bit_length() - 1 + sizes[i]
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        left = room - sizes[i]
        by_room.setdefault(left, []).append(k)
        rooms |= 1 << left
    return bins


def pack(items: DataFrame, capacity: int = 2048, fan_in: int = 8, items_per_part: int = 50_000, carry: int = 256) -> DataFrame:
    """Assign pieces to sequences of at most capacity ids.

    Round 0 packs each partition (items_per_part pieces at most on average) best-fit decreasing. After
    best fit no two bins of a partition fit together, so it has at most one that is at most half
    full, and what merges later has such a bin in it. If there are s of those in all partitions, no more than s
    fuller bins can take one: the small bins go on as items, members along, and the s emptiest of all
    others that have room for the smallest of them, `carry` at least. That loses nothing: where a
    small bin is left in the end, one of those s took none and has no room for it, and a bin that
    was closed has no more. Rounds are over fan_in times fewer partitions at least, down to one; a round has at most
    twice as many items as the one before has partitions, so the last one's input is bounded too.
    A bin has at most capacity members, so rows stay bounded.
    Pieces of capacity ids are sequences at once.

    Returns the pieces with sequence_id (unique, any number) and offset. Empty input: no rows."""
    kind = dict(items.dtypes)["doc_id"]
    member = _MEMBER.format(kind=kind)
    schema = f"bin long, load long, members array<{member}>"

    def round_of(number: int):
        def run(batches):
            import pyarrow as pa

            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            loads, members = t.column("load").to_pylist(), t.column("members").to_pylist()
            made = [(sum(loads[i] for i in b), [m for i in b for m in members[i]]) for b in best_fit(loads, capacity)]
            for _, held in made:
                at = 0
                for m in held:
                    m["offset"], at = at, at + m["length"]
            base = number << 54 | TaskContext.get().partitionId() << 32
            for i in range(0, len(made), 2000):
                part = made[i : i + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + i + k for k in range(len(part))], pa.int64()),
                        pa.array([n for n, _ in part], pa.int64()),
                        pa.array([m for _, m in part], t.schema.field("members").type),
                    ],
                    names=["bin", "load", "members"],
                )

        return run

    one = items.select(F.col("length").alias("load"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))).alias("members"))
    small = one.where(F.col("load") < capacity)
    parts = max(1, -(-small.count() // items_per_part))
    packed, number, open_ = [], 0, small
    while True:
        # dealt by content, so a task that runs again gets the same items
        dealt = open_.repartition(parts, F.xxhash64("members")) if parts > 1 else open_.repartition(1)
        bins = common.stash(dealt.sortWithinPartitions("load", F.xxhash64("members")).mapInArrow(round_of(number), schema), "bins")
        if parts == 1:
            packed.append(bins.select("bin", "members"))
            break
        few = F.col("load") * 2 <= capacity
        small = bins.where(few).agg(F.count(F.lit(1)).alias("n"), F.min("load").alias("least")).first()
        if not small.n:
            packed.append(bins.select("bin", "members"))
            break
        others = bins.where(~few & (F.col("load") + small.least <= capacity)).select("load", "bin").orderBy("load", "bin").limit(max(small.n, carry)).select("bin")
        others = common.stash(others, "open")
        packed.append(bins.where(~few).join(others, "bin", "left_anti").select("bin", "members"))
        open_ = bins.where(few).unionByName(bins.where(~few).join(others, "bin", "left_semi")).select("load", "members")
        number, parts = number + 1, max(1, min(parts // fan_in, -(-(small.n + max(small.n, carry)) // items_per_part)))
    full = one.where(F.col("load") >= capacity).select((-F.lit(1) - F.monotonically_increasing_id()).alias("bin"), "members")
    for p in packed:
        full = full.unionAll(p)
    placed = full.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m"))
    return placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, **kw) -> DataFrame:
    """Pieces of whole texts (null: empty, one end id), packed. Rows may repeat: each is packed.

    A text longer than a sequence is cut into pieces of whole sequences, the first may be shorter. Bins of
    equal room are told apart by which was opened first, items of equal length by a hash of their
    content. A null id is carried along; other columns are not read, whatever their names; an empty
    table gives none."""
    return pack(common.stash(pieces(docs, capacity), "pieces"), capacity, **kw)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
