"""Duplicates, exact and alike; what to keep; what a later download supersedes."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keepsake.tables import stash

from . import graph


def exact_groups(files: DataFrame, key: list[str], size: str, order: str) -> DataFrame:
    """Groups of two rows or more with the same key and size: n, the first member, bytes to reclaim.
    Rows without a size or key are no duplicates. Counts combine before the shuffle."""
    usable = files.where(F.col(size) > 0).dropna(subset=key)
    grouped = usable.groupBy(*key, size).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return grouped.where("n > 1").withColumn("reclaimable", (F.col("n") - 1) * F.col(size))


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("files"), F.sum("reclaimable").alias("bytes"))


def three_stage(files: DataFrame, content: Column, size: str, order: str, head_bytes: int = 65_536) -> DataFrame:
    """files with sha256 (null for files that have no double) and duplicate: all but the first of a group.

    The cheapest test goes first: sizes and the hashes of beginnings are told by one scan, and only files
    that agree in both are hashed whole. Contents are read where they lie: what is shuffled are ids,
    sizes and hashes."""
    head = F.xxhash64(F.substring(F.encode(content, "UTF-8"), 1, head_bytes)).alias("_head")
    light = files.where(F.col(size) > 0).select(order, size, head)
    alike = light.groupBy(size, "_head").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(size, "_head")
    likely = light.join(alike, [size, "_head"], "left_semi").select(order)
    hashed = files.join(likely, order, "left_semi").select(order, size, F.sha2(content, 256).alias("sha256"))
    groups = hashed.groupBy("sha256", size).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    members = hashed.join(groups, ["sha256", size]).select(order, "sha256", (F.col(order) > F.col("_first")).alias("duplicate"))
    return files.join(members, order, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def keep_in_groups(files: DataFrame, group: str, order: list[Column], n: int = 1) -> DataFrame:
    """files with kept: the first n of each group by order; rows without a group are all kept. Ranks are
    limited before the shuffle, so a hot group costs n rows a task."""
    ranked = files.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n)
    return ranked.drop("_r")


def _lacks(key: list[str]) -> Column:
    """Whether a part of the key is null."""
    return functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))


def superseded(files: DataFrame, key: list[str], provider: str, download: str) -> DataFrame:
    """What stays when a provider's newest download replaces the older ones: all of the newest, and of the
    older what the newest lacks by key; rows without a key always stay. newest: whether a row is
    of the newest download."""
    last = files.groupBy(provider).agg(F.max(download).alias("_last"))
    marked = files.join(F.broadcast(last), provider).withColumn("newest", F.col(download) == F.col("_last")).drop("_last")
    there = marked.where("newest").select(provider, *key).distinct()
    no_key = _lacks(key)
    older = marked.where(~F.col("newest"))
    return marked.where("newest").unionByName(older.where(no_key)).unionByName(older.where(~no_key).join(there, [provider, *key], "left_anti").select(*marked.columns))


def first_of_parts(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Entries that several parts of one download repeat, once each: the first by order. Entries with a
    null in the key pass."""
    whole = entries.dropna(subset=key)
    first = whole.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    no_key = _lacks(key)
    return first.unionByName(entries.where(no_key))


# ---- alike


def fingerprints(vectors: DataFrame, vec: str, keep: list[str]) -> DataFrame:
    """keep, bits (bit i: component i is greater than the next), mean and population sd, of vectors of two
    components or more. A print has 63 bits, so vectors of more than 64 are refused with an error."""
    e = F.col(vec).cast("array<double>")
    n = F.size(vec)
    n = F.when(n > 64, F.raise_error(F.lit("a print has 63 bits: vectors have 64 components at most")).cast("int")).otherwise(n)
    bits = F.aggregate(
        F.sequence(F.lit(0), F.least(n - 2, F.lit(62))),
        F.lit(0).cast("long"),
        lambda a, i: a + F.when(F.get(vec, i) > F.get(vec, i + 1), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")),
    )
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(e, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    read = vectors.where(n >= 2).select(*keep, bits.alias("bits"), F.col(vec), (total / n).alias("mean"))
    return read.select(*keep, "bits", "mean", F.sqrt(square / n).alias("sd"))


def _masks(bits: int, most: int) -> list[int]:
    """All numbers of `bits` bits with at most `most` of them set."""
    return [sum(1 << i for i in at) for n in range(most + 1) for at in itertools.combinations(range(bits), n)]


#: One in how many of all pairs may meet in bands; prints of a block; tasks up to which each has one pair of blocks, and
#: rows that one takes beyond; rows that are compared with a block at once, and pairs that are handed on at once.
MET, BLOCK, TASKS, ROWS_EACH, ROWS_AT_ONCE, PAIRS_AT_ONCE = 16, 8192, 1000, 32_768, 32, 100_000


def near_pairs(prints: DataFrame, node: str, distance: int = 6, least_sd: float = 12.0, mean_gap: float = 26.0, width: int = 64, most_probes: int = 512) -> DataFrame:
    """(a, b, distance): pairs within `distance` bits, both with an sd of least_sd or more, means at most
    mean_gap apart.

    Cut into m bands, two such prints differ by at most distance / m bits (rounded down) in one band at
    least. Bands are join keys; one side asks for all values so near to its own. The fewest, and so
    widest, bands are taken that cost at most most_probes such values a print (four of 16 bits for
    six bits). A pair counts in the first band where it is so near, so no distinct is needed. Where bands are so
    narrow that more than one in MET of all pairs would meet, blocks of prints are compared instead."""

    def cut(m: int) -> tuple[list[int], list[list[int]]]:
        at = [round(i * width / m) for i in range(m + 1)]
        return at, [_masks(at[i + 1] - at[i], distance // m) for i in range(m)]

    sized = lambda m: sum(math.comb(-(-width // m), n) for n in range(distance // m + 1)) * m
    bands = next(m for m in range(1, distance + 2) if m == distance + 1 or sized(m) <= most_probes)
    at, masks = cut(bands)
    near = distance // bands

    def band(c: Column, i: int) -> Column:
        left = 64 - at[i + 1]
        return F.shiftrightunsigned(F.shiftleft(c, left) if left else c, left + at[i])

    rich = prints.where(F.col("sd") >= least_sd).select(F.col(node).alias("id"), "bits", "mean")
    if sum(len(m) / 2 ** (at[i + 1] - at[i]) for i, m in enumerate(masks)) > 1 / MET:
        return _pairs_of_blocks(rich, distance, mean_gap)
    held = rich.select("*", F.posexplode(F.array(*(band(F.col("bits"), i) for i in range(bands)))).alias("band", "part"))

    def around(i: int) -> Column:
        own = band(F.col("bits"), i)
        return F.transform(F.array(*(F.lit(v).cast("long") for v in masks[i])), lambda v: v.bitwiseXOR(own))

    asked = F.array(*(around(i) for i in range(bands)))
    asking = rich.select("*", F.posexplode(asked).alias("band", "parts")).select("id", "bits", "mean", "band", F.explode("parts").alias("part"))
    x, y = asking.alias("x"), held.alias("y")
    differ = F.col("x.bits").bitwiseXOR(F.col("y.bits"))
    first = F.coalesce(*(F.when(F.bit_count(band(differ, i)) <= near, F.lit(i)) for i in range(bands)))
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") < F.col("y.id")))
    close = met.where((F.bit_count(differ) <= distance) & (F.abs(F.col("x.mean") - F.col("y.mean")) <= mean_gap) & (first == F.col("x.band")))
    return close.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.bit_count(differ).cast("long").alias("distance"))


def _pairs_of_blocks(rich: DataFrame, distance: int, mean_gap: float) -> DataFrame:
    """The pairs of rich(id, bits, mean) by comparing all: prints are dealt to blocks of about BLOCK, each pair of
    blocks meets in one task, and a task holds two blocks, whatever their number."""
    rich = stash(rich.dropna(), "prints")
    n = rich.count()
    blocks = max(1, -(-n // BLOCK))
    tasks = min(blocks * (blocks + 1) // 2, max(TASKS, -(-n * blocks // ROWS_EACH)))
    own = F.pmod(F.xxhash64("id", "bits", "mean"), F.lit(blocks)).cast("int")
    sent = rich.withColumn("own", own).select("id", "bits", "mean", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    met = sent.select("id", "bits", "mean", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    kind = rich.schema["id"].dataType

    def compare(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        names, arrow = ["a", "b", "distance"], to_arrow_type(kind)

        def met_in(rows, x: int, y: int):
            of = lambda k: rows.filter(pc.equal(rows["own"], k)).combine_chunks()
            left, right = of(x), of(y)
            lb, rb = (t["bits"].to_numpy().view(np.uint64) for t in (left, right))
            lm, rm = (t["mean"].to_numpy() for t in (left, right))
            for at in range(0, len(lb), ROWS_AT_ONCE):
                far = np.bitwise_count(lb[at : at + ROWS_AT_ONCE, None] ^ rb[None, :])
                i, j = np.divmod(np.flatnonzero(far <= distance), len(rb)) if len(rb) else np.nonzero(far)
                with np.errstate(invalid="ignore"):
                    kept = np.abs(lm[i + at] - rm[j]) <= mean_gap
                kept &= (x != y) | (i + at < j)
                i, j = i[kept], j[kept]
                for k in range(0, len(i), PAIRS_AT_ONCE):
                    ii, jj = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
                    p, q = (t["id"].take(pa.array(where)).combine_chunks() for t, where in ((left, ii + at), (right, jj)))
                    earlier, apart = pc.less(p, q), pc.not_equal(p, q)
                    pairs = [pc.if_else(earlier, p, q), pc.if_else(earlier, q, p), pa.array(far[ii, jj].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([c.cast(t).filter(apart) for c, t in zip(pairs, (arrow, arrow, pa.int64()), strict=True)], names=names)

        held, now = [], None
        for batch in batches:
            xs, ys = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            cuts = np.flatnonzero((np.diff(xs) != 0) | (np.diff(ys) != 0)) + 1
            for begin, end in itertools.pairwise([0, *cuts.tolist(), len(xs)]):
                if begin < end and (key := (int(xs[begin]), int(ys[begin]))) != now:
                    if held:
                        yield from met_in(pa.Table.from_batches(held), *now)
                    held, now = [], key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from met_in(pa.Table.from_batches(held), *now)

    out = StructType([StructField("a", kind), StructField("b", kind), StructField("distance", LongType())])
    return met.repartition(tasks, "x", "y").sortWithinPartitions("x", "y").mapInArrow(compare, out)


def near_groups(pairs: DataFrame) -> DataFrame:
    """Groups around seeds, in order of id."""
    return graph.seed_groups(pairs)


def without_exact(groups: DataFrame, exact: DataFrame, node: str = "node", seed: str = "seed") -> DataFrame:
    """Groups of alike files without the files of exact groups; what has under two left is no group."""
    left = groups.join(exact.select(node).distinct(), node, "left_anti")
    sizes = left.groupBy(seed).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(seed)
    return left.join(sizes, seed, "left_semi")
