"""N-gram Jaccard join by T-occurrence search over divided inverted lists.

A partner of a document with n shingles holds at least T = ceil(min_jaccard * n) of them. A search
range is a part of the indexed documents with their inverted lists in the memory of a task, and
DivideSkip answers the documents that are sent to it: the L longest lists of a document are put
aside, the short ones are merged by a heap, and whoever occurs in T - L or more of them is looked
up in the long lists by binary search until the required overlap is reached or out of reach.

A document is sent to a range only if they have one of its n - T + 1 shortest lists of the whole
corpus in common, for any partner shares one of those. Any order of the lists that all documents
share keeps this exact; list lengths come from a sketch of fixed size that counts all shingles.

Identical sets are one class throughout. The first search indexes one class a list, its pivot, so
a family of near copies is sent as often as it has members; the second indexes the other classes,
and a document is only sent to ranges that have a class of another component in one of its lists:
in lists of up to LIST classes one whose size and parities fit, in longer ones any of fitting size.
What is sent grows with lists times ranges, never with the pairs of a long list.
"""

from __future__ import annotations

import heapq
import math
import zlib
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the shingle hash (odd 64-bit constants).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)
SKETCH_BITS, CHUNK_BITS, PARITY = 22, 16, 512
#: Shingles of a search range, documents sent to it in one block, classes of a list that are compared one
#: by one, and how a merge step compares with a probe.
RANGE, BLOCK, LIST, MERGE_COST = 1_000_000, 1024, 64, 0.01


def shingle_set(text: str, size: int = 3):
    """Distinct size-word shingles of a whole text as sorted 64-bit hashes; A-Z lower-cased, words
    between ASCII white space; fewer words make one shingle, no word none. Bytes are lower-cased
    and split, which is what ASCII rules ask for."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = x * np.uint64(MIX[-2]) + h[k : k + n] * np.uint64(MIX[k % 4])
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX[-1])
    x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def _class_of(shingles) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _parity(shingles):
    """Bits (PARITY, or for large sets the power of two from half their size on), each the parity of
    the shingles that fall to it. A shingle that two sets don't share turns at most one bit, so sets
    differ by at least the bits in which parities of one length do."""
    import numpy as np

    bits = max(PARITY, 1 << max(0, len(shingles) // 2 - 1).bit_length())
    odd = np.bincount(shingles >> 32 & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _needed(n: int, percent: int) -> int:
    """Shingles that any partner shares with a set of n."""
    return -(-percent * n // 100)


def classes_and_sketch(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n, class; and per task the counts of its shingles by hash bucket, packed."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, mask = np.zeros(1 << SKETCH_BITS, np.uint32), (1 << SKETCH_BITS) - 1
        for b in batches:
            n, cls, parity = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else None)
                parity.append(_parity(s))
                np.add.at(counts, s & mask, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        parts = [(c, p) for c, p in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)) if p.any()]
        if parts:
            m, none = len(parts), pa.nulls
            yield pa.RecordBatch.from_arrays([none(m, key), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.list_(pa.int64())), pa.array([c for c, _ in parts], pa.int32()), pa.array([zlib.compress(p.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for _, p in parts], pa.binary())], names=names)

    names = ["doc_id", "n", "class", "parity", "chunk", "counts"]
    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", common.text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n long, class long, parity array<long>, chunk int, counts binary")


def merged(parts: DataFrame) -> bytes:
    """Counts of all tasks (packed byte by byte: the low bytes, then the next) added up, on a
    logarithmic scale: 2**SKETCH_BITS 16-bit numbers (8 MB, whatever the input), packed."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[int, object] = {}
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.uint64)
                sums[c] = sums[c] + new if c in sums else new
        for c, s in sums.items():
            scaled = np.minimum(np.round(np.log2(1.0 + s) * 1536), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": pa.array([zlib.compress(scaled.tobytes(), 1)], pa.binary())})

    chunks = 1 << (SKETCH_BITS - CHUNK_BITS)
    rows = parts.select("chunk", "counts").repartition(chunks, "chunk").mapInArrow(add, "chunk int, counts binary")
    empty = bytes(2 << CHUNK_BITS)
    by = {c: zlib.decompress(bytes(x)) for c, x in rows.collect()}
    return zlib.compress(b"".join(by.get(c, empty) for c in range(chunks)), 1)


def short_lists(docs: DataFrame, lengths: bytes, size: int, percent: int) -> DataFrame:
    """(shingle, class, n, front) of each class's n - T + 1 shortest lists. A partner of its size or more
    shares one of the front ones, as the two then have 2 n p / (1 + p) in common. A task leaves out classes it has
    just written; repeats that other tasks write are put together later. Sets too small to have a
    partner of another size or with other shingles are left out: their only partner is themselves."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        length = np.frombuffer(zlib.decompress(sent.value), np.uint16)
        seen: set[int] = set()
        for b in batches:
            lists, cls, ns, fronts = [], [], [], []
            for text in b.column(0).to_pylist():
                s = shingle_set(text, size)
                n = len(s)
                if not n or 100 * n < percent * (n + 1):
                    continue
                c = _class_of(s)
                if c in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(c)
                first = np.lexsort((s, length[s & ((1 << SKETCH_BITS) - 1)]))[: n - _needed(n, percent) + 1]
                lists.append(s[first])
                cls.append(np.full(len(first), c))
                ns.append(np.full(len(first), n))
                fronts.append(np.arange(len(first)) <= n - -(-2 * percent * n // (100 + percent)))
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (lists, cls, ns, fronts)], names=["shingle", "class", "n", "front"])

    return docs.select(common.text_of().alias("text")).mapInArrow(run, "shingle long, class long, n long, front boolean")


def shared_lists(short: DataFrame) -> DataFrame:
    """(shingle, class, n, front) of the short lists with two classes or more, in a stored table. Only numbers
    of entries are added up over all lists; what a class wrote twice is put together in those that pass."""
    spark = short.sparkSession
    paths = [common.scratch_path(spark, "shared"), common.scratch_path(spark, "entries")]
    shared = common.stash(short.groupBy("shingle").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").select("shingle"), "shared", paths[0])
    likely, _ = common.sieve(shared, "shingle")(short)
    entries = common.stash(likely.join(shared, "shingle", "left_semi").groupBy("shingle", "class").agg(F.first("n").alias("n"), F.first("front").alias("front")), "entries", paths[1])
    more = entries.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("shingle")
    lists = common.stash(entries.join(more, "shingle", "left_semi"), "lists")
    common.discard(*paths)
    return lists


def class_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(class, items) of the classes in reps (class, doc_id of a member), and of a few others. Sieves
    spare most other documents the work; a class may come more than once."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 500):
                sets = [s for s in (shingle_set(t, size) for t in texts[i : i + 500]) if len(s)]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["class", "items"])

    near, _ = common.sieve(reps, "doc_id")(docs)
    sets, _ = common.sieve(reps, "class")(near.select(common.text_of().alias("text")).mapInArrow(run, "class long, items array<long>"))
    return sets


def meet(na: str, fa: str, nb: str, fb: str, percent: int) -> Column:
    """Whether two classes of a list may have it as the first that they share: sizes allow a link, and
    the list is in front for the smaller one."""
    a, b = F.col(na), F.col(nb)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((a < b) | F.col(fb)) & ((b < a) | F.col(fa))


def allowed(na: str, pa: str, nb: str, pb: str, percent: int) -> Column:
    """Whether sizes and parities allow a link: with u shingles in both sets together, at most
    u * (100 - percent) / (100 + percent) are in one of them only."""
    differ = F.aggregate(F.zip_with(pa, pb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    few = differ * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((F.size(pa) != F.size(pb)) | few)


class Range:
    """Inverted lists of some documents: each list has the places of those that hold its shingle, in
    order; places are in order of root, so those of one component are side by side."""

    def __init__(self, classes, roots, sizes, shingles):
        """shingles: of all documents one after the other, sizes telling them apart. A class that comes
        again is left out."""
        import numpy as np

        once = np.zeros(len(classes), bool)
        once[np.unique(classes, return_index=True)[1]] = True
        if not once.all():
            shingles, classes, roots, sizes = shingles[np.repeat(once, sizes)], classes[once], roots[once], sizes[once]
        order = np.lexsort((classes, roots))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.classes, self.roots, self.sizes = classes[order], roots[order], sizes[order]
        at = np.repeat(place, sizes)
        by = np.lexsort((at, shingles))
        self.lists = at[by]
        self.keys, first = np.unique(shingles[by], return_index=True)
        self.bounds = np.append(first, len(by))

    def search(self, classes, roots, sizes, shingles, percent: int):
        """(document, class) of all links between the documents asked for and those of the range that
        are of another root."""
        import numpy as np

        where = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        there = self.keys[where] == shingles
        low, high = np.searchsorted(self.roots, roots), np.searchsorted(self.roots, roots, "right")
        ends = np.cumsum(sizes)
        a, b = [], []
        for i in range(len(classes)):
            part = slice(ends[i] - sizes[i], ends[i])
            for place in self._answer(where[part][there[part]], int(sizes[i]), int(low[i]), int(high[i]), percent):
                a.append(classes[i])
                b.append(self.classes[place])
        return np.array(a, np.int64), np.array(b, np.int64)

    def _answer(self, found, n: int, low: int, high: int, percent: int):
        import numpy as np

        needed = _needed(n, percent)
        if len(found) < needed:
            return
        lengths = self.bounds[found + 1] - self.bounds[found]
        order = np.argsort(lengths, kind="stable")
        found, longest = found[order], int(lengths[order[-1]])
        long = min(needed - 1, int(needed / (MERGE_COST * np.log2(longest) + 1)))
        lists = []
        for k in found[: len(found) - long].tolist():
            x = self.lists[self.bounds[k] : self.bounds[k + 1]]
            if high > low and len(x) > 1:  # without those of the own root
                i, j = np.searchsorted(x, (low, high)).tolist()
                lists += [x[:i], x[j:]]
            elif not (len(x) == 1 and low <= x[0] < high):
                lists.append(x)
        lists = [x for x in lists if len(x)]
        if sum(map(len, lists)) > 512:  # runs this long are merged by a sort that takes them for what they are
            places, times = np.unique(np.sort(np.concatenate(lists), kind="stable"), return_counts=True)
            often = times >= needed - long
            merged_ = zip(places[often].tolist(), times[often].tolist(), strict=True)
        else:
            merged_ = ((p, sum(1 for _ in g)) for p, g in groupby(heapq.merge(*(x.tolist() for x in lists))))
        for place, got in merged_:
            if got < needed - long:
                continue
            overlap = -(-percent * (n + int(self.sizes[place])) // (100 + percent))  # then 100 * overlap >= percent * union
            for left, k in enumerate(found[len(found) - long :].tolist()):
                if got >= overlap or got + long - left < overlap:
                    break
                x = self.lists[self.bounds[k] : self.bounds[k + 1]]
                at = int(np.searchsorted(x, place))
                got += int(at < len(x) and x[at] == place)
            if got >= overlap:
                yield place


@lru_cache(maxsize=1)
def _range(folder: str, number: int) -> Range | None:
    import numpy as np
    from pyarrow import dataset, fs as pafs

    fs, path = common.local_fs(f"{folder}/range={number}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    t = dataset.dataset(path, filesystem=fs, format="parquet").to_table(columns=["class", "root", "items"])
    items = t.column("items").combine_chunks()
    return Range(t.column("class").to_numpy(), t.column("root").to_numpy(), np.diff(items.offsets.to_numpy()), items.values.to_numpy()[items.offsets[0].as_py() : items.offsets[-1].as_py()])


def search(docs: DataFrame, classes: DataFrame, index: DataFrame, routes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b), as a spanning forest of what each task finds, between documents sent to ranges and
    those indexed there. index: class, root, range; routes: class, root, range; both stored tables."""
    spark = docs.sparkSession
    folder, stored = common.scratch_path(spark, "ranges"), common.scratch_path(spark, "sets")
    sent = routes.groupBy("range").agg(F.count(F.lit(1)).alias("asked"))
    block = F.pmod(F.xxhash64("class", F.lit(5)), F.ceil(F.col("asked") / BLOCK)).cast("int").alias("block")
    roles = index.select("class", "root", "range", F.lit(-1).alias("block")).unionAll(routes.join(sent, "range").select("class", "root", "range", block))
    reps = common.stash(classes.select("class", "doc_id").join(roles, "class", "left_semi"), "reps")
    sets = common.stash(class_sets(docs, reps, size).join(roles, "class"), "sets", stored)
    sets.where("block < 0").drop("block").repartition("range").write.partitionBy("range").parquet(folder)
    asks = sets.where("block >= 0").repartition(F.col("range"), F.col("block")).sortWithinPartitions("range")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            which = b.column("range").to_numpy()
            for number in np.unique(which).tolist():
                here = _range(folder, number)
                if here is None:
                    continue
                t, pairs = b.filter(pa.array(which == number)), [(np.zeros(0, np.int64),) * 2]
                for i in range(0, t.num_rows, 256):
                    part = t.slice(i, 256)
                    items = part.column("items")
                    start, end = items.offsets[0].as_py(), items.offsets[-1].as_py()
                    pairs.append(here.search(part.column("class").to_numpy(), part.column("root").to_numpy(), np.diff(items.offsets.to_numpy()), items.values.to_numpy()[start:end], percent))
                x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
                if len(x):
                    node, root = common.forest(x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    links = common.stash(asks.select("class", "root", "range", "items").mapInArrow(run, "a long, b long"), "links")
    common.discard(folder, stored)
    return links


def band(n: str, percent: int) -> Column:
    """Number of a size's band: sizes that allow a link are at most one band apart."""
    step = max(1e-9, math.log(100 / percent) * (1 + 1e-9))
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(step)).cast("long")


def ranges_of(index: DataFrame, classes: DataFrame) -> DataFrame:
    """index (class, root) dealt over as many ranges as its sets need."""
    total = index.join(classes.select("class", "n"), "class").agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // RANGE))
    return common.stash(index.select("class", "root", F.pmod(F.xxhash64("class", F.lit(3)), F.lit(n)).cast("int").alias("range")), "index")


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    docs has doc_id and text; other columns are not read. Per row: doc_id, n_shingles long (set
    size), component_id (smallest doc_id reachable by links, itself included). Null or wordless
    texts have an empty set and link with nothing, so they keep their own id. Repeated rows give a
    row each. A null id counts as larger than any other. An empty table gives no rows. A class is
    known by a 64-bit hash of its set, a shingle by one of its words."""
    docs = docs.select("doc_id", "text")
    rows = common.stash(classes_and_sketch(docs, size), "classes")
    members = rows.where("chunk IS NULL").select("doc_id", "n", "class")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    classes = common.stash(classes, "class")
    entries = common.scratch_path(docs.sparkSession, "short")
    lists = shared_lists(common.stash(short_lists(docs, merged(rows.where("chunk IS NOT NULL")), size, percent), "short", entries))
    common.discard(entries)

    most = lists.groupBy("class").agg(F.count(F.lit(1)).alias("in_lists"))
    pivots = lists.join(most, "class").groupBy("shingle").agg(F.max(F.struct("in_lists", "class", "n", "front")).alias("p"))
    pivots = common.stash(pivots.select("shingle", F.col("p.class").alias("pivot"), F.col("p.n").alias("m"), F.col("p.front").alias("pivot_front")), "pivots")
    star = lists.join(pivots, "shingle").where("class <> pivot").where(meet("n", "front", "m", "pivot_front", percent))
    star = star.select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    a = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    b = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    near = common.stash(star.join(a, "a").join(b, "b").where(allowed("na", "pa", "nb", "pb", percent)).select("a", "b"), "near")
    index = ranges_of(near.select(F.col("a").alias("class"), F.col("a").alias("root")).distinct(), classes)
    routes = near.join(index.select(F.col("class").alias("a"), "range"), "a").select(F.col("b").alias("class"), F.col("b").alias("root"), "range").distinct()
    links = search(docs, classes, index, common.stash(routes, "routes"), size, percent)
    root = common.components(links)

    # What is left: pairs of a list whose classes are in different components, neither being its pivot.
    placed = lists.join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = placed.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("shingle")
    inner = placed.join(open_, "shingle", "left_semi").join(pivots, "shingle").where("class <> pivot").select("shingle", "class", "n", "front", "root")
    counted = inner.groupBy("shingle").agg(F.count(F.lit(1)).alias("entries"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
    inner = common.stash(inner.join(counted.select("shingle", "entries"), "shingle").join(classes.select("class", "parity"), "class"), "inner")
    # lists of at most LIST classes: a class meets so few that sizes and parities are compared one by one
    few = inner.where(F.col("entries") <= LIST)
    x, y = few.alias("x"), few.alias("y")
    fits = meet("x.n", "x.front", "y.n", "y.front", percent) & allowed("x.n", "x.parity", "y.n", "y.parity", percent)
    pairs = x.join(y, F.expr("x.shingle = y.shingle AND x.class < y.class AND x.root <> y.root") & fits)
    pairs = common.stash(pairs.select(F.col("x.class").alias("a"), F.col("x.root").alias("ra"), F.col("y.class").alias("b"), F.col("y.root").alias("rb")).distinct(), "pairs")
    # longer lists: by list, size band and range, whom a class of at least their size may meet there
    many = inner.where(F.col("entries") > LIST).select("shingle", "class", "n", "front", "root")
    index = ranges_of(pairs.selectExpr("a AS class", "ra AS root").unionAll(many.where("front").select("class", "root")).distinct(), classes)
    there = many.where("front").join(index.select("class", "range"), "class").groupBy("shingle", "range", band("n", percent).alias("band"))
    there = there.agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("n").alias("least"), F.max("n").alias("most"))
    asks = many.select("*", F.explode(F.array(band("n", percent) - 1, band("n", percent))).alias("band"))
    met = asks.join(there, ["shingle", "band"]).where("r <> root OR s <> root").where(f"n >= least AND 100 * most >= {percent} * n").select("class", "root", "range")
    routes = pairs.join(index.select(F.col("class").alias("a"), "range"), "a").selectExpr("b AS class", "rb AS root", "range").unionAll(met).distinct()
    more = search(docs, classes, index, common.stash(routes, "routes"), size, percent)
    if more.limit(1).count():
        root = common.components(links.unionAll(more))

    named = classes.select("class", "doc_id").join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(smallest, "root").select("class", "component_id")
    out = members.join(ids, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies: 3-word shingles, similarity 0.9."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
