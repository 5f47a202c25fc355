"""Embedding near-duplicates: navigable small-world graphs per shard, queried by every vector.

Identical vectors are one class. Classes are dealt over shards, by length and hash; each shard's
graph is a file in the shared folder. Every class queries every shard of its length: a task takes a
large block of classes and loads each graph once, so vectors aren't sent about. Beams begin
narrow and work in single precision. A beam whose results are all at or above
the threshold is widened until it isn't, up to the whole shard. When a graph is built, an audit
compares what queries from all shards find with all that is there, their own nodes left out, and
widens the shard's beam until the recall is reached. Found pairs are checked by their cosine in
double precision, and become counts and a spanning forest a few queries at a time, so a task never
holds the pairs of a large group, and returns rows in proportion to its members.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEGREE, BUILD_BEAM, BEAM, AT_ONCE, POOL = 16, 48, 8, 4, 32
#: How far single precision may be off a cosine: beams take in that much more, double precision decides.
LOOSE = 1e-4
#: Cosines that are worked out at once, beams' entries that are held at once; links of a forest before it is cut to one a node.
COSINES, ENTRIES, LINKS = 1 << 22, 1 << 15, 1 << 20


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def beam_search(v: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` best nodes found for each query, and their cosines, best first. All queries go in
    step: each expands its AT_ONCE best open nodes, and the widths are cut after each step."""
    rows = np.arange(len(q))
    ids = np.full((len(q), width + 1), -1, np.int64)
    sims = np.full((len(q), width + 1), -np.inf, v.dtype)
    done = np.ones((len(q), width + 1), bool)
    seen = np.zeros((len(q), len(v)), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, (v[start] * q).sum(axis=1), False
    seen[rows, start] = True
    live = rows
    while len(live):
        k = min(AT_ONCE, ids.shape[1])
        score = np.where(done[live], -np.inf, sims[live])
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        open_ = np.take_along_axis(score, best, 1) > -np.inf
        some = open_.any(axis=1)
        live, best, open_ = live[some], best[some], open_[some]
        if not len(live):
            break
        done[live[:, None], best] = True
        nodes = np.where(open_, ids[live[:, None], best], -1)
        ring = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(live), -1)
        ring = np.sort(ring, axis=1)
        ring[:, 1:][ring[:, 1:] == ring[:, :-1]] = -1
        fresh = (ring >= 0) & ~seen[live[:, None], ring]
        seen[live[:, None], np.where(fresh, ring, start[live][:, None])] = True
        s = np.where(fresh, np.matmul(v[ring], q[live][:, :, None])[:, :, 0], -np.inf)
        all_ids, all_sims = np.concatenate([ids[live], ring], 1), np.concatenate([sims[live], s], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        top = np.argpartition(-all_sims, width, axis=1)[:, : width + 1]
        ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)
        ids[live] = np.where(np.isneginf(sims[live]), -1, ids[live])
    order = np.argsort(-sims, axis=1)[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(v: np.ndarray, at: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` neighbours for each node of at from candidates, best first: one is taken if it is
    nearer to the node than to all taken before; places left over go to the nearest others."""
    taken = np.full((len(at), degree), -1, np.int64)
    count = np.zeros(len(at), np.int64)
    skipped = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        c, s = ids[:, j], sims[:, j]
        ok = (c >= 0) & (c != at) & (count < degree)
        near = np.where(taken >= 0, np.matmul(v[taken], v[c][:, :, None])[:, :, 0], -np.inf).max(axis=1)
        add = ok & (near < s)
        taken[add, count[add]] = c[add]
        count += add
        skipped[:, j] = ok & ~add
    for j in range(ids.shape[1]):
        add = skipped[:, j] & (count < degree)
        if add.any():
            taken[add, count[add]] = ids[add, j]
            count += add
    return taken


def turned(v: np.ndarray, threshold: float, n: int) -> np.ndarray:
    """n unit rows, each one of v turned in a random direction to a cosine just above the threshold."""
    draw = np.random.default_rng(n)
    at = v[draw.integers(len(v), size=n)]
    off = draw.normal(size=at.shape)
    off -= (off * at).sum(axis=1, keepdims=True) * at
    off /= np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-300)
    c = min(1.0, threshold + 1e-6)
    return unit(c * at + np.sqrt(max(0.0, 1 - c * c)) * off)


class Graph:
    """Layers over vectors v (unit rows): layers[l] = neighbours by node, -1 where none."""

    def __init__(self, v: np.ndarray, layers: list[np.ndarray], top: int, width: int = BEAM, exact: bool = False):
        self.v, self.layers, self.top, self.width, self.exact = v, layers, top, width, exact
        self.low = v.astype(np.float32)

    @classmethod
    def build(cls, v: np.ndarray, seed: int) -> Graph:
        n = len(v)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(int)
        top = int(level.argmax())
        graph = cls(v, [], top)
        for l in range(level[top], -1, -1):  # from the top, each layer finds its way by those above
            degree = DEGREE * (2 if l == 0 else 1)
            near = np.full((n, degree), -1, np.int64)
            members = np.flatnonzero(level >= l)
            members = members[np.argsort(-level[members], kind="stable")]
            entry = graph.descend(graph.low[members])
            size = 1
            while size < len(members):
                step = min(max(1, size // 2), 256)
                graph._insert(near, members[size : size + step], entry[size : size + step], degree)
                size += step
            graph.layers.insert(0, near)
        return graph

    def descend(self, q: np.ndarray) -> np.ndarray:
        at = np.full(len(q), self.top, np.int64)
        for near in reversed(self.layers):
            for i in range(0, len(q), 512):
                at[i : i + 512] = beam_search(self.low, near, q[i : i + 512], at[i : i + 512], 4)[0][:, 0]
        return at

    def _insert(self, near: np.ndarray, new: np.ndarray, entry: np.ndarray, degree: int) -> None:
        v = self.low
        start = np.where(np.isin(entry, new), self.top, entry)
        ids, sims = beam_search(v, near, v[new], start, BUILD_BEAM)
        each = v[new] @ v[new].T
        np.fill_diagonal(each, -np.inf)
        ids = np.concatenate([ids, np.broadcast_to(new, each.shape)], 1)
        sims = np.concatenate([sims, each], 1)
        best = np.argsort(-sims, axis=1)[:, :BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        ids = np.where(np.isneginf(sims), -1, ids)
        near[new] = choose(v, new, ids, sims, degree)
        # the way back: a node that has no place left chooses anew
        a, b = near[new].ravel(), np.repeat(new, degree)
        a, b = a[a >= 0], b[near[new].ravel() >= 0]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        nodes, first, count = np.unique(a, return_index=True, return_counts=True)
        wide = min(int(count.max()), 2 * degree)
        extra = np.full((len(nodes), wide), -1, np.int64)
        rank = np.arange(len(a)) - np.repeat(first, count)
        fits = rank < wide
        extra[np.repeat(np.arange(len(nodes)), count)[fits], rank[fits]] = b[fits]
        both = np.sort(np.concatenate([near[nodes], extra], 1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        s = np.where(both >= 0, np.matmul(v[both], v[nodes][:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-s, axis=1)
        near[nodes] = choose(v, nodes, np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1), degree)

    def within(self, q: np.ndarray, threshold: float):
        """(query, node) arrays, a few queries at a time, of the pairs with a cosine of threshold or more that
        the beams find."""
        rest, width = np.arange(len(q)), self.width
        low = q.astype(np.float32)
        entry = None if self.exact else self.descend(low)
        while len(rest):
            if self.exact or width * 4 >= len(self.v):
                step = max(1, COSINES // len(self.v))
                for i in range(0, len(rest), step):
                    a, b = np.nonzero(q[rest[i : i + step]] @ self.v.T >= threshold)
                    yield rest[i : i + step][a], b
                return
            full, step = [], max(8, min(256, ENTRIES // width))
            for i in range(0, len(rest), step):
                part = rest[i : i + step]
                ids, sims = beam_search(self.low, self.layers[0], low[part], entry[part], width)
                hit = sims >= threshold - LOOSE
                whole = hit.all(axis=1)
                full.append(part[whole])
                a, b = np.nonzero(hit & ~whole[:, None])
                a, b = part[a], ids[a, b]
                sure = (q[a] * self.v[b]).sum(axis=1) >= threshold
                yield a[sure], b[sure]
            rest, width = np.concatenate(full), width * 4

    def audit(self, threshold: float, recall: float, sample: int, pool: np.ndarray | None = None, same: np.ndarray | None = None) -> float:
        """Widen the beam until the queries' links are found to the recall; the last step is to compare
        with the whole shard. Queries are taken from pool (unit rows; same: each one's own node or
        -1, which is no link) until `sample` links are there. Where the pool has fewer, nodes turned
        to just above the threshold ask too, and both kinds must reach the recall."""
        if pool is None or same is None:
            pool, same = self.v, np.arange(len(self.v))
        asked, links = [np.zeros(0, np.int64)], 0
        for i in range(0, len(pool), 512):
            near = pool[i : i + 512] @ self.v.T >= threshold
            own = np.flatnonzero(same[i : i + 512] >= 0)
            near[own, same[i : i + 512][own]] = False
            asked.append(i + np.flatnonzero(near.any(axis=1)))
            links += int(near.sum())
            if links >= sample:
                break
        at = np.concatenate(asked)
        kinds = [(pool[at], same[at], links)]
        if links < sample:
            q = turned(self.v, threshold, sample - links)
            kinds.append((q, np.full(len(q), -1), sum(int((q[i : i + 512] @ self.v.T >= threshold).sum()) for i in range(0, len(q), 512))))
        kinds = [k for k in kinds if k[2]]
        while True:
            shares = [1.0]
            for q, own, there in kinds:
                shares.append(sum(int((b != own[a]).sum()) for a, b in self.within(q, threshold)) / there)
            if min(shares) >= recall or self.exact:
                return min(shares)
            self.width, self.exact = self.width * 2, self.width * 8 >= len(self.v)

    def save(self, sink, ids: np.ndarray, weight: np.ndarray) -> None:
        np.savez(sink, v=self.v, ids=ids, weight=weight, meta=np.array([self.top, self.width, int(self.exact)]), **{f"l{i}": x.astype(np.int32) for i, x in enumerate(self.layers)})

    @classmethod
    def load(cls, source) -> tuple[Graph, np.ndarray, np.ndarray]:
        z = np.load(source)
        layers = [z[f"l{i}"].astype(np.int64) for i in range(sum(k[0] == "l" for k in z.files))]
        top, width, exact = z["meta"].tolist()
        return cls(z["v"], layers, top, width, bool(exact)), z["ids"], z["weight"]


@lru_cache(maxsize=1)
def _loaded(folder: str, file: str) -> tuple[Graph, np.ndarray, np.ndarray]:
    import io

    fs, path = common.local_fs(folder)
    with fs.open_input_file(f"{path}/{file}") as f:
        return Graph.load(io.BytesIO(f.read()))


class Forest:
    """Spanning forest of links between ids as they come: LINKS of them at most, and one a node, are held."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Links between left[a] and right[b]; a and b are places. Places are labelled, ids aren't sorted."""
        if not len(a):
            return
        rows, x = np.unique(a, return_inverse=True)  # few
        label = np.arange(len(rows) + len(right))
        y = b + len(rows)
        while True:
            low = label.copy()
            np.minimum.at(low, x, label[y])
            np.minimum.at(low, y, label[x])
            low = low[low]
            if (low == label).all():
                break
            label = low
        moved = np.flatnonzero(label != np.arange(len(label)))
        ids = lambda at: np.where(at < len(rows), left[rows[np.minimum(at, len(rows) - 1)]], right[np.maximum(at - len(rows), 0)])
        self.held.append((ids(moved), ids(label[moved])))
        self.size += len(moved)
        if self.size > LINKS:
            self.held, self.size = [self.links()], 0  # at most one a node

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 2
        return common.forest(*(np.concatenate(x) for x in zip(*self.held, strict=True)))


def usable(col: str) -> Column:
    """Neither null nor zero, and all components finite."""
    ok = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(col).isNotNull() & ok & F.exists(col, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, shards: int = 8, shard_rows: int = 50_000, block_rows: int = 100_000, sample: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Per row: vec_id, n_links long, component_id (smallest vec_id in reach), kept boolean, audit_recall
    double (the least share of links that an audit of a shard found).

    vec_id is an integer. Links: cosine of threshold or more, both in double precision, between
    vectors of one length. Vectors that are null, zero or hold null or non-finite components link
    with nothing; so do rows without an id, whose component is null. Repeated rows count as vectors
    of their own. A class is known by a 64-bit hash of its vector. An empty table gives none. At
    least `shards` shards a length, more where one would hold over shard_rows classes; `sample` links
    a shard audit it, those of the POOL * sample classes with the smallest hash as far as they go.
    Other columns are not read."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    keyed = rows.withColumn("class", F.when(usable("vec") & F.col("vec_id").isNotNull(), F.xxhash64("vec")))
    classes = keyed.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = common.stash(classes.withColumn("size", F.size("vec")), "vectors")
    total = classes.count()
    n = max(shards, -(-total // shard_rows))
    folder, pool = common.scratch_path(spark, "graphs"), common.scratch_path(spark, "pool")
    classes.select("class", "vec", "size").orderBy(F.xxhash64("class", F.lit(2))).limit(POOL * sample).coalesce(1).write.parquet(pool)

    def matrix(t) -> np.ndarray:
        column = t.column("vec").combine_chunks()
        return unit(column.flatten().to_numpy().reshape(len(column), -1))

    def asked(size: int) -> tuple[np.ndarray, np.ndarray]:
        from pyarrow import dataset

        fs, path = common.local_fs(pool)
        t = dataset.dataset(path, filesystem=fs, format="parquet").to_table(columns=["class", "vec"], filter=dataset.field("size") == size)
        return matrix(t) if t.num_rows else np.zeros((0, size)), t.column("class").to_numpy()

    def build(key, t):
        import io

        import pyarrow as pa
        from pyspark import TaskContext

        size, shard = key[0].as_py(), key[1].as_py()
        t = t.sort_by("class")
        graph = Graph.build(matrix(t), shard)
        ids, (asks, own) = t.column("class").to_numpy(), asked(size)
        spot = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        found = graph.audit(threshold, recall, sample, asks, np.where(ids[spot] == own, spot, -1))
        fs, path = common.local_fs(folder)
        fs.create_dir(path, recursive=True)
        name, held = f"graph-{size}-{shard:05d}-{TaskContext.get().taskAttemptId()}.npz", io.BytesIO()
        graph.save(held, t.column("class").to_numpy(), t.column("n").to_numpy())
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(held.getbuffer())
        return pa.table({"size": pa.array([size], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [name], "recall": [found], "beam": pa.array([graph.width], pa.int32()), "exact": [graph.exact]})

    placed = classes.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(n)).cast("int"))
    manifest = common.scratch_path(spark, "manifest")
    built = placed.repartitionByRange(n, "size", "shard").groupBy("size", "shard").applyInArrow(build, "size int, shard int, file string, recall double, beam int, exact boolean")
    built.write.parquet(manifest)

    def query(batches):
        """Blocks of classes against the shards of their length; the manifest names the files."""
        import pyarrow as pa
        from pyarrow import dataset

        fs, path = common.local_fs(manifest)
        held, waiting = [], 0
        for b in batches:
            held.append(b)
            waiting += b.num_rows
            if waiting >= block_rows:
                yield from answers(pa.Table.from_batches(held), fs, path, pa, dataset)
                held, waiting = [], 0
        if waiting:
            yield from answers(pa.Table.from_batches(held), fs, path, pa, dataset)

    def answers(t, fs, path, pa, dataset):
        import pyarrow.compute as pc

        for size in pc.unique(t.column("size")).to_pylist():
            part = t.filter(pc.equal(t.column("size"), size))
            files = dataset.dataset(path, filesystem=fs, format="parquet").to_table(columns=["shard", "file"], filter=dataset.field("size") == size).sort_by("shard")
            own, q = part.column("class").to_numpy(), matrix(part)
            count, links = np.zeros(len(own), np.int64), Forest()
            for file in files.column("file").to_pylist():
                graph, ids, weight = _loaded(folder, file)
                for a, b in graph.within(q, threshold):
                    other = own[a] != ids[b]
                    a, b = a[other], b[other]
                    np.add.at(count, a, weight[b])
                    links.add(a, b, own, ids)
            node, root = links.links()
            some = count > 0
            columns = [np.concatenate(x) for x in ((own[some], node), (count[some], np.zeros(len(node), np.int64)), (np.zeros(some.sum(), np.int64), root), (np.zeros(some.sum(), bool), np.ones(len(node), bool)))]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "links", "b", "edge"])

    # The stated query set: every class asks every shard. Blocks are dealt evenly; vectors move once for that.
    reached = spark.read.schema("recall double").parquet(manifest).agg(F.min("recall")).first()[0]
    blocks = max(2 * n, -(-total // block_rows))
    asks = classes.select("class", "vec", "size").repartition(blocks)
    answered = common.stash(asks.mapInArrow(query, "a long, links long, b long, edge boolean"), "answers")
    counts = answered.where("NOT edge").select(F.col("a").alias("class"), "links")
    root = common.components(answered.where("edge").select("a", "b"))
    named = classes.select("class", "vec_id", "n").join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = named.join(counts, "class", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    low = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = keyed.select("vec_id", "class").join(named.join(low, "root").select("class", "n_links", "component_id"), "class", "left")
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumns({"kept": F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)), "audit_recall": F.lit(reached).cast("double")})


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
