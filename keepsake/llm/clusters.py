"""Centroid clustering of integer vectors by partial-distance search.

Assignments are exact: squared differences are summed over the dimensions of high variance first, and
a centroid is given up for a vector once its partial sum lies strictly above the vector's current
best. A round is one pass over the vectors; a task hands on at most a row a cluster, and only the
centroids (their number is a parameter) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The contract's dimensions, scale, centroids, rounds and the seed of their order.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2"
#: Components beyond this can't be squared and summed in a long.
MOST = 1 << 19
#: Dimensions that are summed between two tests.
STEP = 8


def integers(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", dims: int = DIMENSIONS) -> DataFrame:
    """(id, v array<int>) of the vectors with exactly `dims` components, none null, not finite or of
    2 ** 19 and more (those couldn't be squared): v is floor(256 * x)."""
    good = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    kept = vectors.where((F.size(col) == dims) & F.coalesce(good, F.lit(False)))
    return kept.select(id_col, F.transform(col, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))


def nearest(x, centroids, order, step: int = STEP):
    """(number of the nearest centroid, squared distance) of each row of x, ties to the smaller number.

    x, centroids: integer arrays; order: dimensions, in the order in which they are summed. The
    centroid that is nearest by the first `step` dimensions gives a vector's first best."""
    import numpy as np

    x, centroids = x[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    part = np.stack([((x[:, :step] - c[:step]) ** 2).sum(axis=1) for c in centroids], axis=1)
    rest = x - centroids[part.argmin(axis=1)]
    best = (rest * rest).sum(axis=1)
    row, number = np.nonzero(part <= best[:, None])
    sums = part[row, number]
    for at in range(step, x.shape[1], step):
        d = x[row, at : at + step] - centroids[number, at : at + step]
        sums = sums + (d * d).sum(axis=1)
        alive = sums <= best[row]
        row, number, sums = row[alive], number[alive], sums[alive]
    np.minimum.at(best, row, sums)
    least = sums == best[row]
    _, first = np.unique(row[least], return_index=True)  # rows come in order, numbers ascending in each
    return number[least][first], best


def _blocks(batches, dims: int, size: int = 4096):
    """(ids, integer matrix) of Arrow batches (id, v)."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(-1, dims)


def spread(ints: DataFrame, dims: int) -> list[int]:
    """Dimensions by falling variance; the order changes how soon centroids are given up, not results."""

    def tell(batches):
        import numpy as np
        import pyarrow as pa

        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        for _, x in _blocks(batches, dims):
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x.astype(np.float64) ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "squares": [squares.tolist()]})

    told = ints.mapInArrow(tell, "n long, total array<double>, squares array<double>")
    row = told.agg(F.sum("n").alias("n"), *(F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("total", "squares") for i in range(dims))).first()
    if not row["n"]:
        return list(range(dims))
    variance = [row[f"squares{i}"] / row["n"] - (row[f"total{i}"] / row["n"]) ** 2 for i in range(dims)]
    return sorted(range(dims), key=lambda i: (-variance[i], i))


def starts(ints: DataFrame, id_col: str, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id, of equal ones those with smaller components.
    An id that is null has no hash and comes last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return [list(r["v"]) for r in ints.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()]


def moved(ints: DataFrame, centroids: list[list[int]], order: list[int]) -> list[list[int]]:
    """Centroids after a round: floor(sum / count) of their vectors, empty ones as they were."""
    dims = len(order)

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        at, n, total = np.array(centroids), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, x in _blocks(batches, dims):
            number, _ = nearest(x, at, order)
            n += np.bincount(number, minlength=len(n))
            np.add.at(total, number, x)
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    per = ints.mapInArrow(sums, "cluster int, n long, total array<long>")
    told = per.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(dims)))
    new = list(centroids)
    for r in told.collect():  # a row a centroid
        new[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(dims)]
    return new


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """Per vector kept by integers(): id, cluster int, distance, cluster_inertia and inertia long (sums of
    squared distances), centroid_sha256 (of its centroid's components, comma-joined).

    Null vectors and those of another length or with null, NaN, infinite or huge components are left
    out; repeated rows and null ids each give a row (a null id starts no centroid unless too few
    others are there); with fewer than k vectors there are as many centroids; other columns are
    not read, whatever their names; an empty table gives none."""
    import hashlib

    kind = dict(vectors.dtypes)[id_col]
    ints = integers(vectors, id_col, col, dims)
    schema = f"`{id_col}` {kind}, cluster int, distance long"
    centroids = starts(ints, id_col, k, seed)
    order = spread(ints, dims) if centroids else []
    for _ in range(rounds if centroids else 0):
        centroids = moved(ints, centroids, order)

    def assigned(batches):
        import numpy as np
        import pyarrow as pa

        at = np.array(centroids)
        for ids, x in _blocks(batches, dims):
            number, distance = nearest(x, at, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=[id_col, "cluster", "distance"])

    if not centroids:
        found, per = ints.select(id_col, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), {}
    else:
        found = common.stash(ints.mapInArrow(assigned, schema), "clusters")
        per = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    return found.select(
        id_col, "cluster", "distance",
        of([per.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(per.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds, written out one after the other."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {MOST})) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v AS w FROM kept QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept, c{n}) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.w, o.w) AS w FROM c{n} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS w FROM (SELECT m.c AS c, i,
  CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM kept JOIN a{n} USING (r), range(1, {DIMENSIONS + 1}) t(i) GROUP BY 1, 2) GROUP BY c) n ON n.c = o.c)"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.c = m.c"""
    )


OP11_SQL = _sql()
