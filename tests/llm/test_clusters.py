"""Centroid clustering against plain Python and SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from compare import of_duck, of_spark

from keepsake.llm import clusters
from keepsake.llm.queries import ORACLES, QUERIES


def plain(vectors, k=clusters.CENTROIDS, rounds=clusters.ROUNDS):
    ints = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 1 << 19 for x in v)]
    hashed = sorted(((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in ints))
    at = [v for _, _, v in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at)) for _, v in ints]

    for _ in range(rounds):
        own = [n for _, n in assign()]
        for n in range(len(at)):
            mine = [v for (_, v), m in zip(ints, own) if m == n]
            if mine:
                at[n] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    per = {}
    for d, n in got:
        per[n] = per.get(n, 0) + d
    return sorted(
        ((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(ints, got)), key=repr
    )


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, cluster string")


def test_query_gives_rows_of_sql(spark, duck, data):
    assert of_spark(QUERIES["op11_centroid_clusters"](spark, data)) == of_duck(duck, ORACLES["op11_centroid_clusters"])


def test_odd_rows_as_plain(spark):
    rng = random.Random(5)
    f32 = lambda: float(np.float32(rng.gauss(0, 0.2)))
    good = [[f32() for _ in range(64)] for _ in range(70)]
    vectors = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (3, good[4]), (None, good[5]), (None, good[6])]
    vectors += [(200, None), (201, []), (202, good[0][:63]), (203, [None] + good[0][1:]), (204, [math.nan] + good[0][1:]), (205, [math.inf] + good[0][1:]), (206, [1e30] + good[0][1:]), (207, [0.0] * 64), (208, [-1000.0] * 64)]
    got = sorted((tuple(r) for r in clusters.cluster_vectors(frame(spark, vectors).repartition(5)).collect()), key=repr)
    assert got == plain(vectors)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, n):
    vectors = [(i, [float(i % 3)] * 64) for i in range(n)]
    got = sorted((tuple(r) for r in clusters.cluster_vectors(frame(spark, vectors)).collect()), key=repr)
    assert got == plain(vectors)


def test_ties_go_to_the_smaller_number():
    x = np.array([[0] * 64, [2] * 64, [1] * 64])
    at = np.array([[5] * 64, [1] * 64, [1] * 64, [-1] * 64, [3] * 64])
    for order in (list(range(64)), list(range(63, -1, -1))):
        number, distance = clusters.nearest(x, at, order)
        assert number.tolist() == [1, 1, 1] and distance.tolist() == [64, 64, 0]


def test_partial_sums_find_the_nearest():
    rng = np.random.default_rng(3)
    x, at = rng.integers(-60, 60, (3000, 64)), rng.integers(-60, 60, (40, 64))
    x[:, 7] *= 20
    full = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
    for order in (np.argsort(-x.var(axis=0)), np.arange(64)):
        number, distance = clusters.nearest(x, at, order)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
