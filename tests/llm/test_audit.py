"""Audits of a shard's graph see links, not each vector's match with itself."""

import numpy as np

from keepsake.llm import hnsw


class Blind(hnsw.Graph):
    """Finds nothing but a vector itself until its beam is 400 wide."""

    def within(self, q, threshold):
        sims = q @ self.v.T
        yield np.nonzero(sims >= (threshold if self.exact or self.width >= 400 else 1 - 1e-9))


def vectors(n, links, seed=7):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 24))
    v[:links] = v[links : 2 * links] + rng.normal(size=(links, 24)) * 0.05
    return hnsw.unit(v)


def test_an_audit_without_found_links_widens():
    graph = Blind(vectors(4000, 20), [], 0)
    assert graph.audit(0.9, 0.98, 256) >= 0.98 and graph.width >= 400


def test_queries_of_other_shards_audit():
    both = vectors(4000, 300)
    graph = Blind(both[300:], [], 0)
    assert graph.audit(0.9, 0.98, 256, both[:300], np.full(300, -1)) >= 0.98 and graph.width >= 400


def test_a_shard_without_links_is_audited_too():
    graph = Blind(vectors(4000, 0), [], 0)
    assert graph.audit(0.9, 0.98, 256) >= 0.98 and graph.width >= 400


def test_a_good_graph_keeps_its_beam():
    v = vectors(2000, 200)
    graph = hnsw.Graph.build(v, 1)
    assert graph.audit(0.9, 0.9, 256, v, np.arange(2000)) >= 0.9 and not graph.exact


def test_planted_pairs_just_above_the_threshold_are_found(spark):
    """Pairs at cosines of 0.9 to 0.93 among many others, mostly across shards; and none below is linked."""
    rng = np.random.default_rng(8)
    v = hnsw.unit(rng.normal(size=(5000, 64)))
    for k in range(600):
        off = rng.normal(size=64)
        off -= (off @ v[k]) * v[k]
        off /= np.linalg.norm(off)
        c = rng.uniform(0.88, 0.93)
        v[1000 + k] = c * v[k] + np.sqrt(1 - c * c) * off
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(df, shards=4).collect()}
    near = v @ v.T >= 0.9
    want = near.sum(axis=1) - 1
    assert sum(got.values()) >= 0.95 * want.sum() and want.sum() > 500 and all(got[i] <= want[i] for i in got)


def test_every_length_has_its_links(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=9).tolist()) for i in range(40)] + [(2000, [3.0]), (2001, [5.0]), (2002, [-1.0])]
    rows += [(3000, rows[5][1]), (3001, rows[310][1]), (3002, [x * 2 for x in rows[320][1]])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=3).collect()}
    assert got[3000] == (1, 5) and got[3001] == (1, 1010) and got[3002] == (1, 1020) and got[2000] == got[2001] == (1, 2000) and got[2002] == (0, 2002)


def test_forests_have_the_components_of_their_links(monkeypatch):
    monkeypatch.setattr(hnsw, "LINKS", 40)
    rng = np.random.default_rng(4)
    ids = rng.permutation(10**6)[:400]
    own, other = ids[:150], ids[100:]
    forest, root = hnsw.Forest(), {int(i): int(i) for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for _ in range(30):
        a, b = rng.integers(150, size=7), rng.integers(300, size=7)
        forest.add(a, b, own, other)
        for x, y in zip(own[a].tolist(), other[b].tolist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    node, low = forest.links()
    held = {i: i for i in root} | dict(zip(node.tolist(), low.tolist()))
    up = lambda i: i if held[i] == i else up(held[i])
    assert len(node) == len(set(node.tolist())) and all((up(i) == up(j)) == (find(i) == find(j)) for i in root for j in list(root)[:20])


def test_a_large_family_is_counted_in_bounded_memory():
    """4,000 queries against 20,000 of their family: 80 million pairs, which would take over a gigabyte."""
    import tracemalloc

    rng = np.random.default_rng(6)
    v = hnsw.unit(np.ones(32) + rng.normal(size=(20_000, 32)) * 0.05)
    graph = hnsw.Graph(v, [], 0, exact=True)
    ids, count, links = np.arange(20_000), np.zeros(4000, np.int64), hnsw.Forest()
    tracemalloc.start()
    for a, b in graph.within(v[:4000], 0.9):
        np.add.at(count, a, 1)
        links.add(a, b, ids[:4000], ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (count == 20_000).all() and len(links.links()[0]) == 19_999 and peak < 400 << 20
