"""Near duplicates against brute force."""

import random
import re

import numpy as np

from keepsake.llm import hnsw, jaccard


def shingles(t, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, percent=90, n=3):
    ids = sorted(texts)
    sets = {i: shingles(texts[i], n) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= percent * (len(x) + len(y) - same):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, **kw).collect()}


def test_components_of_documents(docs, texts):
    assert found(docs) == brute(texts)


def test_components_of_edited_copies(spark):
    """Families with edits around the threshold, chains, shared passages, case and space changes."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    made, passage = {}, [rnd.choice(vocab) for _ in range(25)]
    for family in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 90))] + (passage if family % 3 == 0 else [])
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                own = own[: rnd.randint(1, len(own))]
            if rnd.random() < 0.3:
                base = own
            made[len(made)] = (" " if rnd.random() < 0.7 else "\n\t").join(w.upper() if rnd.random() < 0.2 else w for w in own)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    assert found(df) == brute(made)
    assert found(df, size=5, percent=80) == brute(made, 80, 5)
    assert len({c for _, c in brute(made).values()}) < len(made)


def test_at_the_threshold(spark):
    """Sets of 95 and 95 with 90 shared have exactly 90 % of 100; one shared less does not link."""
    word = lambda a, b: " ".join([f"s{i}" for i in range(a)] + [f"t{i}" for i in range(b)])
    made = {1: word(97, 0), 2: word(92, 5), 3: " ".join(f"s{i}" for i in range(91)) + " " + " ".join(f"u{i}" for i in range(6))}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert found(df) == brute(made) and brute(made)[2][1] == 1 and brute(made)[3][1] != 1


def test_odd_tables(odd, none):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count() and jaccard.jaccard_components(none).count() == 0
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by[2][1] == by[1][1] == 1 and by[3] == (0, 3) and by[5] == (0, 5) and by[7] == (1, 6) and by[8] == (1, 8) and by[9] == (1, 9) and by[None][1] is None


def test_a_family_of_many_copies(spark):
    base = [f"w{i}" for i in range(120)]
    made = {i: " ".join(base[:k] + [f"x{i % 40}"] + base[k + 1 :]) for i in range(400) for k in [i % 40 * 3]}
    got = found(spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(6))
    assert got == brute(made) and {c for _, c in got.values()} == {0}


def cosine_brute(vectors, threshold=0.9):
    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    m = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = m @ m.T >= threshold
    root = {i: i for i in vectors}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        p, q = find(ids[a]), find(ids[b])
        root[max(p, q)] = min(p, q)
    links = {i: 0 for i in vectors} | {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    return {i: (links[i], find(i), find(i) == i) for i in vectors}


def got_links(df, **kw):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df, **kw).collect()}


def recall(got, want):
    there = sum(w[0] for w in want.values())
    return sum(g[0] for g in got.values()) / there if there else 1.0


def test_embeddings_of_the_table(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    want = cosine_brute({r.vec_id: list(r.embedding) for r in e.collect()})
    got = got_links(e)
    assert all(got[i][0] <= want[i][0] for i in want) and recall(got, want) >= 0.97


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    made = {i: [float(x) for x in centres[i % 40] * rng.uniform(0.5, 3) + rng.normal(size=24) * 0.25] for i in range(3000)}
    made |= {5000 + i: made[7] for i in range(200)}
    made |= {9000: None, 9001: [0.0] * 24, 9002: [None] + [1.0] * 23, 9003: [float("nan")] * 24, 9004: [float("inf")] + [1.0] * 23, 9005: [], 9006: [1e-300] + [0.0] * 23, 9007: [1e-290] + [0.0] * 23}
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in made.items()], "vec_id long, embedding array<double>, label string, `class` string")
    want, got = cosine_brute({i: v for i, v in made.items() if i != 9005}) | {9005: (0, 9005, True)}, got_links(df, shards=4)
    assert set(got) == set(want)
    assert all(got[i] == (0, i, True) for i in (9000, 9001, 9002, 9003, 9004, 9005))
    assert got[9006][1] == 9006 == got[9007][1]
    rest = [i for i in want if i < 9000]
    assert all(got[i][0] <= want[i][0] for i in rest) and recall({i: got[i] for i in rest}, {i: want[i] for i in rest}) >= 0.97
    assert sum(got[i][1] == want[i][1] for i in rest) >= 0.99 * len(rest)


def test_beams_widen_to_a_large_group(spark):
    rng = np.random.default_rng(5)
    made = {i: [float(x) for x in np.ones(16) + rng.normal(size=16) * 0.05] for i in range(1500)}
    got = got_links(spark.createDataFrame(list(made.items()), "vec_id long, embedding array<double>"), shards=2)
    assert recall(got, cosine_brute(made)) >= 0.99 and {g[1] for g in got.values()} == {0}


def test_empty_and_tiny_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.near_duplicates(none).count() == 0
    two = spark.createDataFrame([(2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in hnsw.near_duplicates(two).collect())
    assert [r[:3] for r in rows] == [(-1, 0, -1), (2, 1, 2), (2, 1, 2)]
