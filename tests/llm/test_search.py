"""T-occurrence search and sieves against plain loops."""

import random

import numpy as np

from keepsake.llm import common, jaccard


def test_search_is_the_plain_overlap():
    rnd = random.Random(3)
    for percent in (50, 80, 90, 100):
        sets = []
        for _ in range(120):
            base = rnd.sample(range(60), rnd.randint(1, 40)) if rnd.random() < 0.4 or not sets else list(rnd.choice(sets))
            for _ in range(rnd.randint(0, 3)):
                base[rnd.randrange(len(base))] = rnd.randint(0, 300)
            sets.append(np.unique(np.array(base, np.int64)))
        ids = np.arange(120) * 7 - 50
        roots = np.array([rnd.randint(0, 40) for _ in sets])
        sizes = np.array([len(s) for s in sets])
        half = 70
        held = jaccard.Range(ids[:half], roots[:half], sizes[:half], np.concatenate(sets[:half]))
        a, b = held.search(ids, roots, sizes, np.concatenate(sets), percent)
        want = set()
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:half]):
                same = len(np.intersect1d(x, y))
                if roots[i] != roots[j] and 100 * same >= percent * (len(x) + len(y) - same):
                    want.add((ids[i], ids[j]))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and (want or percent == 100)


def test_long_runs_are_merged_alike():
    sets = [np.unique(np.append(np.arange(20), 1000 + i)) for i in range(900)]
    sizes = np.array([len(s) for s in sets])
    held = jaccard.Range(np.arange(900), np.arange(900), sizes, np.concatenate(sets))
    a, b = held.search(np.array([5, 6]), np.array([5, 6]), sizes[:2], np.concatenate(sets[5:7]), 90)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in (5, 6) for j in range(900) if i != j]


def test_sieve_loses_no_key(spark):
    keys = spark.range(0, 100_000, 97).withColumnRenamed("id", "k")
    may, cannot = common.sieve(keys, "k")(spark.range(100_000).withColumnRenamed("id", "k"))
    got = may.select("k").collect()
    assert may.count() + cannot.count() == 100_000
    assert {r.k for r in got} >= set(range(0, 100_000, 97)) and len(got) < 2000
    assert common.sieve(keys.limit(0), "k")(keys)[0].count() == 0


def test_long_lists_are_asked_by_range(spark, monkeypatch):
    """Chains and passages with every list over the limit, so all of the second search goes by ranges."""
    from test_near import brute, found

    monkeypatch.setattr(jaccard, "LIST", 1)
    monkeypatch.setattr(jaccard, "RANGE", 2000)
    rnd = random.Random(6)
    made = {}
    for family in range(12):
        base = [f"w{rnd.randint(0, 80)}" for _ in range(rnd.randint(20, 90))]
        for _ in range(8):
            own = list(base)
            for _ in range(rnd.randint(1, 3)):
                own[rnd.randrange(len(own))] = f"w{rnd.randint(0, 80)}"
            base = own if rnd.random() < 0.5 else base
            made[len(made)] = " ".join(own)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    assert found(df) == brute(made) and found(df, size=2, percent=70) == brute(made, 70, 2)


def test_a_passage_in_many_documents_makes_no_pairs(spark):
    """Documents that share a long passage but stay under the threshold, beside two real copies."""
    from test_near import brute, found

    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(200)]
    made = {i: " ".join(passage + [f"o{rnd.randint(0, 10**9)}" for _ in range(20)]) for i in range(300)}
    made[300], made[301] = made[7] + " more", made[9] + " words"
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(6)
    assert found(df) == brute(made)
    assert found(df, size=5, percent=80) == brute(made, 80, 5)


def test_sieve_and_forest_of_nothing():
    node, root = common.forest(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(node) == len(root) == 0
