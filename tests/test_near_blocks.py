"""Prints whose bands would be too narrow are compared by pairs of blocks."""

import random

from keepsake.operators import duplicates as dp


def test_pairs_of_blocks_are_all_pairs(spark, monkeypatch):
    for name, value in {"BLOCK": 16, "TASKS": 3, "ROWS_EACH": 100, "ROWS_AT_ONCE": 5, "PAIRS_AT_ONCE": 7}.items():
        monkeypatch.setattr(dp, name, value, raising=False)
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(9)]
    prints = [(f"k{i % 140}", base[i % 9] ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 14))), rnd.choice([0.0, 0.03, 0.09, float("nan")]), rnd.choice([0.05, 0.2])) for i in range(150)]
    want = sorted((min(p[0], q[0]), max(p[0], q[0]), (p[1] ^ q[1]).bit_count()) for i, p in enumerate(prints) for q in prints[:i] if p[0] != q[0] and (p[1] ^ q[1]).bit_count() <= 20 and min(p[3], q[3]) >= 0.1 and abs(p[2] - q[2]) <= 0.05)
    found = dp.near_pairs(spark.createDataFrame([*prints, (None, 1, 0.0, 0.2)], "id string, bits long, mean double, sd double"), "id", 20, 0.1, 0.05, width=63)
    assert len(want) > 50 and sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert dp.near_pairs(spark.createDataFrame([], "id long, bits long, mean double, sd double"), "id", 20).count() == 0
