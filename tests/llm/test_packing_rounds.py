"""Packing in rounds leaves no two sequences that fit together."""

import pytest

from keepsake.llm import packing


@pytest.mark.parametrize("lengths", [[1100] * 40 + [800] * 60 + [700] * 41, [1030] * 90 + [1010] * 33, [2043] * 100 + [5] * 9])
def test_no_two_sequences_fit_together(spark, lengths):
    items = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(items, items_per_part=10, fan_in=2, carry=1).collect()
    loads = {}
    for r in rows:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert sorted(r.length for r in rows) == sorted(lengths)
    least = sorted(loads.values())[:2]
    assert max(loads.values()) <= 2048 and sum(least) > 2048
