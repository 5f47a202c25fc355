"""The near_duplicates stage against brute force over five-word shingles."""

import corpus_pipeline as cp
from test_near import brute


def test_copies_share_four_fifths_of_their_five_word_shingles(spark, data, docs):
    """A replaced passage, or single words far apart: five-word similarity over 0.8, three-word under 0.9."""
    base = lambda f: [f"f{f}w{i}" for i in range(200)]
    passage = base(1)[:90] + [f"new{i}" for i in range(12)] + base(1)[102:]
    single = [f"new{i}" if i % 50 == 20 else w for i, w in enumerate(base(2))]
    less = base(3)[:90] + [f"new{i}" for i in range(20)] + base(3)[110:]
    made = dict(enumerate(map(" ".join, [base(1), passage, base(2), single, base(3), less])))
    planted = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in made.items()], docs.schema)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, planted, data).collect()) == [0, 2, 4, 5]
    want = brute({r.doc_id: r.text for r in docs.collect()}, 80, 5)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, data).collect()) == sorted({c for _, c in want.values()})
