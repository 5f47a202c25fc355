"""Names of one folder are as many tasks as their number asks for."""

from keepsake.operators import joins


def test_names_of_a_folder_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(joins, "NAMES_EACH", 10, raising=False)
    photos = spark.createDataFrame([(f"d/{i}.JPG",) for i in range(60)] + [("d/none.JPG",)], "path string")
    side = spark.createDataFrame([(f"d/{i}.JPG.s.json" if i % 2 else f"d/{i}.json",) for i in range(60)], "path string")
    got = joins.sidecar_forms(photos, side)
    assert got.rdd.getNumPartitions() == 13
    want = [(f"d/{i}.JPG", "supplemental" if i % 2 else "basename", f"d/{i}.JPG.s.json" if i % 2 else f"d/{i}.json") for i in range(60)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*want, ("d/none.JPG", None, None)], key=str)
