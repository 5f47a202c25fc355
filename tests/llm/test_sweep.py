"""Scratch tables go when nothing refers to them any more, and not before."""

import os

from pyspark.sql import functions as F

from keepsake.llm import common


def there(path):
    return os.path.isdir(path.removeprefix("file:").replace("//", "/"))


def test_tables_in_use_stay(spark):
    common.sweep(spark)
    paths = [common.scratch_path(spark, f"sweep{i}") for i in range(4)]
    a, b, c, d = (common.stash(spark.range(10).withColumn("k", F.lit(i)), "t", p) for i, p in enumerate(paths))
    made = a.where("id > 3").groupBy("k").count()
    c.createOrReplaceTempView("swept")
    joined = d.join(b, "id").select(d.id)
    del a, b, c, d
    common.sweep(spark)
    assert all(map(there, paths)) and made.first()["count"] == 6 and joined.count() == 10 and spark.table("swept").count() == 10
    del made, joined
    for _ in range(5):
        common.sweep(spark)
    assert [there(p) for p in paths] == [False, False, True, False] and spark.table("swept").count() == 10
    spark.catalog.dropTempView("swept")
    for _ in range(5):
        common.sweep(spark)
    assert not there(paths[2])


def test_a_stage_leaves_what_a_result_still_reads(spark, docs):
    import corpus_pipeline

    lazy = corpus_pipeline.quality_rules(spark, docs, "")
    mixed = corpus_pipeline.source_mix(spark, docs, "")
    assert corpus_pipeline.packed(spark, docs.limit(3), "").count() >= 3
    assert lazy.count() > 0 and mixed.count() > 0
