"""Long series are several tasks."""

from pyspark.sql import functions as F

from keepsake.operators import series


def test_points_of_one_series_are_dealt_to_shares(spark):
    points = spark.range(20_000).select(F.lit("a").alias("series"), F.col("id").alias("t"), (F.col("id") % 10).cast("double").alias("v"))
    got = series.time_buckets(points, 10)
    assert "_share" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.bucket, r.n, r.lo, r.hi, r.v) for r in got.collect()) == [(i, 2000, 0.0, 9.0, 4.5) for i in range(10)]
