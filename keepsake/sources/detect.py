"""Which service an archive is from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import paths


def detect_providers(entries: DataFrame) -> DataFrame:
    """entries(source_id, path): per archive the provider that most of its paths speak for, the first on
    the list of equal ones, null if none does; score: how many paths do."""
    hits = paths.provider_hits(F.col("path"))
    counts = entries.groupBy("source_id").agg(*(F.count_if(h).alias(name) for name, h in hits.items()))
    ranked = F.array_max(F.array(*(F.struct(F.col(name).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("provider")) for i, name in enumerate(hits))))
    best = counts.select("source_id", ranked.alias("b"))
    return best.select("source_id", F.when(F.col("b.score") > 0, F.col("b.provider")).alias("provider"), F.col("b.score").alias("score"))
