"""Opened archives, rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(parts: DataFrame) -> DataFrame:
    """parts(company, download, bytes, superseded): a row a company. A download is superseded when all
    of its parts are."""
    per = parts.groupBy("company", "download").agg(F.count(F.lit(1)).alias("parts"), F.sum("bytes").alias("bytes"), F.bool_and("superseded").alias("gone"))
    return per.groupBy("company").agg(F.count(F.lit(1)).alias("downloads"), F.sum("parts").alias("parts"), F.sum("bytes").alias("bytes"), F.count_if("gone").alias("superseded"))
