"""Places on a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bins(places: DataFrame, width: int = 1000, height: int = 500, order: str = "at") -> DataFrame:
    """places(lon, lat) on an equirectangular map: points of the map with how many places they have and
    the first of them."""
    x = F.floor((F.col("lon") + 180) / 360 * width + 0.5)
    y = F.floor((90 - F.col("lat")) / 180 * height + 0.5)
    located = places.where("lon IS NOT NULL AND lat IS NOT NULL")
    return located.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
