"""Measures over time: histograms, buckets, headlines, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import times
from keepsake.tables import stash


def hour_histogram(points: DataFrame, at: str = "at") -> DataFrame:
    """24 rows, hours without points too."""
    spark = points.sparkSession
    found = points.where(F.col(at).isNotNull()).groupBy(F.hour(at).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(24).withColumnRenamed("id", "hour").join(found, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def week_grid(points: DataFrame, at: str = "at") -> DataFrame:
    """7 x 24 rows, weekday 0 being Sunday."""
    spark = points.sparkSession
    found = points.where(F.col(at).isNotNull()).groupBy(times.weekday(at).alias("weekday"), F.hour(at).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return grid.join(found, ["weekday", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def busiest_run(points: DataFrame, at: str = "at", shortest: int = 3, longest: int = 8) -> DataFrame:
    """The run of hours, around midnight too, that holds most beyond its share of an even day; of equal
    ones the shortest, then the earliest. No row under 24 points. quiet_hour: the hour with the
    fewest points of those that have some."""
    found = points.where(F.col(at).isNotNull()).groupBy(F.hour(at).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    table = found.agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("by_hour"), F.sum("n").alias("total"), F.min(F.struct("n", "h")).alias("quiet"))
    counts = table.where("total >= 24").withColumn("hist", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("by_hour", h), F.lit(0))))

    def run(length: Column, start: Column) -> Column:
        held = F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0).cast("long"), lambda a, k: a + F.get("hist", (start + k) % 24))
        # in 24ths of the total, so whole numbers are compared
        return F.struct((held * 24 - length * F.col("total")).alias("excess"), (-length).alias("l"), (-start).alias("s"), held.alias("held"))

    runs = F.flatten(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda s: run(n, s))))
    best = counts.withColumn("best", F.array_max(runs))
    return best.select(
        (-F.col("best.s")).cast("long").alias("start"), (-F.col("best.l")).cast("long").alias("hours"), F.col("best.held").alias("n"),
        F.col("total"), F.col("quiet.h").cast("long").alias("quiet_hour"),
    )


#: Shares that a series' points are dealt to by their time.
SHARES = 64


def time_buckets(points: DataFrame, want: int, by: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """Mean, count, least and greatest value in each of `want` equal spans between a series' first and
    last point. Empty spans are skipped; a series of one instant is one bucket; a series of at most
    `want` points comes back as it is, a bucket a point. t is a whole number (microseconds). A series' points
    meet its extent in SHARES shares, so few long series aren't few tasks."""
    extent = points.groupBy(by).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.count(F.lit(1)).alias("_n"))
    extent = extent.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    dealt = points.withColumn("_share", F.pmod(F.xxhash64(t), F.lit(SHARES).cast("long")))
    spread = dealt.join(extent, [by, "_share"]).drop("_share").withColumn("_span", F.col("_t1") - F.col("_t0"))
    few = F.col("_n") <= want
    slot = F.least(F.expr(f"(({t} - _t0) * {want}) div _span"), F.lit(want - 1))
    bucket = F.when(few, F.col(t) - F.col("_t0")).when(F.col("_span") <= 0, F.lit(0)).otherwise(slot)
    spread = spread.withColumn("bucket", bucket)
    grouped = spread.groupBy(by, "bucket", few.alias("_few"), (F.col("_span") <= 0).alias("_one")).agg(
        F.min("_t0").alias("_t0"), F.min("_span").alias("_span"), F.min(t).alias("_first"), F.sum(v).alias("_sum"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    at = F.when(F.col("_few") | F.col("_one"), F.col("_first")).otherwise(F.col("_t0") + F.expr(f"(_span * (2 * bucket + 1)) div {2 * want}"))
    return grouped.select(by, "bucket", at.alias("t"), (F.col("_sum") / F.col("n")).alias("v"), "n", "lo", "hi")


def rebucket(buckets: DataFrame, want: int, by: str = "series") -> DataFrame:
    """Buckets into fewer ones: the mean of means, the spread kept (least lo, greatest hi)."""
    extent = buckets.groupBy(by).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    slot = F.when(F.col("_t1") <= F.col("_t0"), F.lit(0)).otherwise(F.least(F.expr(f"((t - _t0) * {want}) div (_t1 - _t0)"), F.lit(want - 1)))
    return buckets.join(extent, by).groupBy(by, slot.alias("bucket")).agg(F.avg("v").alias("v"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))


def density(points: DataFrame, start: int, end: int, slots: int = 210, t: str = "t") -> DataFrame:
    """Points in equal slots between two instants (those outside go to the end slots), with one of four
    strengths by the share of the fullest slot."""
    slot = F.least(F.greatest(F.expr(f"(({t} - {start}) * {slots}) div {end - start}"), F.lit(0)), F.lit(slots - 1))
    counted = points.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    top = counted.agg(F.max("n").alias("_top"))
    share = F.col("n") / F.col("_top")
    strength = F.when(share > 0.66, 4).when(share > 0.33, 3).when(share > 0.12, 2).otherwise(1)
    return counted.join(F.broadcast(top)).select("slot", "n", strength.cast("long").alias("strength"))  # one row


def thin(points: DataFrame, keep: int = 150, by: str = "series", order: str = "t", parts: int | None = None) -> DataFrame:
    """Every ceil(n / keep)-th point of a series in order, for drawing. Points are dealt by ranges of series and
    order and numbered there; only the sizes of a series' ranges are added up, so a long series is
    spread over tasks."""
    n = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(points.repartitionByRange(n, by, order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), before.alias("_before"), F.ceil(F.sum("_n").over(over) / keep).alias("_step"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part", by).orderBy(order)) - 1)
    placed = inside.join(sizes, inside[by].eqNullSafe(sizes["_by"]) & (inside["_part"] == sizes["_at"]))
    return placed.where("(_before + _in) % _step = 0").select(*points.columns)


def headline(points: DataFrame, agg: Column, by: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """One number a series by its rule: sum, mean, last (the value at the greatest t) or count."""
    each = points.withColumn("_agg", agg).groupBy(by, F.col("_agg").alias("agg")).agg(F.sum(v).alias("_s"), F.count(v).alias("_n"), F.max_by(v, t).alias("_l"))
    value = F.when(F.col("agg") == "sum", F.col("_s")).when(F.col("agg") == "mean", F.col("_s") / F.col("_n")).when(F.col("agg") == "last", F.col("_l")).otherwise(F.col("_n"))
    return each.select(by, "agg", value.cast("double").alias("value"), F.col("_n").alias("n"))


def trend(points: DataFrame, by: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """First and last mean of a series of daily points, over max(2, round(n / 6)) points each; percent
    change, steady under 3. No row under 8 points or from 0. The window is as long as a series has
    days."""
    w = Window.partitionBy(by)
    placed = points.withColumns({"_n": F.count(F.lit(1)).over(w), "_up": F.row_number().over(w.orderBy(t))})
    k = F.greatest(F.lit(2), F.floor(F.col("_n") / 6 + 0.5))
    placed = placed.withColumns({"_first": F.col("_up") <= k, "_last": F.col("_up") > F.col("_n") - k})
    ends = placed.groupBy(by).agg(F.avg(F.when(F.col("_first"), F.col(v))).alias("start"), F.avg(F.when(F.col("_last"), F.col(v))).alias("end"), F.max("_n").alias("n"))
    pct = (F.col("end") - F.col("start")) / F.abs("start") * 100
    return ends.where("n >= 8 AND start <> 0").select(by, "n", "start", "end", pct.alias("pct"), (F.abs(pct) < 3).alias("steady"))


def movers(trends: DataFrame, limit: int = 3, by: str = "series") -> DataFrame:
    return trends.where("NOT steady").orderBy(F.desc(F.abs("pct")), by).limit(limit)


def recent_mean(points: DataFrame, last: int = 10, by: str = "series", t: str = "t", v: str = "v") -> DataFrame:
    """Mean of a series' last points. Ranks are limited before the shuffle."""
    ranked = points.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(t)))).where(F.col("_r") <= last)
    return ranked.groupBy(by).agg(F.avg(v).alias("v"), F.count(F.lit(1)).alias("n"))


def per_period(rows: DataFrame, period: Column, name: str, amount: Column | None = None) -> DataFrame:
    aims = [F.count(F.lit(1)).alias("n")]
    if amount is not None:
        aims += [F.sum(amount).alias("total"), F.max(amount).alias("most")]
    return rows.groupBy(period.alias(name)).agg(*aims)


def health_days(readings: DataFrame, summed: list[str] | str, *keep: str) -> DataFrame:
    """readings(type, at, value): per type and day the sum for counted types (a list, or an expression on
    their names), else the mean. Time in bed is left out where time asleep is known for the day. Columns
    named in keep tell series apart."""
    days = readings.where("at IS NOT NULL").withColumn("day", times.day("at"))
    asleep = days.where("type = 'Asleep'").select(*keep, "day").distinct().withColumn("_asleep", F.lit(True))
    kept = days.join(asleep, [*keep, "day"], "left").where("type <> 'InBed' OR _asleep IS NULL").drop("_asleep")
    counted = F.col("type").rlike(summed) if isinstance(summed, str) else F.col("type").isin(summed)
    value = F.when(counted, F.col("_sum")).otherwise(F.col("_sum") / F.col("n"))
    return kept.groupBy(*keep, "type", "day").agg(F.sum("value").alias("_sum"), F.count("value").alias("n")).select(*keep, "type", "day", value.cast("double").alias("value"), "n")


def unpivot_best(wide: DataFrame, ids: list[str], columns: list[str], prefer: str = "average") -> DataFrame:
    """A wide table as one series a measure: of columns with the same stem (`average x`, `max x`, `min x`)
    the preferred one."""
    chosen: dict[str, str] = {}
    for c in columns:
        stem = c.lower()
        for word in ("average", "avg", "max", "min"):
            stem = stem.replace(f"{word} ", "").replace(f"{word}_", "")
        if stem not in chosen or c.lower().startswith(prefer):
            chosen[stem] = c
    renamed = wide.select(*ids, *(F.col(c).cast("double").alias(s) for s, c in chosen.items()))
    return renamed.unpivot(ids, list(chosen), "series", "value").where("value IS NOT NULL")


def best_series(series: DataFrame, kind: str = "kind", by: str = "series") -> DataFrame:
    """Of each kind the series with the most readings, then the first by name."""
    sizes = series.groupBy(kind, by).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), by))
    return sizes.withColumn("_r", rank).where("_r = 1").drop("_r")


def composition(rows: DataFrame, part: str, value: str) -> DataFrame:
    """Mean of each part, and its share of all means in percent. The window has a row a part."""
    means = rows.groupBy(part).agg((F.sum(value) / F.count(value)).alias("mean"))
    return means.withColumn("share", F.col("mean") * 100 / F.sum("mean").over(Window.partitionBy()))
