"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating; how often a document may be taken.
WEIGHTS, EPOCHS = (1, 2, 3), 3
#: Finish times are counted in bins of 1 / BINS, so the table that is cut has at most FAR * BINS rows.
BINS, FAR = 4096, 4


@dataclass
class Mix:
    """sources: source, place, source_size, target; before: source, slot and the words that the
    source has in earlier slots; cut: the last item taken (finish time, shuffle key, place)."""

    sources: DataFrame
    before: DataFrame
    cut: tuple[float, str, int] | None


def shuffle_key(id_col: str = "doc_id", seed: str = "mix") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc (all columns), doc_id, source, _size (words of the whole text, null: 0), _key (shuffled order)
    and _slot."""
    key, size = shuffle_key(), F.regexp_count(common.text_of(text_col), F.lit(common.WORD)).cast("long")
    return docs.select(F.struct("*").alias("doc"), "doc_id", "source", size.alias("_size"), key.alias("_key"), F.substring(key, 1, 3).alias("_slot"))


def targets(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """One row a source: source, place, source_size, target.

    Shares follow the weights; a source stops at `most` times its size and the excess goes to the
    others by weight until none is above. In order of size over weight the sources that stop come
    first, so the level of the others is the greatest that some source can take uncapped. The
    windows run over sources, not rows."""
    per = light.groupBy("source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = per.withColumn("place", F.row_number().over(order)).withColumn("w", w.cast("long"))
    every = Window.partitionBy()
    by = Window.orderBy(F.col("source_size") / F.col("w"), "place")
    total = F.sum("source_size").over(every)
    earlier = F.coalesce(F.sum(F.col("source_size") * most).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = placed.withColumn("left", total - earlier).withColumn("ws", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    open_ = F.col("left") * F.col("w") <= F.col("source_size") * most * F.col("ws")
    level = F.max(F.when(open_, F.col("left") / F.col("ws"))).over(every)
    return rest.withColumn("level", level).select(
        "source", "place", "source_size", F.least((F.col("source_size") * most).cast("double"), F.col("level") * F.col("w")).alias("target")
    )


def _cumulated(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows with place, source_size, target and _cum, the words of its source up to and with a row.
    A source is dealt over its slots, so a hot source is no hot task."""
    w = Window.partitionBy("source", "_slot").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_in_slot", F.sum("_size").over(w))
    b = mix.before.select(F.col("source").alias("_s"), F.col("_slot").alias("_l"), "_before", "place", "source_size", "target")
    return here.join(b, here["source"].eqNullSafe(b["_s"]) & (here["_slot"] == b["_l"])).withColumn("_cum", F.col("_before") + F.col("_in_slot")).drop("_s", "_l", "_before", "_in_slot")


def _finish(epoch: int) -> Column:
    """Virtual finish time: words of the source up to and with this item, over the source's target."""
    return (F.col("source_size") * epoch + F.col("_cum")) / F.col("target")


def plan_mix(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> Mix:
    """light: doc_id, source, _size, _key, _slot, in a stored table. Items are documents, once an
    epoch; the cut lies where all items in order of finish time reach the size of all documents.

    Rows of size 0 are no items. Items of equal finish time go by key, then by their source's place; rows equal
    in all of these are taken together. Without words, or rows, there is no cut."""
    sources = common.stash(targets(light, weights, most), "sources")
    slots = light.groupBy("source", "_slot").agg(F.sum("_size").alias("n"))
    w = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    named = sources.withColumnRenamed("source", "_n")
    before = common.stash(slots.join(named, slots["source"].eqNullSafe(named["_n"])).drop("_n"), "before")
    mix = Mix(sources, before, None)
    items = (
        _cumulated(light.where("_size > 0"), mix)
        .select("_size", "_key", "place", F.explode(F.array(*(_finish(e) for e in range(most)))).alias("_finish"))
        .withColumn("_bin", F.least(F.floor(F.col("_finish") * BINS), F.lit(FAR * BINS)))
    )
    bins = items.groupBy("_bin").agg(F.sum("_size").alias("n"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    crossing = bins.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > budget).orderBy("_bin").first()
    if crossing is None:
        return mix
    inside = Window.partitionBy("_bin").orderBy("_finish", "_key", "place").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        items.where(F.col("_bin") == crossing["_bin"])
        .withColumn("upto", F.sum("_size").over(inside) + (crossing["upto"] - crossing["n"]))
        .where(F.col("upto") <= budget)
        .agg(F.max(F.struct("_finish", "_key", "place")).alias("m"))
        .first()["m"]
    )
    mix.cut = (last["_finish"], last["_key"], last["place"]) if last else (crossing["_bin"] / BINS, "", 0)
    return mix


def apply_mix(rows: DataFrame, mix: Mix, most: int = EPOCHS) -> DataFrame:
    """rows with source_size, target and _copies, how often the mix takes a row (0 to most; 0 for rows of size
    0). Null sources meet the null source; repeated rows give a row each; columns of rows must not be
    called like the mix's own."""
    all_ = _cumulated(rows, mix)
    n = F.lit(0)
    for e in range(most):
        f = _finish(e)
        if mix.cut is None:
            taken = F.lit(True)
        else:
            at, key, place = mix.cut
            taken = (f < F.lit(at)) | ((f == F.lit(at)) & ((F.col("_key") < key) | ((F.col("_key") == key) & (F.col("place") <= place))))
        n = n + F.when((F.col("_size") > 0) & taken, F.lit(1)).otherwise(F.lit(0))
    return all_.withColumn("_copies", n).drop("_cum", "place")


def last_taken(copied: DataFrame, most: int = EPOCHS) -> DataFrame:
    """copied: light rows with _copies. One row a source: its rows up to and with `last` (key, id, size) are
    taken hi times, those after it lo times, for in a source's order later rows are taken at most as
    often as earlier ones, and once less at most. tied: rows equal to last are on both sides."""
    at = F.struct("_key", "doc_id", "_size")
    after_ = [F.min(F.when(F.col("_copies") == k, at)).alias(f"n{k}") for k in range(most + 1)]
    upto = [F.max(F.when(F.col("_copies") == k, at)).alias(f"m{k}") for k in range(most + 1)]
    per = copied.where("_size > 0").groupBy("source").agg(F.max("_copies").alias("hi"), F.min("_copies").alias("lo"), *upto, *after_)
    last, after = (F.coalesce(*(F.when(F.col(side) == k, F.col(f"{c}{k}")) for k in range(most + 1))) for side, c in (("hi", "m"), ("lo", "n")))
    return per.select("source", "hi", "lo", last.alias("last"), ((F.col("hi") > F.col("lo")) & last.eqNullSafe(after)).alias("tied"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: docs' rows and columns, a row as often as the mix takes it.

    docs has doc_id, source and text. Null texts and texts without words have size 0 and are not
    taken; a null source is a source of its own, the last; repeated rows are documents of their
    own; an empty table gives none. The order follows md5 of the id, so reruns agree. Texts aren't
    shuffled: the cut becomes one row a source, the last of its rows to be taken once more, and
    rows are compared with it where they are read. Only rows with one id, source and size that the
    cut runs through are numbered."""
    light = common.stash(sized(docs).select("doc_id", "source", "_size", "_key", "_slot"), "sized")
    copied = common.stash(apply_mix(light, plan_mix(light)), "copied")
    rule = common.stash(last_taken(copied), "rule")
    named = rule.withColumnRenamed("source", "_s")
    rows = sized(docs).where("_size > 0")
    met = rows.join(named, rows["source"].eqNullSafe(named["_s"])).withColumn("_at", F.struct("_key", "doc_id", "_size"))
    told = met.withColumn("_copies", F.when(F.col("_at") <= F.col("last"), F.col("hi")).otherwise(F.col("lo")))
    through = F.col("tied") & F.col("_at").eqNullSafe(F.col("last"))
    taken = told.where(~through).select("doc", "_copies")
    if rule.where("tied").limit(1).count():
        here = copied.join(named.where("tied"), copied["source"].eqNullSafe(named["_s"])).where(F.struct("_key", "doc_id", "_size").eqNullSafe(F.col("last")) & (F.col("_copies") == F.col("hi")))
        first = here.groupBy("_s").agg(F.count(F.lit(1)).alias("first")).withColumnRenamed("_s", "_f")
        place = F.row_number().over(Window.partitionBy("_s").orderBy(F.xxhash64("doc")))
        split = told.where(through).withColumn("_place", place).join(first, F.col("_s").eqNullSafe(F.col("_f")))
        taken = taken.unionAll(split.select("doc", F.when(F.col("_place") <= F.col("first"), F.col("hi")).otherwise(F.col("lo")).alias("_copies")))
    return taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("doc.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document.

    A null, empty or wordless text has size 0 and is never taken; very long ones count whole. A null source
    is a source of its own and comes last; a null id is an id like any other. Repeated rows are
    documents of their own: rows equal in key, id and size tie, and follow each other in an order that
    changes nothing here. Other columns are not read, whatever their names; an empty table gives none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = common.stash(sized(docs).select("doc_id", "source", "_size", "_key", "_slot"), "sized")
    return apply_mix(light, plan_mix(light)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS w FROM s),
r AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w),
l AS (SELECT *, max(CASE WHEN rest * w <= 3 * source_size * ws THEN CAST(rest AS DOUBLE) / CAST(ws AS DOUBLE) END) OVER () AS level FROM r),
t AS (SELECT source, place, source_size, least(CAST(3 * source_size AS DOUBLE), level * w) AS target FROM l),
c AS (
  SELECT d.*, t.place, t.source_size, t.target,
         sum(size) OVER (PARTITION BY t.place ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT c.*, e, CAST(source_size * e + cum AS DOUBLE) / target AS f FROM c, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
u AS (SELECT *, sum(size) OVER (ORDER BY f, k, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM i),
n AS (SELECT doc_id, place, cum, count(*) AS copies FROM u WHERE upto <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, c.source_size, c.target, CAST(c.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM c LEFT JOIN n ON c.doc_id IS NOT DISTINCT FROM n.doc_id AND c.place = n.place AND c.cum = n.cum AND c.size > 0
"""
