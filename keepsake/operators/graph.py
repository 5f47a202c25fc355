"""Links between records: roots of parent chains, components, groups around seeds.

Each is a loop of joins whose state is a table in the shared folder; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.tables import stash


def roots(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges(node, parent): per node its root and depth. A node without an edge, or whose parent is
    null or no node, is a root of depth 0. Chains are followed by doubling, so 2**rounds links are
    in reach. Nodes in a ring, or below one, have the ring's smallest node as root and no depth."""
    known = edges.groupBy("node").agg(F.min("parent").alias("parent"))
    parents = known.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    start = known.join(parents, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("up"))
    state = stash(start.select("node", F.coalesce("up", "node").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done"), F.coalesce("up", "node").alias("low")), "roots")
    total = state.count()
    passed = 1
    for _ in range(rounds):
        if passed > total or not state.where("NOT done").limit(1).count():
            break
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("end"), F.col("low").alias("low2"))
        step = state.where("NOT done").join(ahead, "at").select("node", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done"), F.least("low", "low2").alias("low"))
        state = stash(state.where("done").unionByName(step), "roots")
        passed *= 2
    # what isn't done now points into a ring; there, low is the ring's least node
    rings = state.where("NOT done")
    named = rings.select("node", "at").join(rings.select(F.col("node").alias("at"), F.col("low").alias("root")), "at").select("node", "root", F.lit(None).cast("long").alias("depth"))
    return state.where("done").select("node", F.col("at").alias("root"), "depth").unionByName(named)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b): per linked node the smallest node in reach."""
    both = stash(links.select("a", "b").where("a <> b").unionAll(links.selectExpr("b AS a", "a AS b").where("a <> b")).distinct(), "links")
    label = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = stash(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("root"), F.col("root").alias("was")), "labels")
        label = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def seed_groups(links: DataFrame) -> DataFrame:
    """links(a, b), a < b: groups around seeds, as taking the nodes in order gives them: a node that no
    group has starts one and takes all later nodes linked with it that no group has. Not a
    closure: members needn't be linked with each other. Per linked node: node, seed.

    A round settles all nodes whose earlier neighbours are settled, or that a seed already holds; the
    first open node has no open one before it, so each round settles some and the loop ends."""
    edges = stash(links.select("a", "b").where("a < b").distinct(), "links")
    state = stash(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.lit(None).cast(edges.schema["a"].dataType).alias("seed")), "seeds")
    while True:
        # earlier neighbours: how many are unsettled; the first that is a seed; the first unsettled
        earlier = edges.join(state.select(F.col("node").alias("a"), F.col("seed").alias("s")), "a").groupBy(F.col("b").alias("node")).agg(
            F.min(F.when(F.col("s").isNull(), F.col("a"))).alias("open"), F.min(F.when(F.col("s") == F.col("a"), F.col("a"))).alias("holder")
        )
        here = state.join(earlier, "node", "left")
        settled = F.when((F.col("holder").isNotNull()) & (F.col("open").isNull() | (F.col("holder") < F.col("open"))), F.col("holder")).when(F.col("open").isNull(), F.col("node"))
        state = stash(here.select("node", F.coalesce("seed", settled).alias("seed")), "seeds")
        if not state.where("seed IS NULL").limit(1).count():
            return state
