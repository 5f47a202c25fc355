"""Appending exports and changing states: batches that come again, late changes, nulls."""

import pytest
from pyspark.sql import functions as F

from keepsake.streaming import counters
from keepsake.streaming import library as lb

ENTRIES = "key string, crc long, size long, path string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark):
    return lb.folder(spark)


def put(spark, table, number, *entries):
    lb.append_batch(spark.createDataFrame(list(entries), ENTRIES), number, table, ["key", "crc", "size"], ["path"])


def test_a_batch_that_runs_again_changes_nothing(spark, table):
    first, second = [("a", 1, 5, "x"), ("a", 1, 5, "w"), ("b", 1, 5, "x"), ("a", None, 5, "n")], [("a", 1, 5, "z"), ("a", 2, 5, "z"), ("a", None, 5, "n"), (None, 1, 1, "q")]
    put(spark, table[0], 0, *first)
    put(spark, table[0], 1, *second)
    want = [("a", 1, 5, "w", 0), ("a", 2, 5, "z", 1), ("a", None, 5, "n", 0), ("a", None, 5, "n", 1), ("b", 1, 5, "x", 0), (None, 1, 1, "q", 1)]
    assert rows(lb.library(spark, table[0])) == sorted(want, key=repr)
    put(spark, table[0], 1, *second)
    put(spark, table[0], 0, *first)
    assert rows(lb.library(spark, table[0])) == sorted(want, key=repr)
    lb.compact(spark, table[0], table[0] + "-c")
    assert rows(lb.library(spark, table[0] + "-c")) == sorted(want, key=repr)
    put(spark, table[0] + "-c", 2, ("b", 1, 5, "again"), ("b", 9, 5, "new"))
    assert [r[3] for r in rows(lb.library(spark, table[0] + "-c").where("batch = 2"))] == ["new"]


def test_two_runs_equal_one(spark, table, tmp_path):
    every = [(k, c, 5, f"{k}{c}{i}") for i, (k, c) in enumerate((k, c % 4) for k in "ab" for c in range(12))]
    one, two = lb.folder(spark), lb.folder(spark)
    for place, parts in ((one, [every]), (two, [every[:9], every[9:]])):
        inbox = f"file://{tmp_path}/{len(parts)}"
        for part in parts:
            spark.createDataFrame(part, ENTRIES).coalesce(1).write.mode("append").parquet(inbox)
            for _ in range(2):  # the second finds nothing new
                lb.append(counters.event_stream(spark, inbox, spark.createDataFrame([], ENTRIES).schema), *place, ["key", "crc", "size"], ["path"])
    assert rows(lb.library(spark, one[0]).select("key", "crc")) == rows(lb.library(spark, two[0]).select("key", "crc")) and lb.library(spark, one[0]).count() == 8


def test_states_by_order_not_by_arrival(spark, table, tmp_path):
    schema = "node string, at long, parent string"
    inbox = f"file://{tmp_path}/in"
    for part in ([("a", 5, "b"), ("b", 1, "c"), ("x", 1, "y"), (None, 1, "z")], [("a", 2, "q"), ("b", 3, None)], [("c", 9, "a"), ("x", 2, "x")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        lb.run_states(counters.event_stream(spark, inbox, spark.createDataFrame([], schema).schema), *table, "node", ["at"])
    assert rows(lb.states(spark, table[0], "node")) == [("a", 5, "b"), ("b", 3, None), ("c", 9, "a"), ("x", 2, "x")]
    assert [(r.node, r.root) for r in lb.people(lb.states(spark, table[0], "node")).orderBy("node").collect()] == [("a", "b"), ("b", "b"), ("c", "b"), ("x", "x")]


def test_imported_states_replace(spark):
    own, new = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), spark.createDataFrame([("b", None), ("c", "4")], "k string, v string")
    assert rows(lb.import_states(own, new, "k")) == [("a", "1"), ("b", None), ("c", "4")]


def test_newest_batch_replaces(spark, table):
    put(spark, table[0], 0, ("a", 1, 5, "x"), ("a", 2, 6, "y"), ("b", 1, 7, "z"))
    put(spark, table[0], 1, ("a", 3, 5, "v"))
    assert rows(lb.current(spark, table[0], ["size"], "key").select("path", "newest")) == [("v", True), ("y", False), ("z", True)]
    assert lb.library(spark, table[0]).where(F.col("batch") == 0).count() == 3
