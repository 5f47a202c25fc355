"""Cards: which columns are chosen, what isn't a card, what a JSON cell is about."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keepsake.operators import cards as cd
from keepsake.operators import duplicates

KEYS = ("source_id", "table_id")


def made(spark, tables):
    """tables: (source, table, title, columns, rows)."""
    cells = [(s, t, i, j, c, None if r[j] is None else str(r[j])) for s, t, _, columns, rows in tables for i, r in enumerate(rows) for j, c in enumerate(columns)]
    titles = [(s, t, title) for s, t, title, _, _ in tables]
    found, items = cd.cards(
        spark.createDataFrame(cells, "source_id int, table_id string, row_no long, col_no int, col_name string, value string").repartition(3), spark.createDataFrame(titles, "source_id int, table_id string, title string"), KEYS, now_ms=1_735_689_600_000
    )
    return found.collect(), items.collect()


def days(n, *columns):
    return [(f"2024-01-{i + 1:02}", *(c(i) for c in columns)) for i in range(n)]


def test_measures_are_chosen_by_name(spark):
    steps = ["Date", "heart_beat_count", "meal_type", "caffeine", "value"]
    rows = days(5, lambda i: 900 + i, lambda i: i + 1, lambda i: 50, lambda i: 200 + i)
    tables = [
        (1, "a", "Heart rate", ["time", "heart_beat_count", "heart_rate"], days(6, lambda i: 1000 + i, lambda i: 60 + i)), (1, "b", "Water intake", steps, rows), (1, "c", "Food", ["date", "meal_type", "calorie"], days(4, lambda i: i % 4, lambda i: 100 * i)),
        (1, "d", "Step count", ["day", "count"], days(4, lambda i: i)), (1, "e", "Sleep", ["start", "duration"], days(4, lambda i: 400 + i)), (1, "f", "Same", ["date", "value"], days(4, lambda i: 7)), (1, "g", "Nothing known", ["date", "speed"], days(4, lambda i: i)), (1, "h", "One", ["date", "value", "note"], days(1, lambda i: 3, lambda i: "n")),
        (2, "a", "Heart rate", ["time", "heart_rate"], days(2, lambda i: 70 + i)),
    ]
    found, items = made(spark, tables)
    series = {(r.source_id, r.table_id): (r.title, r.unit, r.stat, r.stat_label, r.low, r.high, r.n, r.chart) for r in found if r.kind == "series"}
    assert series == {
        (1, "a"): ("Heart rate", "bpm", 62.5, "average", 60.0, 65.0, 6, True), (1, "b"): ("Water", "", 1010.0, "total", 200.0, 204.0, 5, True), (1, "c"): ("Calories", "kcal", 600.0, "total", 0.0, 300.0, 4, True),
        (1, "d"): ("Steps", "steps", 6.0, "total", 0.0, 3.0, 4, True), (1, "e"): ("Sleep", "min", 401.5, "average", 400.0, 403.0, 4, True), (1, "f"): ("Same", "", 7.0, "average", 7.0, 7.0, 4, False),
        (2, "a"): ("Heart rate", "bpm", 70.5, "average", 70.0, 71.0, 2, False),
    }
    assert [(r.kind, r.n) for r in found if r.table_id == "h"] == [("facts", 3)] and [r.kind for r in found if r.table_id == "g"] == ["list"]
    assert [(r.place, r.value, r.at) for r in sorted(items, key=lambda r: r.place) if (r.source_id, r.table_id, r.kind) == (2, "a", "series")] == [(1, 70.0, dt.datetime(2024, 1, 1)), (2, 71.0, dt.datetime(2024, 1, 2))]


def test_money_in_millionths_and_by_year(spark):
    chats = [("2023-05-01", 10_000_000, "NOK", "a"), ("2024-05-01", 30_000_000, "NOK", "b"), ("2024-06-01", None, "", "c"), (None, -5, "NOK", "d")]
    plain = [("$12.50", "x"), ("$7.50", "y"), ("", "z")]
    found, items = made(spark, [(1, "t", "Live chats", ["date", "price", "currency code", "message"], chats), (1, "p", "Buys", ["price", "currency"], plain), (1, "w", "Whole", ["price", "curr_code"], [(20_000, "EUR"), (9_999, "EUR")])])
    money = {r.table_id: (r.stat, r.high, r.n, r.rows, r.currency) for r in found if r.kind == "money"}
    assert money == {"t": (40.0, 30.0, 2, 4, "NOK"), "p": (20.0, 12.5, 2, 3, None), "w": (29_999.0, 20_000.0, 2, 2, "EUR")}
    assert [(r.place, r.label, r.value, r.n) for r in sorted(items, key=lambda r: r.place or 0) if r.kind == "money"] == [(1, "2023", 10.0, 1), (2, "2024", 30.0, 1)]


def test_labels_facts_rankings_and_what_is_left(spark):
    notes = [(f'[{{"z": {{"path": "/n/Note {i}.txt"}}}}]', "me", f"2024-02-{i + 1:02}" if i else None) for i in range(5)]
    kv = [("height_unit", "cm"), ("birth_date", "19951005"), ("disclosure", "Y"), ("", "v"), ("empty", ""), ("sync", "1")]
    ranked = [(f"k{i % 3}", f"{i}" * 100) for i in range(12)]
    found, items = made(
        spark,
        [(1, "n", "Notes", ["content", "account_name", "modified"], notes), (1, "k", "Me", ["key", "value"], kv), (1, "r", "Kinds", ["sort", "text"], ranked), (1, "x", "Ids", ["id"], [(1,), (2,)]), (2, "x", "Ids", ["id"], [(1,)]), (1, "two", "Two", ["sort", "long"], [(f"k{i % 2}", "w " * 60) for i in range(8)])],
    )
    kinds = {(r.source_id, r.table_id): (r.kind, r.n) for r in found}
    assert kinds == {(1, "n"): ("list", 5), (1, "k"): ("facts", 3), (1, "r"): ("rank", 12), (1, "two"): ("list", 8), (None, None): ("other", 2)}
    shown = lambda kind: [(r.place, r.label, r.text, r.n) for r in sorted(items, key=lambda r: (r.place or 0, r.source_id)) if r.kind == kind]
    assert [x[1] for x in shown("list") if x[1].startswith("Note")] == ["Note 4", "Note 3", "Note 2", "Note 1", "Note 0"]
    assert shown("facts") == [(1, "Height unit", "cm", None), (2, "Born", "5 Oct 1995", None), (3, "Disclosure", "Yes", None)]
    assert shown("rank") == [(1, "k0", None, 4), (2, "k1", None, 4), (3, "k2", None, 4)] and shown("other") == [(None, "Ids", None, 2), (None, "Ids", None, 1)]
    scores = sorted(((r.score, r.kind) for r in found), reverse=True)
    assert [k for _, k in scores] == ["facts", "rank", "list", "list", "other"]


def test_a_single_thin_table_is_a_count_and_no_tables_are_no_cards(spark):
    found, items = made(spark, [(1, "x", "Ids", ["id"], [(1,), (2,)])])
    assert [(r.kind, r.stat, r.stat_label, r.n, r.rows) for r in found] == [("count", 2.0, "records", 1, 2)] and items == []
    assert made(spark, [(1, "none", "Empty", ["id"], [])]) == ([], [])


@pytest.mark.parametrize("cell, want", [(" a ", "a"), ('{"title": "T", "a": {"name": "n"}}', "T"), ('{"a": {"name": "n"}, "Title": "x.y.txt"}', "x.y"), ('[{"b": 1}, {"path": "a\\\\b/c.md"}]', "c"), ('{"a": 1}', ""), ("{broken", ""), ('{"name": {"x": "y"}}', ""), ("", "")])
def test_unwrap(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(cd.unwrap(F.col("c")).alias("c")).first()["c"] == want


def test_prints_refuse_long_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64)], "i long, v array<double>")
    assert duplicates.fingerprints(df, "v", ["i"]).count() == 1
    with pytest.raises(Exception, match="64 components at most"):
        duplicates.fingerprints(spark.createDataFrame([(1, [1.0] * 65)], "i long, v array<double>"), "v", ["i"]).collect()
