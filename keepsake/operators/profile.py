"""Tables of unknown columns: cells in long form, column profiles, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import dates, numbers, units

#: What column names tell.
ID_WORDS = r"(?i)uuid|guid|^id$| id$|hash|token|key$|package|pkg|imei|serial|deviceid"
MONEY_WORDS = r"(?i)amount|price|paid|payment|cost|charge|\bfee\b|spend|revenue|\btax\b"
NOT_MONEY = r"(?i)count|qty|quantity|number|index|rate$|percent"
URL_WORDS = "(?i)url|link|address|site|domain"
TITLE_WORDS = "(?i)title|name|app|content|subject|label|description|note|activity|item|product"
NOISE = r"(?i)offset|uuid|guid|pkg|package|version|_?flag|revision|deviceid|device.?uuid|datauuid|^id$|[ _]id$|hash|token|sync|deleted|extra.?data|binning|checksum"
#: Shares of cells that make a type; most distinct values of a category; where counting stops.
DATE_SHARE, NUMBER_SHARE, URL_SHARE, CATEGORY_MOST, DISTINCT_MOST = 0.7, 0.8, 0.6, 40, 401
#: Kinds of card by weight.
WEIGHTS = {"series": 100, "money": 90, "facts": 70, "rank": 60, "list": 40, "count": 10}


def cells(table: DataFrame, table_id: str, columns: list[str] | None = None) -> DataFrame:
    """(table_id, col_no, col_name, value) of a wide table, values as strings; one pass, no shuffle."""
    names = columns or table.columns
    one = F.array(*(F.struct(F.lit(i).alias("col_no"), F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)))
    return table.select(F.inline(one)).select(F.lit(table_id).alias("table_id"), "col_no", "col_name", "value")


def column_profile(long: DataFrame, now_ms: int | None = None, by: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """A row a column of every table: filled, distinct (stops at 401), type and, for numbers, least,
    greatest, sum and mean. Types go by the shares of all filled cells, in this order: empty, id (by
    name), date, money or number, url, category, title (by name), text. All tables in one job; by tells
    them apart."""
    value = F.when(F.trim("value") != "", F.col("value"))
    # equal cells are put together first: expressions run once a distinct value, counts weigh them
    cells_ = long.groupBy(*by, "col_no", "col_name", value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    v, c = F.col("v"), F.col("c")
    read = cells_.select(
        *by, "col_no", "col_name", "v", "c", numbers.to_number(v).alias("x"), dates.profile_date(v, now_ms).isNotNull().alias("d"),
        numbers.looks_numeric(v).alias("k"), v.rlike(numbers.SIGNS).alias("signed"), v.rlike("(?i)^https?://").alias("u"),
    )
    weigh = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    per = read.groupBy(*by, "col_no", "col_name").agg(
        weigh(v.isNotNull()).alias("filled"), F.count("v").alias("seen"), weigh(v.isNotNull() & F.col("d")).alias("dates"), weigh(F.col("k")).alias("numeric"),
        F.coalesce(F.bool_or("signed"), F.lit(False)).alias("signed"), weigh(F.col("u")).alias("urls"),
        F.min("x").alias("least"), F.max("x").alias("most"), numbers.total(F.col("x"), c).alias("total"), weigh(F.col("x").isNotNull()).alias("n_numbers"),
    )
    n, name = F.col("filled"), F.col("col_name")
    numeric = F.col("numeric") > NUMBER_SHARE * n
    kind = (
        F.when(n == 0, "empty")
        .when(name.rlike(ID_WORDS), "id")
        .when(F.col("dates") > DATE_SHARE * n, "date")
        .when(numeric & (F.col("signed") | (name.rlike(MONEY_WORDS) & ~name.rlike(NOT_MONEY))), "money")
        .when(numeric, "number")
        .when((F.col("urls") > URL_SHARE * n) | name.rlike(URL_WORDS), "url")
        .when((F.col("seen") > 1) & (F.col("seen") <= F.greatest(F.lit(2), n / 3)) & (F.col("seen") <= CATEGORY_MOST), "category")
        .when(name.rlike(TITLE_WORDS), "title")
        .otherwise("text")
    )
    measured = kind.isin("money", "number")
    only = lambda c: F.when(measured, c)
    return per.select(
        *by, "col_no", "col_name", "filled", F.least("seen", F.lit(DISTINCT_MOST)).alias("distinct"), kind.alias("type"),
        only(F.col("least")).alias("least"), only(F.col("most")).alias("most"), only(F.col("total")).alias("total"), only(F.col("total") / F.col("n_numbers")).alias("mean"),
    )


def tally(rows: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Trimmed, not blank, counted, most frequent first."""
    value = F.trim(F.col(col).cast("string"))
    counted = rows.select(value.alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(limit) if limit else counted


def rank_card(rows: DataFrame, col: str, top: int = 8) -> DataFrame:
    """The top values of a column with three values or more in four rows or more; else no row."""
    counted = tally(rows, col)
    enough = counted.agg(F.count(F.lit(1)).alias("_d"), F.sum("n").alias("_r")).where("_d >= 3 AND _r >= 4")
    return counted.join(F.broadcast(enough)).drop("_d", "_r").orderBy(F.desc("n"), "value").limit(top)  # one row


def money_card(rows: DataFrame, amount: Column, code: Column | None = None) -> DataFrame:
    """Total, greatest and number of positive amounts; the currency if there is only one. Whole amounts
    from 10,000 on are millionths."""
    read = rows.select(amount.alias("a"), (code if code is not None else F.lit(None).cast("string")).alias("c")).where("a > 0")
    one = read.agg(
        numbers.total(F.col("a")).alias("total"), F.max("a").alias("most"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("a") == F.floor("a")).alias("whole"),
        F.min("a").alias("least"), F.min("c").alias("c0"), F.max("c").alias("c1"),
    )
    micros = F.coalesce(F.col("whole") & (F.col("least") >= 10_000), F.lit(False))
    unit = F.when(micros, 1e6).otherwise(1.0)
    return one.select((F.col("total") / unit).alias("total"), (F.col("most") / unit).alias("most"), "n", micros.alias("micros"), F.when(F.col("c0") == F.col("c1"), F.col("c0")).alias("currency"))


def table_plan(profile: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a table: which card suits it and by which columns. rows(table_id, n_rows).

    series: a date and a measure; money: a money column; rank: a category; list: a title; else a
    count of rows. Of several columns of a kind the one that suits best: for measures one whose
    name has a unit, then the first."""
    unit = units.unit_of(F.col("col_name"))
    noise = F.col("col_name").rlike(NOISE)
    pick = lambda cond, order: F.min_by(F.when(cond, F.col("col_name")), F.when(cond, order))
    per = profile.groupBy("table_id").agg(
        pick(F.col("type") == "date", F.col("col_no")).alias("date_col"),
        pick((F.col("type") == "number") & ~noise, F.when(unit.isNotNull(), 0).otherwise(1000) + F.col("col_no")).alias("measure_col"),
        pick(F.col("type") == "money", F.col("col_no")).alias("money_col"),
        pick((F.col("type") == "category") & (F.col("distinct") >= 3), F.col("col_no")).alias("rank_col"),
        pick(F.col("type").isin("title", "text") & ~noise, F.when(F.col("type") == "title", 0).otherwise(1000) + F.col("col_no")).alias("label_col"),
    )
    kind = (
        F.when(F.col("money_col").isNotNull(), "money")
        .when(F.col("date_col").isNotNull() & F.col("measure_col").isNotNull() & (F.col("n_rows") >= 2), "series")
        .when(F.col("rank_col").isNotNull() & (F.col("n_rows") >= 4), "rank")
        .when(F.col("label_col").isNotNull(), "list")
        .otherwise("count")
    )
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in WEIGHTS.items()))
    score = weight + F.least(F.lit(30.0), 12 * F.log10(F.greatest(F.lit(1), F.col("n_rows"))))
    return per.join(rows, "table_id").withColumn("kind", kind).withColumn("score", score)


def reordered(columns: list[str]) -> list[str]:
    """Columns with those that only identify moved to the end, order kept otherwise."""
    import re

    only_id = [c for c in columns if re.search(ID_WORDS, c)]
    return [c for c in columns if c not in only_id] + only_id
