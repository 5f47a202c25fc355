"""Totals of very many amounts: small ones aren't lost beside great ones."""

from pyspark.sql import functions as F

from keepsake.functions import numbers
from keepsake.operators import cards as cd
from keepsake.operators import profile as pf

#: Fifty amounts so great that 0.0009 more doesn't change a double.
GREAT, SMALL = [10**13 + k for k in range(50)], 2000
WANT = (sum(GREAT) * 10_000 + 9 * SMALL) / 10_000


def amounts(spark):
    """Great amounts first, then small ones that differ in blanks before them."""
    texts = [(i, str(v)) for i, v in enumerate(GREAT)] + [(len(GREAT) + i, " " * i + "0.0009") for i in range(SMALL)]
    return spark.createDataFrame(texts, "row_no long, value string").coalesce(1)


def test_money_card_total_is_exact(spark):
    card = pf.money_card(amounts(spark), numbers.to_number(F.col("value"))).first()
    assert card.total == WANT and card.n == len(GREAT) + SMALL and not card.micros


def test_column_profile_total_is_exact(spark):
    long = amounts(spark).select(F.lit("t").alias("table_id"), F.lit(0).alias("col_no"), F.lit("price").alias("col_name"), "value")
    one = pf.column_profile(long.unionAll(long)).first()
    assert one.type == "money" and one.total == 2 * WANT


def test_cards_total_is_exact(spark):
    money = amounts(spark).select(F.lit("t").alias("table_id"), "row_no", F.lit(0).alias("col_no"), F.lit("price").alias("col_name"), "value")
    made, _ = cd.cards(money, spark.createDataFrame([("t", "Purchases")], "table_id string, title string"))
    assert [(r.kind, r.stat) for r in made.where("kind = 'money'").collect()] == [("money", WANT)]


def test_totals_leave_nothing_out(spark):
    """Beyond the exact range, with more places, weighed, and without any value."""
    rows = spark.createDataFrame([(1e20, 2), (1e-9, 3), (0.1, 10), (None, 5)], "x double, c long")
    weighed, none = rows.agg(numbers.total(F.col("x"), F.col("c")), numbers.total(F.when(F.col("c") > 99, F.col("x")))).first()
    assert weighed == 2e20 + 3e-9 + 1.0 and none is None
    assert abs(rows.where("x < 1").agg(numbers.total(F.col("x"), F.col("c"))).first()[0] - 1.000000003) < 1e-15
