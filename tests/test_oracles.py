"""Every query that SQL can express gives the rows of its SQL."""

import pytest

from compare import of_duck, of_spark

from keepsake.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, data, name):
    columns, rows = of_spark(QUERIES[name](spark, data))
    want_columns, want = of_duck(duck, ORACLES[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).columns
