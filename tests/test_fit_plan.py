"""Fitness files are read without sorting their contents or rows, but for the numbers at the end."""

from keepsake.sources import readers


def test_contents_are_not_sorted(spark):
    rows = [
        (1, "a/Fit/Daily Summaries.csv", "Date,Max speed,Average speed\n2024-01-01,5,3\n2024-01-02,6,4\n"), (1, "a/Fit/2024-01-01.csv", "Start time,Weight\n10:00,70\n"),
        (2, "a/Fit/2024-01-02.csv", "Start time,Weight\n10:00,71\n"), (2, "a/Fit/2024-01-01.csv", "Start time,Weight\n11:00,70\n12:00,x\n"), (2, "none.csv", "Date,Weight\n2024-01-01,1\n"),
    ]
    cells = readers.fit_series(spark.createDataFrame(rows, "source_id int, path string, content string"))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert before.count("+- Window") == 1 and before.count("ShuffledHashJoin [source_id") + before.count("BroadcastHashJoin [source_id") >= 2
    got = sorted((r.source_id, r.table_id, r.row_no, r.value) for r in cells.where("col_name = 'Value'").collect())
    assert got == [(1, "a/Fit/Daily Summaries.csv#Average speed", 0, "3"), (1, "a/Fit/Daily Summaries.csv#Average speed", 1, "4"), (2, "a/Fit/2024-01-01.csv#Weight", 0, "70"), (2, "a/Fit/2024-01-01.csv#Weight", 1, "71")]
