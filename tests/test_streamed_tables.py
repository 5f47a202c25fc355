"""Tables, lists and pages of any size are read as they stream by, like contents that are there whole."""

import io

import pytest
from pyspark.sql import functions as F

from keepsake.queries import services
from keepsake.sources import archives, formats, readers, records, sinks

CSV = 'com.samsung.health,1\n\nSteps \nday,n\n1,"a\nb"\n2\n\n\nd,e,f\n3,4,5\n  \nlone\n\n6,7\n8,9\n\n\n'
JSON = '{"n": 12, "a": [{"b": 1, "a": "x]\\""}, null, {"c": [1, {"d": 2}]}], "o": {"q": [{"z": 1}]}, "e": [], "t": [{"k": true}]}'


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_records_over_pieces(monkeypatch, piece):
    monkeypatch.setattr(records, "PIECE", piece)
    got = lambda kind, s: list(records.read(kind, io.BytesIO(s.encode())))
    assert got("json", JSON) == [('{"b": 1, "a": "x]\\""}', ["a", "a", "b"]), ("null", ["a", "a", "b"]), ('{"c": [1, {"d": 2}]}', ["a", "a", "b"]), ('{"k": true}', ["t", "k"])]
    assert got("json", ' [{"a": 1}\n, {}] ') == [('{"a": 1}', ["", "a"]), ("{}", ["", "a"])] and got("json", "17") == []
    assert got("after:<b", "x<b1<<b>2<") == [("1<", None), (">2<", None)] and got("after:<b", "nothing") == []
    with pytest.raises(ValueError):
        got("json", '{"a": [{"b": 1}, {"b"')


def test_streams_are_read_like_contents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_BYTES", 40)
    files = {"a.csv": CSV, "b.json": JSON, "c.csv": "k\n1\n"}
    lines = [(p, i, c) for p, s in files.items() for i, c in enumerate(s)]
    sinks.write_streams(spark.createDataFrame(lines, "target string, place long, line string").repartition(3), str(tmp_path / "z"), whole="csv|json")
    archives.register(spark)
    read = lambda kind, match: archives.one_export(spark.read.format("archive_records").options(records=kind, match=match).load(str(tmp_path / "z")))
    nothing = spark.createDataFrame([], "source_id int, path string, content string")
    streamed = readers.apple(nothing, None, read("tables", r"\.csv$"), read("json", r"\.json$"))["cells"]
    whole = readers.apple(spark.createDataFrame([(0, p, s) for p, s in files.items()], "source_id int, path string, content string"))["cells"]
    rank = F.dense_rank().over(formats.Window.partitionBy("table_id").orderBy("row_no"))
    want = lambda cells: sorted(map(str, cells.withColumn("row_no", rank).collect()))
    assert want(streamed) == want(whole) and len(want(whole)) > 12


def test_files_of_equal_paths_are_not_put_together(spark, data):
    assert "collect_list" not in services.equal_paths(spark, data)._jdf.queryExecution().optimizedPlan().toString()
