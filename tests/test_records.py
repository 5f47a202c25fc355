"""Records of members, broken and nested archives, and sources whose paths are the same."""

import datetime as dt
import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from keepsake.sources import archives, readers, records, sinks
from test_sources import files, zipped  # noqa: F401


def streamed(kind, data, headers=False):
    return [raw if raw is not None else fields for raw, fields in records.read(kind, io.BytesIO(data.encode() if isinstance(data, str) else data), headers)]


@pytest.mark.parametrize("piece", [7, 8, 11, 64, 1 << 18])
def test_records_don_t_depend_on_the_size_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(records, "PIECE", piece)
    box = "lost\nFrom a Mon\nSubject: é\n\nbody\n>From b\nFrom: x\nFrom b Tue\r\n\r\nFrom \nFrom c\n"
    assert streamed("mbox", box) == ["From a Mon\nSubject: é\n\nbody\n>From b\nFrom: x\n", "From b Tue\r\n\r\nFrom \n", "From c\n"]
    assert streamed("mbox", box, True) == ["From a Mon\nSubject: é\n", "From b Tue\r\n", "From c\n"]
    xml = '<A><R n="1"/><Rs x="2"/><R n="a > b" m=\'"\'>t</R><R\n n="3"/><R></A><R n="cut'
    assert streamed("xml:R", xml) == ['n="1"', 'n="a > b" m=\'"\'', 'n="3"', ""]
    table = 'a,b\r\n"x\r\ny, ""q""",2\n\n , \n3\n\n,\n'
    assert streamed("csv", table) == [["a", "b"], ['x\ny, "q"', "2"], [], [" ", " "], ["3"]]
    assert streamed("mbox", "") == streamed("csv", "") == streamed("xml:R", "") == []
    assert streamed("mbox", b"From \xff\n") == ["From �\n"]


def test_an_element_without_end_is_given_up(monkeypatch):
    monkeypatch.setattr(records, "PIECE", 16)
    monkeypatch.setattr(records, "LONGEST", 50)
    assert streamed("xml:R", "<R " + "x" * 200 + '<R n="1"/>') == ['n="1"']


def test_a_mailbox_larger_than_memory(tmp_path):
    """240 MB of mail come out of a zip file, one inside another at that, in 60 MB at most."""
    mail = "From a@x Mon\nFrom: A <a@x.org>\nSubject: s\n\n" + ("z" * 79 + "\n") * 12_500
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("Mail/all.mbox", "w") as f:
        for _ in range(240):
            f.write(mail.encode())
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.write(tmp_path / "one.zip", "inner.zip")
    for name, headers, size in (("one.zip", "false", len(mail)), ("two.zip", "true", len(mail.split("\n\n")[0]) + 1)):
        reader = archives.RecordReader({"path": str(tmp_path / name), "records": "mbox", "headers": headers})
        tracemalloc.start()
        got = [(r[3], len(r[4]), r[6]) for p in reader.partitions() for r in reader.read(p)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == [(i, size, None) for i in range(240)] and peak < 60 << 20


def test_streamed_members_come_out_again(spark, tmp_path):
    archives.register(spark)
    lines = spark.range(5000).select(F.format_string("f%d.csv", F.col("id") % 3).alias("target"), F.col("id").alias("place"), F.format_string('%d,"a\nb %d"\n', "id", "id").alias("line"))
    told = sinks.write_streams(lines.repartition(7), str(tmp_path / "z")).collect()
    assert sum(r.entries for r in told) == 3 and sum(r.bytes for r in told) == sum(len(f'{i},"a\nb {i}"\n') for i in range(5000))
    got = spark.read.format("archive_records").options(records="csv", match="csv$").load(str(tmp_path / "z")).orderBy("path", "record").collect()
    assert [(r.path, r.fields) for r in got] == [(f"f{k}.csv", [str(i), f"a\nb {i}"]) for k in range(3) for i in range(k, 5000, 3)]


def test_broken_archives_are_rows(spark, tmp_path):
    import tarfile

    archives.register(spark)
    good = zipped({f"g{i}.txt": "x" * 50 for i in range(9)}, tmp_path / "good.zip")
    (tmp_path / "bad.zip").write_bytes(b"no zip at all")
    (tmp_path / "cut.zip").write_bytes(good[: len(good) // 2])
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "bad.tgz").write_bytes(b"\x1f\x8b not gzip")
    with tarfile.open(tmp_path / "nest.tar", "w") as t:
        for name, data in (("in.zip", zipped({"deep.txt": "d"})), ("flat.txt", b"f")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    listed = spark.read.format("archive_dir").load(str(tmp_path)).collect()
    assert {r.archive for r in listed if r.path is None} == {"bad.zip", "cut.zip", "empty.zip", "bad.tgz"} and all(r.skipped.startswith("unreadable") for r in listed if r.path is None)
    assert {(r.path, r.nested_in) for r in listed if r.archive == "nest.tar"} == {("deep.txt", "in.zip"), ("flat.txt", None)}
    for options in ({}, {"entries_per_partition": "2"}, {"bytes_per_partition": "100"}):
        got = spark.read.format("archive_content").options(match="txt$", **options).load(str(tmp_path)).collect()
        assert sorted(r.path for r in got if r.path) == sorted([f"g{i}.txt" for i in range(9)] + ["deep.txt", "flat.txt"])
        assert sum(r.path is None and r.error.startswith("unreadable") for r in got) == 4


def test_guards_are_options(spark, tmp_path):
    archives.register(spark)
    zipped({f"n{i:02}.zip": zipped({f"m{i:02}.txt": str(i)}) for i in range(45)} | {"d1.zip": zipped({"d2.zip": zipped({"d3.zip": zipped({"d4.zip": zipped({"x.txt": "x"})})})})}, tmp_path / "many.zip")

    def seen(**options):
        rows = spark.read.format("archive_dir").options(**options).load(str(tmp_path)).collect()
        content = spark.read.format("archive_content").options(match="txt$", bytes_per_partition="500", **options).load(str(tmp_path)).collect()
        assert sorted(r.path for r in content) == sorted(r.path for r in rows if r.path.endswith("txt"))
        return sum(r.path.startswith("m") for r in rows), sum(r.skipped == "budget" for r in rows), any(r.path == "x.txt" for r in rows)

    assert seen() == (40, 6, False) and seen(max_nested="46") == (45, 0, False) and seen(max_nested="46", max_depth="9") == (45, 0, True) and seen(max_nested_each="1")[0] == 0


def test_google_tells_mails_videos_and_an_empty_timeline(spark):
    page = '<div class="outer-cell"><div class="content-cell a">Viewed&nbsp;x<br>Jan 2, 2024, 3:04:05 AM UTC<br></div></div>'
    spot = '{"locations": [{"latitudeE7": 1, "longitudeE7": 2, "timestamp": "2024-01-02T03:04:05Z"}]}'
    history = '[{"title": "Watched A", "time": "2024-01-02T03:04:05Z"}, {"time": "2024-01-03T03:04:05Z"}, {"title": "undated"}]'
    box = "From a\nFrom: =?utf-8?Q?J=C3=B6?= <j@x.org>\nSubject: hi\nDate: Mon, 1 Jan 2024 10:11:12 +0000\n\nFrom: no\nFrom b\nFrom: other@x.org\nDate: Tue, 2 Jan 2024 10:11:12 +0000\n\nFrom c\nSubject: undated\n"
    rows = [(s, p, c) for s in (1, 2) for p, c in (("T/My Activity/a.html", page), ("T/YouTube/watch-history.json", history), ("T/Search/search-history.json", history), ("T/Mail/a.mbox", box), ("T/Timeline/Settings.json", "{}"))] + [(2, "T/Location History/Records.json", spot), (3, "T/a.csv", "x\n1\n")]
    lib = readers.google(spark.createDataFrame(rows, "source_id int, path string, content string"))
    events = sorted((r.source_id, r.kind, r.label or "", r.at.day) for r in lib["events"].collect())
    one = [("record", "", 3), ("email", "(no subject)", 2), ("email", "hi", 1), ("record", "Viewed x", 2), ("record", "Watched A", 2), ("video", "Watched A", 2), ("video", "Watched a video", 3)]
    assert events == sorted((s, *e) for s in (1, 2) for e in one)
    assert [(r.source_id, r.code) for r in lib["notes"].collect()] == [(1, "timeline_empty")]
    senders = sorted((r.source_id, r.row_no, r.value) for r in lib["cells"].where("title LIKE 'Mail%' AND col_name IN ('Sender', 'Messages')").collect())
    assert senders == sorted((s, n, v) for s in (1, 2) for n, v in ((0, "Unknown"), (0, "1"), (1, "Jö"), (1, "1"), (2, "other@x.org"), (2, "1")))


def test_first_of_columns_without_an_average(spark):
    rows = [(s, "T/Fit/Daily Summaries.csv", "Date,Max speed (m/s),Min speed (m/s),Average calories,Max calories\n2024-01-01,5,1,70,90\n") for s in (1, 2)]
    got = readers.fit_series(spark.createDataFrame(rows, "source_id int, path string, content string")).where("col_name = 'Value'").collect()
    assert sorted((r.source_id, r.title, r.value) for r in got) == [(s, t, v) for s in (1, 2) for t, v in (("Average calories", "70"), ("Max speed (m/s)", "5"))]


def test_generic_has_tables_and_no_events(spark):
    lib = readers.generic(spark.createDataFrame([(1, "a.csv", "date,title\n2024-01-01,x\n"), (2, "a.csv", "k\n1\n2\n")], "source_id int, path string, content string"))
    assert set(lib) == {"cells"} and sorted((r.source_id, r.col_name, r.value) for r in lib["cells"].collect()) == [(1, "date", "2024-01-01"), (1, "title", "x"), (2, "k", "1"), (2, "k", "2")]


def test_sidecars_of_another_export_with_equal_paths(spark):
    entries = spark.createDataFrame([(0, "p/a.jpg", 5, 1, 0, 0, "A"), (1, "p/a.jpg", 5, 1, 0, 0, "B"), (2, "p/a.jpg", 5, 1, 0, 0, "C")], "source_id int, path string, size long, crc32 long, mod_date int, mod_time int, export_key string")
    side = spark.createDataFrame([(k, "p/a.jpg.json", dt.datetime(y, 1, 1), 1.0, 1.0, k) for k, y in (("A", 2001), ("B", 2002))], "export_key string, path string, taken timestamp_ntz, lat double, lon double, caption string")
    assert sorted((r.source_id, r.at and r.at.year, r.caption) for r in readers.media_of(entries, side).collect())[:2] == [(0, 2001, "A"), (1, 2002, "B")]
