"""What all services have in common after their readers: sheets, pages, overlays, dates, in one chain."""

import datetime as dt

from keepsake.operators import merge
from keepsake.sources import archives, readers
from test_sources import exif_jpeg, files, zipped  # noqa: F401


def test_the_chain(spark, tmp_path, files):  # noqa: F811
    archives.register(spark)
    cell = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    book = zipped({"xl/worksheets/sheet1.xml": f"<w><row>{cell('A1', 'k')}</row><row>{cell('A2', 'v')}</row></w>"})
    zipped(
        {
            "memories/1-main.jpg": exif_jpeg(), "memories/1-overlay.png": "o", "memories/2020-03-04_b.jpg": "x", "Pictures/1-overlay.png": "not one of memories",
            "t/items.csv": "a,b\n1,x\n2,y\n", "t/items (1).csv": "a,b\n2,y\n3,z\n", "t/items (2).csv": "a,c\n2,y\n", "s/book.xlsx": book,
        },
        tmp_path / "e.zip",
    )
    read, entries = files(tmp_path), spark.read.format("archive_dir").load(str(tmp_path))
    lib = readers.finish(readers.generic(read), entries, read.select("source_id", "path", read.raw.alias("content")), read.select("source_id", "path", "raw"))
    media = {r.path: (r.at, r.at_source, r.overlay) for r in lib["media"].collect()}
    archive = (dt.datetime(2024, 5, 6, 7, 8, 10), "archive", None)
    assert media == {"memories/1-main.jpg": (dt.datetime(2024, 2, 3, 4, 5, 6), "exif", "memories/1-overlay.png"), "memories/2020-03-04_b.jpg": (dt.datetime(2020, 3, 4, 12), "name", None), "Pictures/1-overlay.png": archive}
    tables = {}
    for r in sorted(lib["cells"].collect(), key=lambda r: (r.table_id, r.row_no, r.col_no)):
        tables.setdefault(r.table_id, []).append(r.value)
    assert tables == {"t/items.csv#1": ["1", "x", "2", "y", "3", "z"], "t/items (2).csv#1": ["2", "y"], "s/book.xlsx#0": ["v"]}


def test_merged_pages_know_null_from_empty_and_cells_from_their_places(spark):
    rows = [("p.csv", 0, ["a", None]), ("p.csv", 1, ["a", ""]), ("p (1).csv", 0, ["", "a"]), ("p (1).csv", 1, ["a", None]), ("p (1).csv", 2, [None, None]), ("p (10).csv", 0, [None, None]), ("q (1).csv", 0, ["a", "b"]), ("q (1).csv", 1, ["a", "b"])]
    cells = spark.createDataFrame([(s, t, None, n, j, f"c{j}", v) for s in (1, None) for t, n, r in rows for j, v in enumerate(r)], "source_id int, table_id string, title string, row_no long, col_no int, col_name string, value string")
    got = {}
    for r in sorted(merge.merge_cells(cells).where("source_id = 1").collect(), key=lambda r: (r.table_id, r.row_no, r.col_no)):
        got.setdefault((r.table_id, r.row_no), []).append(r.value)
    assert got == {("p.csv", 0): ["a", None], ("p.csv", 1): ["a", ""], ("p.csv", merge.PAGE): ["", "a"], ("p.csv", merge.PAGE + 2): [None, None], ("q (1).csv", 0): ["a", "b"], ("q (1).csv", 1): ["a", "b"]}
