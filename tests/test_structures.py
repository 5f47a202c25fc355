"""Box trees, stacked sheets, shapes of documents, forms of sidecars, folders, work called off."""

import datetime as dt
import os
import random
import re
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from keepsake import jobs
from keepsake.operators import joins, structure
from keepsake.sources import boxes, formats, readers, walk
from test_sources import zipped


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name.encode() + body


def large(name, body):
    return struct.pack(">I", 1) + name.encode() + struct.pack(">Q", 16 + len(body)) + body


def heif(grid, version=0, wide=False):
    """A picture with EXIF data: one tile, or four in a grid."""
    full = lambda name, v, flags, *parts: box(name, struct.pack(">I", v << 24 | flags), *parts)
    items = [(1, b"grid" if grid else b"hvc1"), (9, b"Exif")] + ([(k, b"hvc1") for k in (2, 3, 4, 5)] if grid else [])
    infe = b"".join(full("infe", 2, 0, struct.pack(">HH", i, 0), kind, b"\0") for i, kind in items)
    entries = b"".join(struct.pack(">H", i) + (struct.pack(">H", 0) if version else b"") + struct.pack(">HHII", 0, 1, 1000 * i, 100 + i) for i, _ in items)
    iloc = full("iloc", version, 0, struct.pack(">BBH", 0x44, 0, len(items)), entries)
    ispe = lambda w, h: full("ispe", 0, 0, struct.pack(">II", w, h))
    ipco = box("ipco", ispe(4032, 3024), ispe(512, 512), box("hvcC", b"config"))
    own = [(1, [1] if grid else [1, 3])] + ([(k, [2, 3]) for k in (2, 3, 4, 5)] if grid else [])
    ipma = full("ipma", 0, int(wide), struct.pack(">I", len(own)), *(struct.pack(">HB", i, len(ps)) + b"".join(struct.pack(">H" if wide else ">B", p | (0x8000 if wide else 0x80)) for p in ps) for i, ps in own))
    iref = full("iref", 0, 0, box("dimg", struct.pack(">HH4H", 1, 4, 2, 3, 4, 5)))
    meta = full("meta", 0, 0, full("pitm", 0, 0, struct.pack(">H", 1)), full("iinf", 0, 0, struct.pack(">H", len(items)), infe), iloc, box("iprp", ipco, ipma), iref)
    head = box("ftyp", b"heic", b"\0\0\0\0mif1") + meta
    grid_at = 1000
    return head.ljust(grid_at, b"\0") + struct.pack(">BBBBHH", 0, 0, 1, 1, 1024, 900)


@pytest.mark.parametrize("version, wide", [(0, False), (1, True)])
def test_pictures(spark, version, wide):
    rows = [(0, heif(True, version, wide)), (1, heif(False, version, wide)), (2, b"no"), (3, None), (4, heif(True)[:300]), (5, box("ftyp", b"heic") + box("meta", b"\0\0\0\0"))]
    got = {r.i: r.h for r in spark.createDataFrame([(i, b and bytearray(b)) for i, b in rows], "i int, c binary").select("i", boxes.heif("c").alias("h")).collect()}
    grid, one = got[0], got[1]
    assert (grid.brand, grid.kind, grid.width, grid.height, grid.n_rows, grid.n_cols, grid.tile_width, grid.codec) == ("heic", "grid", 1024, 900, 2, 2, 512, "hvcC")
    assert [(t.offset, t.length) for t in grid.tiles] == [(1000 * k, 100 + k) for k in (2, 3, 4, 5)] and (grid.exif_offset, grid.exif_length) == (9000, 109)
    assert (one.kind, one.width, one.height, one.tile_width, len(one.tiles), one.readable) == ("single", 4032, 3024, 4032, 1, True)
    assert all(got[i].readable is False and got[i].error for i in (2, 4, 5)) and got[3].readable is None


def test_movie_dates_need_their_boxes(spark):
    mvhd = box("mvhd", struct.pack(">II", 0, 1_700_000_000 + boxes.EPOCH), b"\0" * 90)
    cases = {"plain": box("moov", mvhd), "late": box("ftyp", b"isom") + large("mdat", b"x" * 50) + box("moov", box("free"), mvhd), "loose": mvhd, "inside": box("mdat", box("moov", mvhd)), "letters": box("free", b"mvhd\0\0\0\0\xe0\0\0\0"), "old": box("moov", box("mvhd", struct.pack(">II", 0, 5))), "cut": box("moov", mvhd)[:24], "short": box("moov", mvhd)[:18], "zero": box("moov", mvhd).replace(struct.pack(">I", len(mvhd) + 8), b"\0\0\0\0", 1)}
    got = {r.n: r.at for r in spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "n string, c binary").select("n", boxes.movie_date(F.col("c")).alias("at")).collect()}
    at = dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got == {"plain": at, "late": at, "loose": None, "inside": None, "letters": None, "old": None, "cut": at, "short": None, "zero": at}


def stacked_plainly(rows):
    width = lambda r: max([i + 1 for i, c in enumerate(r) if c], default=0)
    runs = []
    for r in rows:
        if runs and runs[-1][0] == width(r):
            runs[-1][1].append(r)
        else:
            runs.append((width(r), [r]))
    titled = [i for i in range(len(runs) - 1) if len(runs[i][1]) == 1 and runs[i][0] < runs[i + 1][0] and len(runs[i + 1][1]) >= 2]
    named = lambda cells, w: [(cells[i] if cells and i < len(cells) and cells[i] else f"Column {i + 1}") for i in range(w)]
    if len(titled) < 2 or titled[0] != 0:
        w = max(map(width, rows))
        return [("", named(rows[0], w), [r[:w] for r in rows[1:]])] if w else []
    out = []
    for i in titled:
        w, body = runs[i + 1]
        out.append(([c for c in runs[i][1][0] if c] or [""])[-1].strip())
        out[-1] = (out[-1], named(body[0] if w >= 4 else None, w), [r[:w] for r in (body[1:] if w >= 4 else body)])
    return out


def test_stacked_sheets_as_plain(spark):
    rnd = random.Random(12)
    sheets = {}
    for k in range(60):
        rows = []
        for _ in range(rnd.randint(1, 5)):
            w = rnd.randint(0, 5)
            rows += [[rnd.choice(["", "t"])] * 0 + [""] * (w - 1) + ["T"] if w else [] for _ in range(rnd.choice([0, 1, 1]))]
            w += rnd.randint(0, 3)
            rows += [[rnd.choice(["", "a", "b"]) for _ in range(max(0, w - 1))] + ["z"] * (w > 0) + [""] * rnd.randint(0, 2) for _ in range(rnd.choice([1, 2, 3]))]
        sheets[f"s{k}"] = rows or [[]]
    flat = spark.createDataFrame([(p, i, r) for p, rows in sheets.items() for i, r in enumerate(rows)], "path string, line long, r array<string>").repartition(4)
    got = {}
    for r in sorted(formats.stacked_lines(flat).collect(), key=lambda r: (r.path, r.section, r.row_no)):
        got.setdefault(r.path, {}).setdefault(r.section, (r.title, r.columns, []))[2].append(r.r)
    for p, rows in sheets.items():
        want = [(t, c, b) for t, c, b in stacked_plainly(rows) if b]
        assert [got.get(p, {})[s] for s in sorted(got.get(p, {}))] == want, rows
    assert sum(len(v) > 1 for v in got.values()) > 5


def test_sheets_of_workbooks(spark):
    cell = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    sheet = "<worksheet><sheetData>" + "".join(f"<row>{''.join(cell(f'{chr(65 + j)}{i + 1}', t) for j, t in enumerate(r) if t)}</row>" for i, r in enumerate([["One"], ["a", "b"], ["c", "d"], ["Two"], ["e", "f"], ["g", "h"]])) + "</sheetData></worksheet>"
    book = zipped({"xl/worksheets/sheet1.xml": sheet})
    got = readers.sheet_cells(spark.createDataFrame([(s, "x/b.xlsx", bytearray(book)) for s in (1, 2)], "source_id int, path string, raw binary")).collect()
    assert sorted((r.source_id, r.title, r.row_no, r.col_name, r.value) for r in got) == sorted((s, t, i, f"Column {j + 1}", v) for s in (1, 2) for t, rows in (("One", ["ab", "cd"]), ("Two", ["ef", "gh"])) for i, row in enumerate(rows) for j, v in enumerate(row))


def test_shapes_of_documents(spark):
    docs = {'{"b": [{"x": {"y": 1}}, 2], "a\\"q": null}': '{"a\\"q":"null","b":{"_array":2,"of":"object"}}', "[]": '"array(0)"', "[[1, 2]]": '{"_array":1,"of":{"_array":2,"of":"number"}}', "3": '"number"', '"s"': '"string"', "{": None, "{}": "{}", '{"a": {"b": [1]}}': '{"a":{"b":"array(1)"}}'}
    df = spark.createDataFrame([(f"d/{i}.json", c) for i, c in enumerate(docs)], "path string, content string").repartition(3)
    assert sorted((r.shape for r in structure.json_shapes(df).collect()), key=str) == sorted(docs.values(), key=str)
    merged = structure.merged_schemas(spark.createDataFrame([("a.json", '{"x": 1}'), ("a.json", '{"x": "t", "y": [1]}'), ("a.json", "no")], "path string, content string")).first()
    assert (merged.schema, merged.files, merged.unreadable) == ("OBJECT<x: VARIANT, y: ARRAY<BIGINT>>", 2, 1)
    rows = spark.createDataFrame([("t1.csv", 0, ["a", "b"]), ("t1.csv", 1, ["1", "2"]), ("t2.csv", 0, ["a", "b"])], "path string, line long, r array<string>")
    assert [(r.path, r.columns, r.files, r.rows) for r in structure.table_shapes(rows).collect()] == [("t#.csv", ["a", "b"], 2, 1)]


def form_plainly(name, pool):
    folder, base = name.rpartition("/")[0], name.rpartition("/")[2]
    names = sorted(p.rpartition("/")[2] for p in pool if p.rpartition("/")[0] == folder and p.endswith(".json"))
    back = lambda form, n: (form, f"{folder}/{n}" if folder else n)
    counter = re.match(r"^(.*)(\(\d+\))(\.[^.]+)$", base)
    for form, n in (("exact", base + ".json"), ("basename", re.sub(r"\.[^.]+$", "", base) + ".json"), ("counter-moved", counter and counter[1] + counter[3] + counter[2] + ".json")):
        if n in names:
            return back(form, n)
    return next((back("supplemental", n) for n in names if n.startswith(base + ".") and len(n) > len(base)), (None, None))


def test_forms_of_sidecars_as_plain(spark):
    rnd = random.Random(3)
    bases = ["a.JPG", "a(1).JPG", "b.c.JPG", "a.JPG.x", "noext", "é(2).png"]
    tails = [".json", ".supplemental-metadata.json", ".supp.json", "(1).json", ".txt", ".s.json.json"]
    photos = [f"{d}{b}" for d in ("", "x/", "x/y/") for b in bases]
    pool = sorted({rnd.choice(["", "x/", "x/y/"]) + re.sub(r"\.[^.]+$", "", b) * (k := rnd.random() < 0.3) + b * (not k) + rnd.choice(tails) for b in bases * 12})
    got = {r.path: (r.form, r.sidecar) for r in joins.sidecar_forms(spark.createDataFrame([(p,) for p in photos], "path string"), spark.createDataFrame([(p,) for p in pool], "path string")).collect()}
    assert got == {p: form_plainly(p, pool) for p in photos} and len({f for f, _ in got.values()}) == 5


def test_folders_are_walked(spark, tmp_path, monkeypatch):
    for p in ("a.TXT", "x/b", "x/y/c.tar.gz", "x/y/.hidden", "z/w/v/d.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("12345")
    os.symlink(tmp_path / "nothing", tmp_path / "x/broken")
    os.symlink(tmp_path / "x", tmp_path / "z/loop")
    got = {(r.path, r.bytes, r.ext, r.category) for r in walk.walk(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.TXT", 5, ".txt", None), ("x/b", 5, "", None), ("x/y/c.tar.gz", 5, ".gz", None), ("x/y/.hidden", 5, "", None), ("z/w/v/d.jpg", 5, ".jpg", None), ("x/broken", 0, "", "error")}
    assert {r.path for r in walk.walk(spark, str(tmp_path), recurse=False).collect()} == {"a.TXT"}
    gone = walk.walk(spark, f"{tmp_path}/gone").collect()
    assert [(r.path, r.category) for r in gone] == [("", "error")] and gone[0].error
    assert all(r.mtime is not None for r in walk.walk(spark, str(tmp_path)).where("category IS NULL").collect())


def test_work_called_off_leaves_nothing(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    seen = []

    def run():
        try:
            jobs.write_all_or_nothing(spark.range(100).mapInArrow(slow, "id long"), f"file://{tmp_path}/out", "tag1")
        except jobs.Cancelled as c:
            seen.append(str(c))

    t = threading.Thread(target=run)
    t.start()
    for _ in range(60):
        time.sleep(0.5)
        jobs.cancel(spark, "tag1")
        if not t.is_alive():
            break
    t.join(40)
    assert seen == ["tag1"] and os.listdir(tmp_path) == []
    jobs.write_all_or_nothing(spark.range(5), f"file://{tmp_path}/out", "tag2")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="no luck"):
        jobs.write_all_or_nothing(spark.range(1).select(F.raise_error(F.lit("no luck"))), f"file://{tmp_path}/bad", "tag3")
    assert os.listdir(tmp_path) == ["out"]
