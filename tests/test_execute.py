"""Plans carried out and taken back; files and zips written; topics told."""

import zipfile

from pyspark.sql import functions as F

from keepsake.operators import topics
from keepsake.plans import execute, rules
from keepsake.sources import sinks


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_scan_plan_execute_undo(spark, tmp_path):
    files = {"a/IMG_1.PNG": "shot", "b/IMG_1.PNG": "shot two", "c/film.mp4": "x" * 50, "c/keep.mp4": "k", "d/x.tmp": "", "e/old.txt": "old"}
    for n, t in files.items():
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(t)
    plan = [rules.parse_rule(s) for s in ("keep files named keep.*", "move screenshots to Shots", "delete junk", "delete videos")]
    scanned = rules.scan_categories(spark.createDataFrame([(n, len(t)) for n, t in files.items()], "path string, size long")).withColumns({"duplicate": F.lit(False), "modified": F.lit(None).cast("timestamp_ntz")})
    acting = execute.targets(rules.apply_rules(scanned, plan), [r.destination for r in plan])
    root = f"file://{tmp_path}"
    assert {r.status for r in execute.execute(acting, root).collect()} == {"planned"} and tree(tmp_path) == files
    done = execute.execute(acting, root, commit=True)
    assert tree(tmp_path) == {"Shots/IMG_1.PNG": "shot", "Shots/IMG_1 (2).PNG": "shot two", "trash/film.mp4": "x" * 50, "c/keep.mp4": "k", "trash/x.tmp": "", "e/old.txt": "old"}
    assert {r.status for r in execute.execute(acting, root, commit=True).collect()} == {"already there"}
    (tmp_path / "d/x.tmp").write_text("in the way")
    back = {r.target: r.status for r in execute.undo(done, root, commit=True).collect()}
    assert back == {"a/IMG_1.PNG": "moved", "b/IMG_1.PNG": "moved", "c/film.mp4": "moved", "d/x.tmp": "occupied"}
    assert tree(tmp_path)["a/IMG_1.PNG"] == "shot"


def test_targets_are_told_apart(spark):
    names = ["x/a.jpg", "y/a.jpg", "z/a (2).jpg", "w/A.JPG", "v/a (4).jpg", "u/a (4).jpg", "t/a (3)", "s/a (03).jpg", "r/.b", "q/.b", "p/a (2) (2).jpg", "o/a (2).jpg", "n/c", "m/C", "l/a (99999999999).jpg"]
    got = {r.path: r.target for r in execute.targets(spark.createDataFrame([(n, 0, "move") for n in names], "path string, rule int, action string").repartition(4), ["out"]).collect()}
    assert len({t.lower() for t in got.values()}) == len(names)
    firsts = {}
    for n in sorted(names):  # by hand: the first by path keeps its name, others get the next number that no name has
        firsts.setdefault(n.split("/")[1].lower(), []).append(n)
    for key, paths in firsts.items():
        stem, dot, ext = key.rpartition(".") if key.rfind(".") > 0 else (key, "", "")
        free = (k for k in range(2, 99) if f"{stem} ({k}){dot}{ext}" not in firsts)
        assert [got[p].lower() for p in paths] == [f"out/{key}"] + [f"out/{stem} ({k}){dot}{ext}" for k, _ in zip(free, paths[1:])]


def test_transfer_keeps_the_original_in_the_trash(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    acting = spark.createDataFrame([("a.txt", "transfer", "Far/a.txt"), ("gone.txt", "move", "Far/gone.txt")], "path string, action string, target string")
    got = {r.path: r.status for r in execute.execute(acting, f"file://{tmp_path}", commit=True).collect()}
    assert got == {"a.txt": "moved", "gone.txt": "missing"}
    assert sorted(tree(tmp_path).values()) == ["hello", "hello"] and (tmp_path / "Far/a.txt").exists() and not (tmp_path / "a.txt").exists()


def test_files_and_zips(spark, tmp_path):
    placed = spark.createDataFrame([(f"y/{i}.txt", bytearray(f"t{i}".encode())) for i in range(20)] + [("bad", None)], "target string, content binary").repartition(3)
    got = sinks.write_files(placed, f"file://{tmp_path}/out").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"written": 20, "failed": 1}
    assert tree(tmp_path / "out") == {f"y/{i}.txt": f"t{i}" for i in range(20)}
    zips = sinks.write_zips(placed.where("content IS NOT NULL"), f"file://{tmp_path}/zips").collect()
    held = {n: z.read(n).decode() for r in zips for z in [zipfile.ZipFile(tmp_path / "zips" / r.file)] for n in z.namelist()}
    assert held == {f"y/{i}.txt": f"t{i}" for i in range(20)} and sum(r.entries for r in zips) == 20


def test_library_round_trip(spark, tmp_path):
    places = spark.createDataFrame([(1, None, 1.5, 2.5)], "source_id INT, at TIMESTAMP_NTZ, lat DOUBLE, lon DOUBLE")
    sinks.save_library({"places": places}, str(tmp_path / "lib"), 3)
    ddl = {"places": "source_id INT, at TIMESTAMP_NTZ, lat DOUBLE, lon DOUBLE"}
    assert sinks.load_library(spark, str(tmp_path / "lib"), ddl, 3)["places"].collect() == places.collect()
    assert sinks.load_library(spark, str(tmp_path / "lib"), ddl, 4)["places"].count() == 0


def test_topics(spark):
    t = [("1", "apple", "Sign-in log", ["Time", "IP Address"]), ("2", "apple", "Purchases", ["User Agent", "Date"]), ("3", "s", "Heart rate", ["x"]), ("4", "s", "misc", ["step count"]), ("5", "z", "misc", ["step count"]), ("6", "g", "c", ["Comment Text", "Video ID"]), ("7", "apple", "devices", ["Device ID"])]
    got = {r.table_id: (r.logins, r.health, r.comments) for r in topics.topics(spark.createDataFrame(t, "table_id string, source string, name string, columns array<string>")).collect()}
    assert got == {"1": (True, None, False), "2": (False, None, False), "3": (False, "heart", False), "4": (False, "steps", False), "5": (False, None, False), "6": (False, None, True), "7": (False, None, False)}


def test_key_values(spark):
    df = spark.createDataFrame([("a", '{"x": 1, "y": {"z": "q", "l": [1]}}'), ("b", "no")], "path string, content string")
    assert sorted(tuple(r) for r in topics.key_values(df).collect()) == [("a", "x", "1"), ("a", "y.l", "[1]"), ("a", "y.z", "q")]
