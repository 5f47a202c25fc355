"""Operators on small tables, against naive answers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from keepsake.functions import names
from keepsake.operators import duplicates as dp
from keepsake.operators import graph, joins, merge, people, quality, series, timeline
from keepsake.plans import buckets, layouts, rules


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_roots_chains_rings_and_missing_parents(spark):
    edges = [(i, i - 1) for i in range(1, 300)] + [(0, None), (1000, 1001), (1001, 1002), (1002, 1000), (1003, 1001), (2000, 99999)]
    got = {r.node: (r.root, r.depth) for r in graph.roots(spark.createDataFrame(edges, "node long, parent long")).collect()}
    assert all(got[i] == (0, i) for i in range(300))
    assert {got[i][0] for i in (1000, 1001, 1002, 1003)} == {1000}
    assert got[2000] == (2000, 0)


def test_seed_groups_are_those_of_the_greedy_loop(spark):
    rnd = random.Random(5)
    links = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(140)})
    near, used, want = set(links), set(), {}
    for i in sorted({x for p in links for x in p}):
        if i in used:
            continue
        for j in [i, *(k for k in range(i + 1, 60) if (i, k) in near and k not in used)]:
            want[j] = i
            used.add(j)
    assert dict(rows(graph.seed_groups(spark.createDataFrame(links, "a long, b long")), "node", "seed")) == want


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(rows(graph.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 161)}


def test_near_pairs_by_bands_are_all_pairs(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(63) for _ in range(12)]
    prints = [(i, base[i % 12] ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 8))), rnd.uniform(0, 60), rnd.choice([5.0, 30.0])) for i in range(150)]
    want = sorted((a[0], b[0], (a[1] ^ b[1]).bit_count()) for a in prints for b in prints if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= 6 and min(a[3], b[3]) >= 12 and abs(a[2] - b[2]) <= 26)
    assert want
    table = spark.createDataFrame(prints, "id long, bits long, mean double, sd double")
    assert rows(dp.near_pairs(table, "id"), "a", "b", "distance") == want
    assert rows(dp.near_pairs(table, "id", most_probes=0), "a", "b", "distance") == want
    far = sorted((a[0], b[0]) for a in prints for b in prints if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= 16 and abs(a[2] - b[2]) <= 26)
    assert rows(dp.near_pairs(table, "id", 16, 0.0, width=63), "a", "b") == far


def test_parts_first_occurrence_is_idempotent(spark):
    e = spark.createDataFrame([("k", 1, 5, 1), ("k", 1, 5, 2), ("k", None, 5, 3), ("j", 1, 5, 4), ("k", 1, 6, 5)], "key string, crc int, size int, ord int")
    once = dp.first_of_parts(e, ["key", "crc", "size"], ["ord"])
    assert rows(once, "ord") == [(1,), (3,), (4,), (5,)] == rows(dp.first_of_parts(once, ["key", "crc", "size"], ["ord"]), "ord")


def test_busiest_run(spark):
    naive = {h: 0 for h in range(24)}
    points = [dt.datetime(2024, 1, 1, h) for h in [22, 23, 0, 1] * 10 + [12] * 3]
    for p in points:
        naive[p.hour] += 1
    best = max(((24 * sum(naive[(s + k) % 24] for k in range(n)) - n * len(points), -n, -s) for n in range(3, 9) for s in range(24)))
    got = series.busiest_run(spark.createDataFrame([(p,) for p in points], "at timestamp_ntz")).collect()[0]
    assert (got.hours, got.start, got.quiet_hour) == (-best[1], -best[2], 12)
    assert series.busiest_run(spark.createDataFrame([(points[0],)] * 23, "at timestamp_ntz")).count() == 0


def test_time_buckets(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in range(100)] + [("b", 5, 1.0)] * 70 + [("c", 1, 2.0), ("c", 9, 4.0)], "series string, t long, v double")
    got = series.time_buckets(df, 10).collect()
    a = sorted((r.bucket, r.n, r.lo, r.hi) for r in got if r.series == "a")
    assert [x[1] for x in a] == [10] * 10 and a[0][2:] == (0.0, 9.0)
    assert [(r.t, r.n, r.v) for r in got if r.series == "b"] == [(5, 70, 1.0)]
    assert sorted((r.t, r.v) for r in got if r.series == "c") == [(1, 2.0), (9, 4.0)]


def test_trend_needs_eight_points(spark):
    df = spark.createDataFrame([("a", i, 10.0 + i) for i in range(12)] + [("b", i, 1.0) for i in range(7)] + [("z", i, float(i > 3)) for i in range(9)], "series string, t int, v double")
    got = {r.series: r for r in series.trend(df).collect()}
    assert set(got) == {"a"} and got["a"].start == 10.5 and got["a"].end == 20.5 and not got["a"].steady


def test_running_total_over_many_parts(spark):
    rnd = random.Random(1)
    data = [(i, rnd.randint(0, 9)) for i in range(500)]
    want, total = [], 0
    for i, v in data:
        total += v
        want.append((i, total))
    assert rows(merge.running_total(spark.createDataFrame(data, "i int, v int").repartition(7), ["i"], "v", parts=6), "i", "running") == want


def test_pages_keep_repeats_only_alone(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    got = merge.merge_pages({"t": one, "u (1)": one, "u (2)": one, "v": one.select("x")})
    assert {k: v.count() for k, v in got.items()} == {"t": 3, "u": 2, "v": 3}


def test_nearby_is_the_band_join(spark):
    rnd = random.Random(3)
    data = [(i, rnd.randint(0, 3), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 200_000))) for i in range(120)] + [(999, 1, None)]
    want = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and abs(a[2] - b[2]) <= dt.timedelta(hours=3))
    assert rows(joins.nearby(spark.createDataFrame(data, "id int, u int, at timestamp_ntz"), "id", by=["u"]), "a", "b") == want


def test_sidecars_prefer_their_own_key(spark):
    media = spark.createDataFrame([("a/b.jpg",), ("a/b(2).jpg",), ("a/c.jpg",)], "path string")
    side = spark.createDataFrame([("a/b.jpg.json", "one"), ("a/b.jpg(2).json", "two"), ("a/B.JPG.supplemental-metadata.json", "three"), ("a/z.jpg.json", "none")], "path string, d string")
    got = dict((p, d) for p, d, _ in rows(joins.with_sidecars(media, side, ["d"]), "path", "d", "paired"))
    assert got["a/b(2).jpg"] == "two" and got["a/b.jpg"] in ("one", "three") and got["a/c.jpg"] is None
    assert rows(joins.orphan_sidecars(media, side), "path") == [("a/z.jpg.json",)]


def test_overlays(spark):
    m = spark.createDataFrame([("m/1-main.jpg",), ("m/1-overlay.png",), ("m/2.mp4",), ("m/2-overlay.png",), ("m/2-main.jpg",), ("m/3-overlay.png",), ("m/4-main.jpg",)], "path string")
    got = {(r.base, r.overlay) for r in joins.with_overlays(m).collect()}
    assert got == {("m/1-main.jpg", "m/1-overlay.png"), ("m/2.mp4", "m/2-overlay.png"), ("m/2-main.jpg", None), (None, "m/3-overlay.png"), ("m/4-main.jpg", None)}


def test_owner_is_deduced_from_two_party_threads_not_from_groups(spark):
    said = [("t1", "Bo", "Bo", None), ("t1", "Bo", "Me", None)] + [(f"g{i}", "Group", x, None) for i in range(12) for x in ("Friend", "Me", "Bo")]
    votes = {r.name: r for r in people.owner_votes(spark.createDataFrame(said, "thread string, title string, sender string, direction string")).collect()}
    assert votes["me"].owner and not votes["friend"].owner and votes["friend"].in_groups == 12 and not votes["bo"].owner


def test_reconcile_adds_up(spark):
    e = spark.createDataFrame([("a", 9), ("b", 9), ("c", 1), ("x/.DS_Store", 9), ("d", 9)], "path string, size long")
    used = spark.createDataFrame([("a", "media"), ("a", "sidecar"), ("b", "sidecar"), ("nowhere", "media"), ("d", "odd")], "path string, bucket string")
    got = quality.reconcile(e, used)
    assert rows(got, "path", "bucket") == [("a", "media"), ("b", "sidecar"), ("c", "empty"), ("d", "unread"), ("x/.DS_Store", "noise")]
    assert sum(r.n for r in quality.bucket_totals(got).collect()) == 5


def test_scope_leaves_undated_rows_out_only_with_a_bound(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 5, 23)), ("a", None), ("b", dt.datetime(2024, 1, 6))], "source string, at timestamp_ntz")
    assert timeline.scope(df).count() == 3
    assert rows(timeline.scope(df, end="2024-01-05"), "source") == [("a",)]
    assert timeline.scope(df, sources_off=["a"], start="2024-01-01", at=None).count() == 1


def test_rules_from_sentences():
    ok = rules.parse_rule
    assert ok("never touch photos newer than 2 weeks") == rules.Rule("never touch photos newer than 2 weeks", "keep", {"categories": ["camera_photo"], "newer_than_days": 14})
    assert ok("move videos larger than 2 gb to D:/Films.").destination == "D:/Films" and ok("move videos larger than 2 gb to X").match["larger_than_mb"] == 2048
    assert ok("delete files named IMG_*.PNG smaller than 1 mb").match == {"name_glob": "IMG_*.PNG", "smaller_than_mb": 1.0}
    assert ok("Transfer dupes older than 1.5 years to 'NAS'").match == {"duplicates_only": True, "older_than_days": 548} and ok("transfer dupes to 'NAS'").destination == "NAS"
    assert ok("remove chat videos bigger than 3 mb").match == {"categories": ["chat_media"], "larger_than_mb": 3.0} and ok("move the videos").__class__ is type(None)
    assert ok("delete live photo pairs").match == {"categories": ["live_photo_pair"]}
    assert ok("delete everything") is None and ok("photos") is None and ok("delete photos like a*b") is None and ok("move photos") is None
    assert rules.problems([ok("delete junk"), rules.Rule("x", "burn", {}), rules.Rule("y", "move", {"size": 1})])[0].startswith("rule 2")


def test_rules_apply_keep_first(spark):
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    f = spark.createDataFrame([("a/IMG_1.PNG", "screenshot", False, 100, None), ("a/b.mp4", "camera_video", True, 9 << 20, dt.datetime(2020, 1, 1)), ("c", "other", True, 5, dt.datetime(2024, 5, 30))], "path string, category string, duplicate boolean, size long, modified timestamp_ntz")
    plan = [rules.parse_rule("delete duplicates"), rules.parse_rule("keep videos"), rules.parse_rule("move 'img_?.png' to Shots"), rules.parse_rule("delete screenshots older than 1 day")]
    got = rules.apply_rules(f, plan, now)
    assert rows(got, "path", "rule", "action") == [("a/IMG_1.PNG", 2, "move"), ("a/b.mp4", 1, "keep"), ("c", 0, "delete")]
    assert {r.action: (r.n, r.bytes) for r in rules.plan_summary(got).collect()}["transfer"] == (0, 0)


def test_scan_categories(spark):
    names_ = {"x.tmp": "junk", "2023-05-01_a-overlay.png": "snapchat_overlay", "2023-05-01_a-main.mp4": "snapchat_memory", "01234567-89ab-cdef-0123-456789abcdef.mp4": "chat_media", "IMG_1.PNG": "screenshot", "Skjermbilde 1.jpg": "screenshot", "IMG_2.MOV": "live_photo_pair", "IMG_2.HEIC": "camera_photo", "IMG_3.mov": "camera_video", "z.mp4": "camera_video", "q.txt": "other"}
    f = spark.createDataFrame([(f"d/{n}", 5) for n in names_] + [("d/empty.jpg", 0)], "path string, size int")
    assert dict(rows(rules.scan_categories(f), "path", "category")) == {f"d/{n}": c for n, c in names_.items()} | {"d/empty.jpg": "junk"}


def test_bucket_plans(spark):
    raw = buckets.first_object('Sure! {"buckets": [{"name": "P", "match": {"field": "name", "any": ["cat"]}}, {"name": "bad", "match": {"field": "x"}}, {"action": "drop", "match": {"field": "kind", "any": ["video"]}}]} ok')
    plan = buckets.checked(raw)
    assert [(b.name, b.action, b.rest) for b in plan] == [("P", "keep", False), ("Bucket", "drop", False), ("Everything else", "keep", True)]
    m = spark.createDataFrame([("CAT.jpg", None, None, "photo"), ("x", "", "s", "video"), (None, None, None, None)], "name string, caption string, source string, kind string")
    assert [r.bucket for r in buckets.sort_media(m, plan).collect()] == ["P", "Bucket", "Everything else"]


def test_layouts_number_equal_names(spark):
    m = spark.createDataFrame([("a/x.jpg", dt.datetime(2024, 3, 1), "S:1", "photo"), ("b/X.jpg", dt.datetime(2024, 9, 1), "S:1", "photo"), ("c/y", None, None, "video")], "path string, at timestamp_ntz, source string, kind string")
    assert rows(layouts.placed(m, "year"), "path", "target") == [("a/x.jpg", "2024/x.jpg"), ("b/X.jpg", "2024/X (2).jpg"), ("c/y", "undated/y")]
    assert rows(layouts.placed(m, "source-year", dated=True), "target") == [("S-1/2024/2024-03-01_x.jpg",), ("S-1/2024/2024-09-01_X.jpg",), ("unknown/undated/y",)]
    assert rows(m.select(layouts.folder("type").alias("f")), "f") == [("Photos/2024",), ("Photos/2024",), ("Videos/undated",)]


def test_person_aliases_follow_chains(spark):
    m = spark.createDataFrame([("Ada",), ("A. Lovelace",), ("Countess",)], "sender string")
    alias = spark.createDataFrame([("a lovelace", "ada"), ("countess", "a lovelace"), ("ada", None)], "node string, parent string")
    assert {r.person for r in people.with_person(m, aliases=alias).collect()} == {"ada"}
    assert names.PERSONAL


def test_empty_tables(spark):
    none = spark.createDataFrame([], "source string, thread string, at timestamp_ntz, kind string, title string")
    items = timeline.timeline(none, none, none, none)
    assert items.count() == 0 and timeline.stats(items).collect()[0]["items"] == 0
    assert series.hour_histogram(none).count() == 24 and series.busiest_run(none).count() == 0
    assert graph.seed_groups(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.roots(spark.createDataFrame([], "node long, parent long")).count() == 0
    assert quality.dates_trusted(none, "at").collect()[0].trusted is False
