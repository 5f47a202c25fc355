"""Readers over archives that the tests write."""

import datetime as dt
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from keepsake.operators import duplicates
from keepsake.sources import aes, archives, boxes, detect, formats, readers
from keepsake.sources.readers import media_of


def zipped(files: dict, path=None) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 5, 6, 7, 8, 10)), data, zipfile.ZIP_DEFLATED)
    if path:
        path.write_bytes(held.getvalue())
    return held.getvalue()


def thread(name, n, first=0):
    said = [{"sender_name": "BjÃ¸rn", "timestamp_ms": 1_700_000_000_000 + (first + i) * 60_000, "content": "SmÃ¸rbrÃ¸d"} for i in range(n)]
    return json.dumps({"participants": [{"name": "BjÃ¸rn"}], "title": "", "messages": said})


def exif_jpeg():
    def ifd(entries, at):
        body, tail, where = b"", b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, n, data in entries:
            if len(data) > 4:
                body += struct.pack("<HHII", tag, kind, n, where + len(tail))
                tail += data
            else:
                body += struct.pack("<HHI", tag, kind, n) + data.ljust(4, b"\0")
        return struct.pack("<H", len(entries)) + body + b"\0" * 4 + tail

    deg = lambda d: struct.pack("<6I", d, 1, 30, 1, 0, 1)
    exif = ifd([(0x9003, 2, 20, b"2024:02:03 04:05:06\0")], 100)
    gps = ifd([(1, 2, 2, b"S\0"), (2, 5, 3, deg(10)), (3, 2, 2, b"E\0"), (4, 5, 3, deg(20))], 200)
    top = ifd([(0x8769, 4, 1, struct.pack("<I", 100)), (0x8825, 4, 1, struct.pack("<I", 200))], 8)
    tiff = (b"II*\0" + struct.pack("<I", 8) + top).ljust(100, b"\0") + exif
    tiff = tiff.ljust(200, b"\0") + gps
    return b"\xff\xd8\xff\xe1\x00\x00Exif\0\0" + tiff


@pytest.fixture(scope="module")
def files(spark):
    archives.register(spark)

    def read(folder, match=""):
        got = spark.read.format("archive_content").option("match", match).load(str(folder))
        return got.select("source_id", "path", "crc32", "size", F.col("content").cast("string").alias("content"), F.col("content").alias("raw"))

    return read


def test_directory_nested_and_tar(spark, tmp_path, files):
    import tarfile

    zipped({"a/b.txt": "hello", "inner.zip": zipped({"c.txt": "x", "deeper.zip": zipped({"d.txt": "y"})}), "bad.zip": b"no zip"}, tmp_path / "one.zip")
    with tarfile.open(tmp_path / "two.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("t/" + "long" * 40 + ".txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    got = spark.read.format("archive_dir").load(str(tmp_path)).collect()
    assert {(r.path[-8:], r.nested_in, r.skipped) for r in got} == {("a/b.txt"[-8:], None, None), ("c.txt", "inner.zip", None), ("d.txt", "inner.zip/deeper.zip", None), ("bad.zip", None, "unreadable"), ("long.txt", None, None)}
    content = files(tmp_path, r"\.txt$")
    assert sorted(r.content for r in content.collect()) == ["abc", "hello", "x", "y"]
    heads = spark.read.format("archive_content").option("match", "b.txt").option("head_bytes", "2").load(str(tmp_path)).collect()
    assert [bytes(r.content) for r in heads] == [b"he"]


def test_members_are_read_once_over_ranges(spark, tmp_path, files):
    zipped({f"f{i}.txt": str(i) for i in range(25)} | {"n.zip": zipped({f"g{i}.txt": str(100 + i) for i in range(9)})}, tmp_path / "many.zip")
    got = spark.read.format("archive_content").option("entries_per_partition", "7").option("match", "txt$").load(str(tmp_path))
    assert sorted(int(bytes(r.content)) for r in got.collect()) == [*range(25), *range(100, 109)]


def test_aes_members(spark, tmp_path):
    import hashlib
    import hmac
    import os
    import zlib

    password, salt, plain = b"open sesame", os.urandom(16), b"secret text " * 50
    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = packed.compress(plain) + packed.flush()
    key = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 66)
    counters = b"".join(i.to_bytes(16, "little") for i in range(1, len(data) // 16 + 2))
    stream = bytes(spark.range(1).select(F.aes_encrypt(F.lit(counters), F.lit(key[:32]), F.lit("ECB"), F.lit("PKCS"))).first()[0])
    sealed = bytes(a ^ b for a, b in zip(data, stream, strict=False))
    payload = salt + key[64:] + sealed + hmac.new(key[32:64], sealed, hashlib.sha1).digest()[:10]
    head = b"\x03\x08\x00"
    df = spark.createDataFrame([("a", head + payload, "aes"), ("b", b"clear", None), ("c", head + payload[:40] + bytes([payload[40] ^ 1]) + payload[41:], "aes"), ("d", None, "locked")], "path string, content binary, error string")
    got = {r.path: (r.content and bytes(r.content), r.error) for r in aes.unlock(df, "open sesame").collect()}
    assert got == {"a": (plain, None), "b": (b"clear", None), "c": (None, "damaged"), "d": (None, "locked")}
    assert {r.path: r.error for r in aes.unlock(df, "wrong").collect()}["a"] == "password"


def test_zipcrypto_is_refused_without_password(spark, tmp_path):
    raw = bytearray(zipped({"a.txt": "hello"}))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        raw[raw.index(mark) + at] |= 1
    (tmp_path / "locked.zip").write_bytes(bytes(raw))
    got = spark.read.format("archive_content").load(str(tmp_path)).collect()
    assert [(r.path, r.content, r.error) for r in got] == [("a.txt", None, "locked")]


def test_meta_parts_raw_and_merged(spark, tmp_path, files):
    """Two parts of one download that repeat a thread: as they are, and each entry once."""
    one = {f"messages/inbox/p{i}_ab1/message_1.json": thread(f"p{i}", 10, i * 100) for i in range(4)}
    zipped(one, tmp_path / "part1.zip")
    zipped({"messages/inbox/p0_ab1/message_1.json": one["messages/inbox/p0_ab1/message_1.json"], "messages/inbox/q_1/message_1.json": thread("q", 5, 900), "posts_1.json": json.dumps([{"timestamp": 1700000000, "title": "SmÃ¸r"}])}, tmp_path / "part2.zip")
    every = files(tmp_path)
    raw = readers.meta(every)["messages"]
    assert raw.count() == 55
    once = duplicates.first_of_parts(every.withColumn("key", F.lit("meta:x")), ["key", "crc32", "size"], ["source_id", "path"])
    lib = readers.meta(once)
    merged = lib["messages"].collect()
    assert len(merged) == 45 and {r.thread for r in merged} == {"p0", "p1", "p2", "p3", "q"}
    assert {(r.sender, r.text, r.type, r.direction) for r in merged} == {("Bjørn", "Smørbrød", "text", None)}
    assert [r.label for r in lib["events"].collect()] == ["Smør"]


def test_snapchat(spark, tmp_path, files):
    zipped(
        {
            "json/chat_history.json": json.dumps({"Sent Saved Chat History": [{"To": "bo", "From": "me", "Media Type": "TEXT", "Created": "2024-03-01 12:33:55 UTC", "Text": "hi"}], "bo": [{"From": "bo", "Media Type": "TEXT", "Created": "2024-03-01 12:34:55 UTC", "Content": "yo", "IsSender": "false"}]}),
            "json/memories_history.json": json.dumps({"Saved Media": [{"Date": "2024-01-02 03:04:05 UTC", "Media Type": "Image"}]}),
            "json/location_history.json": json.dumps({"Location History": [{"Time": "2024-01-02 03:04:05 UTC", "Latitude, Longitude": "59.91 ± 3, 10.75 ± 3"}]}),
            "json/friends.json": json.dumps({"Friends": [{"Username": "bo", "Display Name": "Bo"}]}),
        },
        tmp_path / "snap.zip",
    )
    lib = readers.snapchat(files(tmp_path))
    assert sorted((r.direction, r.sender, r.text, r.at) for r in lib["messages"].collect()) == [("received", "bo", "yo", dt.datetime(2024, 3, 1, 12, 34, 55)), ("sent", "me", "hi", dt.datetime(2024, 3, 1, 12, 33, 55))]
    assert [(r.kind, r.at) for r in lib["events"].collect()] == [("memory", dt.datetime(2024, 1, 2, 3, 4, 5))]
    assert [r.lat for r in lib["places"].collect()] == [59.91]
    assert {(r.col_name, r.value) for r in lib["cells"].collect()} == {("Username", "bo"), ("Display Name", "Bo")}


def test_google_media_dates_and_positions(spark, tmp_path, files):
    side = lambda t, lat: json.dumps({"photoTakenTime": {"timestamp": str(t)}, "geoData": {"latitude": lat, "longitude": lat}, "description": "d"})
    zipped({"Takeout/P/a.jpg": "x", "Takeout/P/IMG_20200102_030405.jpg": "x", "Takeout/P/c.png": "x"}, tmp_path / "takeout-1.zip")
    page = '<div class="outer-cell x"><div class="mdl-grid"><p class="mdl-typography--title">Search<br></p><div class="content-cell a">Searched for&nbsp;<a href="https://x.org/q">cats &amp; dogs</a><br>Mar 1, 2024, 3:04:05 PM UTC<br></div></div></div>'
    zipped({"Takeout/P/a.jpg.supplemental-metadata.json": side(1_700_000_000, 0.0), "Takeout/My Activity/Search/MyActivity.html": page, "Takeout/Records.json": json.dumps({"locations": [{"latitudeE7": 599100000, "longitudeE7": 107500000, "timestamp": "2024-01-02T03:04:05Z"}]})}, tmp_path / "takeout-2.zip")
    lib = readers.google(files(tmp_path))
    entries = spark.read.format("archive_dir").load(str(tmp_path))
    media = {r.name: r for r in media_of(entries, lib["sidecars"]).collect()}
    assert (media["a.jpg"].at, media["a.jpg"].at_source, media["a.jpg"].lat, media["a.jpg"].caption) == (dt.datetime(2023, 11, 14, 22, 13, 20), "sidecar", None, "d")
    assert (media["IMG_20200102_030405.jpg"].at, media["IMG_20200102_030405.jpg"].at_source) == (dt.datetime(2020, 1, 2, 3, 4, 5), "name")
    assert (media["c.png"].at, media["c.png"].at_source) == (dt.datetime(2024, 5, 6, 7, 8, 10), "archive")
    assert [(r.lat, r.lon) for r in lib["places"].collect()] == [(59.91, 10.75)]
    acts = formats.activity(files(tmp_path, "html$").select("path", "content")).collect()
    assert [(r.product, r.verb, r.href, r.at) for r in acts] == [("Search", "Searched for", "https://x.org/q", dt.datetime(2024, 3, 1, 15, 4, 5))]
    assert detect.detect_providers(entries.where("source_id = 0")).collect()[0].provider == "google"


def test_reddit_apple_samsung(spark, tmp_path, files):
    zipped({"posts.csv": "id,date,subreddit,title\n1,2024-01-02 03:04:05 UTC,pics,\"A, b\nc\"\n", "messages.csv": "thread_id,date,from,to,body\n7,2024-01-02 03:04:05 UTC,me,bo,hi\n"}, tmp_path / "r.zip")
    lib = readers.reddit(files(tmp_path))
    assert [(r.kind, r.label) for r in lib["events"].collect()] == [("post", "r/pics: A, b\nc")]
    assert [(r.thread, r.sender, r.text) for r in lib["messages"].collect()] == [("7", "me", "hi")]
    csv = "com.samsung.health.x,1\nSteps\ncreate_time,STEP_COUNT\n2024-01-01,5\n2024-01-02,6\n\nHeart\ntime,bpm\n1,60\n"
    cells = formats.tidy_columns(formats.sections(spark.createDataFrame([("s.csv", csv)], "path string, content string").select("path", formats.csv_rows("content").alias("rows"))))
    assert {(r.title, r.row_no, r.col_name, r.value) for r in cells.collect()} == {("Steps", 0, "Create time", "2024-01-01"), ("Steps", 0, "Step count", "5"), ("Steps", 1, "Create time", "2024-01-02"), ("Steps", 1, "Step count", "6"), ("Heart", 0, "Time", "1"), ("Heart", 0, "Bpm", "60")}


def test_events_health_fitness_and_mail_of_readers(spark):
    csv = "Date,Average heart rate (bpm),Max heart rate (bpm),End time,Note\n2024-01-01,60,90,1,x\n2024-01-02,,91,1,y\n"
    xml = '<Record type="HKQuantityTypeIdentifierStepCount" startDate="2024-01-01 10:00:00 +0100" endDate="2024-01-01 10:05:00 +0100" value="7"/>'
    rows = [
        (1, "T/Fit/2024-01-01.csv", "Start time,Weight\n10:00,70\n"), (1, "T/Fit/Activities/a.csv", "Date,Speed\n2024-01-01,9\n"), (2, "T/Fit/Daily Summaries.csv", csv), (2, "T/Fit/2024-01-01.csv", "Start time,Weight\n10:00,70\n"),
        (3, "a/apple_health_export/export.xml", xml * 2), (3, "Buys.csv", "Purchase time,Title\n2024-01-02,Song\n,Lost\n2024-01-03,\n"), (3, "short.csv", "Title,Date\nonly\n"), (4, "m.mbox", "From a\nFrom: B <b@x.org>\n\nx\nFrom b\nFrom: b@x.org\n"), (4, "none.mbox", None),
    ]
    files = spark.createDataFrame(rows, "source_id int, path string, content string")
    fit = {(r.table_id, r.row_no, r.col_name, r.value) for r in readers.fit_series(files).collect()}
    assert fit == {("T/Fit/2024-01-01.csv#Weight", 0, "Date", "10:00"), ("T/Fit/2024-01-01.csv#Weight", 0, "Value", "70"), ("T/Fit/Daily Summaries.csv#Average heart rate (bpm)", 0, "Date", "2024-01-01"), ("T/Fit/Daily Summaries.csv#Average heart rate (bpm)", 0, "Value", "60")}
    assert [(r.source_id, r.at, r.kind, r.label) for r in readers.apple(files)["events"].collect()] == [(3, dt.datetime(2024, 1, 2), "record", "Song")]
    assert {(r.title, r.col_name, r.value) for r in readers.health_series(files).collect()} == {("Step count", "Date", "2024-01-01"), ("Step count", "Value", "14.0")}
    # senders go by the name that they show
    assert sorted((r.row_no, r.col_name, r.value) for r in readers.mail_senders(files).collect()) == [(0, "Address", "b@x.org"), (0, "Messages", "1"), (0, "Sender", "B"), (1, "Address", "b@x.org"), (1, "Messages", "1"), (1, "Sender", "b@x.org")]
    occasions = spark.createDataFrame([(1, "com.samsung.shealth.exercise.20240101.csv", "com.samsung.shealth.exercise,1\nstart_time,x\n2024-01-02 03:04:05,1\nbad,2\n"), (1, "sleep.csv", "start_time,x\n2024-01-02,1\n")], "source_id int, path string, content string")
    assert [(r.at, r.label) for r in readers.samsung(occasions)["events"].collect()] == [(dt.datetime(2024, 1, 2, 3, 4, 5), "exercise")]


def test_media_read_their_headers(spark):
    entries = spark.createDataFrame([(0, "p/a.jpg", 5, 1, 0, 0), (0, "p/2020-01-02_x.jpg", 5, 1, 0, 0), (0, "p/m.mp4", 5, 1, 0, 0)], "source_id int, path string, size long, crc32 long, mod_date int, mod_time int")
    movie = b"\0\0\0\x20moov\0\0\0lmvhd\0\0\0\0" + struct.pack(">I", 1_700_000_000 + 2_082_844_800)
    contents = spark.createDataFrame([(0, "p/a.jpg", bytearray(exif_jpeg())), (0, "p/m.mp4", bytearray(movie))], "source_id int, path string, content binary")
    got = {r.path: (r.at, r.at_source, r.lat, r.lon) for r in media_of(entries, None, contents).collect()}
    assert got == {"p/a.jpg": (dt.datetime(2024, 2, 3, 4, 5, 6), "exif", -10.5, 20.5), "p/2020-01-02_x.jpg": (dt.datetime(2020, 1, 2, 12), "name", None, None), "p/m.mp4": (dt.datetime(2023, 11, 14, 22, 13, 20), "mvhd", None, None)}


def test_xlsx(spark):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x &amp; y</t></is></c></row><row r="2"><c r="B2"><v>3</v></c></row></sheetData></worksheet>'
    book = zipped({"xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    df = spark.createDataFrame([(bytearray(book),), (bytearray(b"no"),), (None,)], "c binary")
    assert [r[0] for r in df.select(formats.xlsx_rows("c")).collect()] == [[["name", "", "x & y"], ["", "3"]], None, None]


def test_contacts_calendar_mail(spark, tmp_path):
    card = "BEGIN:VCARD\r\nVERSION:3.0\r\nN:King;Ada;B;Dr.;\r\nitem1.EMAIL;type=HOME:a@x.org\r\nTEL:1\r\nTEL:2\r\nNOTE:one\\,\r\n  two\r\nEND:VCARD\r\nBEGIN:VCARD\r\nNOTE:nobody\r\nEND:VCARD\r\n"
    got = formats.contacts(spark.createDataFrame([("c.vcf", card)], "path string, content string")).collect()
    assert [(r.name, r.emails, r.phones, r.note) for r in got] == [("Dr. Ada B King", ["a@x.org"], ["1", "2"], "one, two")]
    ics = "BEGIN:VEVENT\nSUMMARY:Trip\nDTSTART;VALUE=DATE:20240301\nRRULE:FREQ=DAILY\nEND:VEVENT\nBEGIN:VTODO\nSUMMARY:Buy\nDUE:20240302T101500Z\nEND:VTODO\n"
    got = formats.calendar(spark.createDataFrame([("c.ics", ics)], "path string, content string")).collect()
    assert sorted((r.kind, r.title, r.at, r.all_day, r.repeats) for r in got) == [("event", "Trip", dt.datetime(2024, 3, 1), True, True), ("task", "Buy", dt.datetime(2024, 3, 2, 10, 15), False, False)]
    box = "From a@x Mon\nFrom: \"Ada L\" <A@x.org>\nSubject: =?utf-8?Q?H=C3=A9?=\n llo\nDate: Mon, 1 Jan 2024 10:11:12 +0000\n\nbody\n\nFrom b@x Tue\nFrom: b@x.org\nSubject: two\n\nFrom: not a header\n"
    (tmp_path / "m.mbox").write_text(box)
    got = formats.mails(formats.read_mbox(spark, str(tmp_path / "m.mbox"))).collect()
    assert sorted((r.name, r.address, r.subject, r.at) for r in got) == [("Ada L", "a@x.org", "Hé llo", dt.datetime(2024, 1, 1, 10, 11, 12)), ("b@x.org", "b@x.org", "two", None)]


def test_health_xml(spark, tmp_path):
    rec = lambda t, a, b, v: f'<Record type="HK{t}" startDate="{a} +0100" endDate="{b} +0100" value="{v}" sourceName="w"/>'
    day = "2024-01-01"
    xml = "<HealthData>" + rec("QuantityTypeIdentifierStepCount", f"{day} 10:00:00", f"{day} 10:05:00", 100) + rec("QuantityTypeIdentifierStepCount", f"{day} 11:00:00", f"{day} 11:05:00", 50) + rec("QuantityTypeIdentifierHeartRate", f"{day} 11:00:00", f"{day} 11:05:00", 60) + rec("CategoryTypeIdentifierSleepAnalysis", f"{day} 00:00:00", f"{day} 06:00:00", "HKCategoryValueSleepAnalysisAsleep") + rec("CategoryTypeIdentifierSleepAnalysis", f"{day} 00:00:00", f"{day} 08:00:00", "HKCategoryValueSleepAnalysisInBed") + "</HealthData>"
    (tmp_path / "export.xml").write_text(xml)
    from keepsake.operators.series import health_days

    got = {r.type: r.value for r in health_days(formats.health_records(spark, str(tmp_path / "export.xml")), ["StepCount"]).collect()}
    assert got == {"StepCount": 150.0, "HeartRate": 60.0, "Asleep": 6.0}


def test_binary_headers(spark):
    movie = b"\0\0\0\x0cftypisom" + b"\0\0\0\x74moov\0\0\0lmvhd\0\0\0\0" + struct.pack(">I", 1_700_000_000 + 2_082_844_800)
    df = spark.createDataFrame([(bytearray(exif_jpeg()),), (bytearray(b"\xff\xd8broken Exif\0\0II"),), (None,), (bytearray(movie),), (bytearray(b"RIFF1234WEBP"),), (bytearray(b"From x"),)], "h binary")
    assert [tuple(r[0]) for r in df.select(formats.exif("h")).collect()][:3] == [("2024:02:03 04:05:06", -10.5, 20.5), (None, None, None), (None, None, None)]
    assert [r[0] for r in df.select(formats.sniff(F.col("h"))).collect()] == ["jpg", None, None, None, "webp", "mbox"]
    assert [r[0] for r in df.select(boxes.movie_date(F.col("h"))).collect()][3] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_json_tables(spark):
    df = spark.createDataFrame([("a.json", '{"list": [{"x": 1, "y": {"z": 2}}, {"x": "q"}], "n": 3}'), ("b.json", '[{"k": true}]'), ("c.json", "broken"), ("d.json", "[1, 2]")], "path string, content string")
    assert {(r.table_id, r.row_no, r.col_name, r.value) for r in formats.json_tables(df).collect()} == {("a.json#list", 0, "x", "1"), ("a.json#list", 0, "y", '{"z":2}'), ("a.json#list", 1, "x", "q"), ("a.json#list", 1, "y", None), ("b.json", 0, "k", "true")}


def test_mhtml(spark):
    page = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>H=C3=A9llo</p>\r\n--B--\r\n"
    got = spark.createDataFrame([(bytearray(page),), (None,)], "c binary").select(formats.mhtml_page("c")).collect()
    assert got[0][0].strip() == "<p>Héllo</p>" and got[1][0] is None
