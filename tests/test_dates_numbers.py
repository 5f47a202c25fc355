"""Scalar functions on literals, with the guards that matter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keepsake.functions import dates, names, numbers, paths, text, web


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


D = dt.datetime
NOW = 1_735_689_600_000


@pytest.mark.parametrize(
    "written, read",
    [
        ("1704067200", D(2024, 1, 1)), ("1704067200000", D(2024, 1, 1)), ("9999999999999", None), ("2024-03-01 12:33:55 UTC", D(2024, 3, 1, 12, 33, 55)),
        ("2024/03/01", D(2024, 3, 1)), ("2024-03-01T01:02:03.5Z", D(2024, 3, 1, 1, 2, 3, 500000)), ("05.03.2024", D(2024, 3, 5)), ("31/12/1999 x", D(1999, 12, 31)), ("32/12/1999", None),
        ("19951005", D(1995, 10, 5)), ("19951399", None), ("March 1, 2024", D(2024, 3, 1)), ("1 Mar 2024, 3:04:05 PM", D(2024, 3, 1, 15, 4, 5)), ("12 am on Jan 2, 2024", D(2024, 1, 2)), ("12345", None), ("", None), (None, None),
    ],
)
def test_profile_date(spark, written, read):
    assert col(spark, [written], lambda c: dates.profile_date(c, NOW)) == [read]


def test_dates_in_names(spark):
    got = col(spark, ["2024-10-31_abc.jpg", "2024-10-311.jpg", "IMG_20241031_142530.jpg", "PXL_20240229_010203123.jpg", "IMG-20240231-WA0001.jpg", "IMG-20240228-WA0001.jpg", "Screenshot_20241031-142530.png", "19891231_000000.jpg", "x.jpg"], lambda c: dates.date_from_name(c, F.lit("2025-01-01").cast("timestamp_ntz")))
    assert got == [D(2024, 10, 31, 12), None, D(2024, 10, 31, 14, 25, 30), D(2024, 2, 29, 1, 2, 3), None, D(2024, 2, 28, 12), D(2024, 10, 31, 14, 25, 30), None, None]


def test_other_dates(spark):
    assert col(spark, ["2024:02:03 04:05:06", "1989:02:03 04:05:06", "2024:13:03 04:05:06", None], dates.exif_date) == [D(2024, 2, 3, 4, 5, 6), None, None, None]
    assert col(spark, ["20240301T123000Z", "20240301", "2024"], lambda c: dates.ics_date(c)["at"]) == [D(2024, 3, 1, 12, 30), D(2024, 3, 1), None]
    assert col(spark, ["20240301T123000Z", "20240301"], lambda c: dates.ics_date(c)["all_day"]) == [False, True]
    assert col(spark, ["2024-03-01T12:33:55Z", "1704067200", "2024-03-01", "nonsense", ""], dates.parse_date) == [D(2024, 3, 1, 12, 33, 55), D(2024, 1, 1), D(2024, 3, 1), None, None]


def test_numbers(spark):
    got = col(spark, ["1,234.56", "1.234,56", "$12", "NOK 1 000", "-3", "12,5 EUR", "abc", "1.2.3", "", None, "."], numbers.to_number)
    assert got == [1234.56, 1234.56, 12.0, None, -3.0, 12.5, None, 1.2, None, None, None]
    assert col(spark, ["12", "x", None, "€5", "1,000 USD"], numbers.looks_numeric) == [True, False, False, True, True]
    assert col(spark, ["1,000 USD", "EUR 5", "7"], numbers.currency_code) == ["USD", "EUR", None]
    assert col(spark, [0.0, 12.34, 9999.0, 12345.0, 1_250_000.0], numbers.short_number, "double") == ["0", "12.3", "9,999", "12k", "1.3M"]
    assert col(spark, [140.0, 3.456, 12345.6], numbers.money, "double") == ["140", "3.46", "12,346"]
    assert col(spark, [10, 2048, 5 << 30], numbers.bytes_text, "long") == ["10 B", "2.0 KB", "5.0 GB"]


def test_names(spark):
    assert col(spark, ["SBR@CREATE_TIME", "com.samsung.health_pkgName", "ipAddress", "", "deviceuuid_id"], names.nice_column) == ["Create time", "Package name", "IP address", "", "Deviceuuid ID"]
    assert col(spark, ["DOB", "user_id"], names.nice_key) == ["Born", "User ID"]
    assert col(spark, ["Zoë (work) O'Neil", "A--B", None], names.person_key) == ["zo o neil", "a b", None]
    assert col(spark, ["r/pics", "/r/Pics", "", "pics"], names.subreddit) == ["r/pics", "r/Pics", None, "r/pics"]
    assert col(spark, ["ada lovelace king", " x"], names.initials) == ["AL", "X"]


def test_masks(spark):
    got = col(spark, ["messages/inbox/KevinF_9fj3/message_1.json", "Takeout/Heart Rate/Heart Rate.csv", "a/Egg hjelm.SPD", "IMG_20240101.JPG"], names.mask_path)
    assert got == ["messages/inbox/AaaaaA_9aa9/message_#.json", "Takeout/Heart Rate/Heart Rate.csv", "a/Aaa aaaa.spd", "IMG_####.jpg"]


def test_paths(spark):
    assert col(spark, ["takeout-20260731T101500Z-1-001.zip", "takeout-20260731T101500Z-1-002 (1).zip", "meta-x-2026-07-31-a.zip", "A_gk1_20260101_access.zip", "Other Data Part 1 of 5.zip", "name-2.zip", "name copy.zip"], lambda c: paths.export_key(c, F.lit("p"))) == [
        "p:20260731T101500Z", "p:20260731T101500Z", "p:meta-x-2026-07-31", "p:samsung-access", "p:other data", "p:name", "p:name"]
    assert col(spark, ["a/b.JPG", "x.MOV", "y.opus", "z"], paths.media_kind) == ["photo", "video", "audio", None]
    assert col(spark, ["a/b.jpg(2).json", "a/B.JPG.supplemental-metadata.json", "a/b.jpg.json"], paths.sidecar_keys) == [["a/b.jpg", "a/b(2).jpg"], ["a/b.jpg", None], ["a/b.jpg", None]]
    assert col(spark, [35, 0, None], lambda c: paths.hint(c, F.lit(36)), "long") == ["z-10", None, None]


def test_export_keys(spark):
    want = {
        "Name copy (1).zip": "name", "name copy 2.ZIP": "name", "name-2 copy-3.zip": "name", "a-1-2.zip": "a-1", "name-part-3.zip": "name", "name-12345.zip": "name-12345", "my_export (2)": "my_export",
        "Takeout_20260731t101500z-3-002": "20260731T101500Z", "instagram-me-2026-07-31-Ab.zip": "instagram-me-2026-07-31", "x_GK12_20260101_access (1).zip": "samsung-access",
        "iCloud Photos Part 10 of 12 (3).zip": "icloud photos", "gk.zip": "gk", "": "",
    }
    assert col(spark, list(want), lambda c: paths.export_key(c, F.lit("p"))) == ["p:" + w for w in want.values()]


def test_texts(spark):
    wrong = "SmÃ¸rbrÃ¸d"
    assert col(spark, [wrong, "Smørbrød", "plain", "日本", None, "Ã\n©"], text.repair) == ["Smørbrød", "Smørbrød", "plain", "日本", None, "Ã\n©"]
    assert col(spark, [wrong, "Smørbrød", None], text.is_mangled) == [True, False, False]
    assert col(spark, ['{"text":"a "},{"text":"b"}', "plain", None], text.comment_text) == ["a b", "plain", None]
    assert [tuple(x) for x in col(spark, ['"Ada L" <A@x.org>', "b@x.org"], text.address_name)] == [("Ada L", "a@x.org"), ("b@x.org", "b@x.org")]
    assert col(spark, ["=?utf-8?B?w6Ri?= x", "plain", None], text.decode_words) == ["äb x", "plain", None]
    assert col(spark, ['{"FILE":[{"path":"/a/b/Note one.spd"}]}', "x", "{bad"], text.find_named) == ["Note one", "x", ""]
    assert col(spark, ["[1,2,3,4,5]", '{"name":"N"}', '{"a":1,"b":2}'], text.nested_summary) == ["1, 2, 3, 2 more", "N", "a: 1, b: 2"]


def test_agents(spark):
    assert col(spark, ["x Edg/1 Chrome/2", "Firefox/3", "curl"], web.browser) == ["Edge", "Firefox", "Other"]
    assert col(spark, ["https://www.Example.org/a?q=secret", None, "not a url", "https://own.org/"], lambda c: web.referrer(c, "own.org")) == ["example.org", "direct", "direct", "direct"]
    assert col(spark, ["com.apple.appstored/1 iOS/17.1 model/iPhone14,2", "My phone", "odd/agent;"], web.agent_text) == ["App Store on iPhone (iPhone14,2), iOS 17.1", "My phone", "odd/agent;"]
