"""What is written into pictures is read out of them, and all else stays."""

import datetime as dt
import random
import struct

from pyspark.sql import functions as F

from keepsake.sources import formats, stamps
from test_sources import exif_jpeg


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


REST = segment(0xE0, b"JFIF\0\1\1") + segment(0xE1, b"other\0") + segment(0xDB, b"\1" * 64)
PICTURE = b"\xff\xda\0\2" + bytes(range(256)) * 3 + b"\xff\xe1\0\4ab\xff\xd9"


def test_what_is_written_is_read(spark):
    rnd = random.Random(2)
    plain = b"\xff\xd8" + REST + PICTURE
    own = b"\xff\xd8" + segment(0xE1, exif_jpeg()[6:]) + REST + segment(0xE1, stamps.xmp_block("old")) + PICTURE
    rows = [(i, bytearray(rnd.choice([plain, own])), dt.datetime(1990 + i, 1 + i % 12, 2, 3, 4, 5), rnd.uniform(-90, 90), rnd.uniform(-180, 180), rnd.choice(["a", "é <&> 日本 ]]>", "x" * 3000])) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, c binary, at timestamp_ntz, lat double, lon double, t string").withColumn("new", stamps.stamped("c", "at", "lat", "lon", "t"))
    for r in df.select("*", formats.exif("new").alias("e"), stamps.description("new").alias("d")).collect():
        assert r.e.taken == r.at.strftime("%Y:%m:%d %H:%M:%S") and abs(r.e.lat - r.lat) < 1e-7 and abs(r.e.lon - r.lon) < 1e-7 and r.d == r.t
        data = bytes(r.new)
        assert data.endswith(REST + PICTURE) and data.count(b"Exif\0\0") == 1 and data.count(stamps.XMP) == 1


def test_what_is_left_alone(spark):
    plain = b"\xff\xd8" + REST + PICTURE
    own = b"\xff\xd8" + segment(0xE1, stamps.xmp_block("old")) + REST + PICTURE
    at = dt.datetime(2024, 1, 2)
    cases = [(0, b"\x89PNG", at, 1.0, 1.0, "t"), (1, plain, None, None, 5.0, None), (2, None, at, None, None, "t"), (3, own, at, None, None, None), (4, plain, None, 91.0, 0.0, ""), (5, plain, at, 0.0, 0.0, "y" * 70_000), (6, b"\xff\xd8\xff", at, None, None, None)]
    df = spark.createDataFrame([(i, c and bytearray(c), *r) for i, c, *r in cases], "i int, c binary, at timestamp_ntz, lat double, lon double, t string").withColumn("new", stamps.stamped("c", "at", "lat", "lon", "t"))
    got = {r.i: (r.new and bytes(r.new), r.e.taken, r.d) for r in df.select("i", "new", formats.exif("new").alias("e"), stamps.description("new").alias("d")).collect()}
    assert got[0][0] == b"\x89PNG" and got[1][0] == plain == got[4][0] and got[2][0] is None
    assert got[3][1:] == ("2024:01:02 00:00:00", "old") and got[3][0].endswith(segment(0xE1, stamps.xmp_block("old")) + REST + PICTURE)
    assert got[5][1:] == ("2024:01:02 00:00:00", None) and got[6][0].startswith(b"\xff\xd8\xff\xe1") and got[6][0].endswith(b"\xff")
    assert spark.range(1).select(F.lit(None).cast("binary").alias("c")).select(stamps.description("c").alias("d")).first().d is None
