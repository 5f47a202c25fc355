"""Contents are handed on in bounded pieces."""

import zipfile

from pyspark.sql import functions as F

from keepsake.sources import archives, sinks


def test_contents_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_BYTES", 5000)
    monkeypatch.setattr(archives, "BATCH_ROWS", 7)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(50):
            z.writestr(f"{i}.txt", b"x" * (2000 if i < 9 else i))
    reader = archives.ContentReader({"path": str(tmp_path)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) == 7 and max(sum(map(len, b.column(6).to_pylist())) for b in batches) == 6000
    archives.register(spark)
    got = spark.read.format("archive_content").load(str(tmp_path)).select("path", "size", F.length("content").alias("n"), "error").collect()
    assert sorted((r.path, r.size, r.n, r.error) for r in got) == sorted((f"{i}.txt", *[2000 if i < 9 else i] * 2, None) for i in range(50))



def test_zip_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ZIP_MEMBERS", 40)
    monkeypatch.setattr(sinks, "ZIP_BYTES", 3000)
    placed = spark.range(100).coalesce(1).select(F.format_string("%d.txt", "id").alias("target"), F.encode(F.repeat(F.lit("x"), F.when(F.col("id") < 5, 1500).otherwise(1)), "UTF-8").alias("content"))
    told = sinks.write_zips(placed, str(tmp_path / "z")).orderBy("file").collect()
    assert [(r.file, r.entries, r.bytes) for r in told] == [("export-00000-001.zip", 2, 3000), ("export-00000-002.zip", 40, 1539), ("export-00000-003.zip", 40, 40), ("export-00000-004.zip", 16, 16), ("export-00000.zip", 2, 3000)]
    archives.register(spark)
    got = spark.read.format("archive_content").load(str(tmp_path / "z")).collect()
    assert sorted((r.path, r.size) for r in got) == sorted((f"{i}.txt", 1500 if i < 5 else 1) for i in range(100))
