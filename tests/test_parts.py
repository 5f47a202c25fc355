"""A member that is larger than a part of an export goes on in the next one."""

from pyspark.sql import functions as F

from keepsake.sources import archives, formats, readers, sinks


def test_a_member_over_several_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_BYTES", 4000)
    archives.register(spark)
    lines = spark.range(900).select(F.format_string("b%d.mbox", F.col("id") % 2).alias("target"), F.col("id").alias("place"), F.format_string("From a%d\nSubject: s\n\nbody\n", "id").alias("line"))
    told = sinks.write_streams(lines.repartition(5), str(tmp_path / "z")).collect()
    assert len(told) > 4 and max(r.bytes for r in told) < 8000 and sum(r.bytes for r in told) == sum(len(f"From a{i}\nSubject: s\n\nbody\n") for i in range(900))
    got = archives.one_export(spark.read.format("archive_records").options(records="mbox", headers="true").load(str(tmp_path / "z"))).orderBy("path", "record").collect()
    assert [(r.source_id, r.path, r.raw.split("\n")[0]) for r in got] == [(0, f"b{k}.mbox", f"From a{i}") for k in range(2) for i in range(k, 900, 2)]


def test_headers_are_worked_out_once(spark):
    """A filter on the date doesn't read the headers again for every part of it."""
    raw = spark.createDataFrame([(0, "a", 0, "From x\r\nDate: Mon, 1 Jan 2024 10:11:12 +0000\r\nSubject: a\r\n b\r\n\r\nDate: no\r\n"), (0, "a", 1, None)], "source_id int, path string, record long, raw string")
    events = readers.mail_events(formats.mails(raw, "source_id", "path", "record"))
    assert events._jdf.queryExecution().optimizedPlan().toString().count("^Date:") <= 4
    assert [(r.label, str(r.at)) for r in events.collect()] == [("a b", "2024-01-01 10:11:12")]
