"""Readers of services: files(source_id, path, content) of an archive as tables of one library.

Each gives a dict of DataFrames with the columns of keepsake.schema; all are plans over the same
files, nothing is read before it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import dates, names, paths, text
from keepsake.operators.joins import with_overlays, with_sidecars
from keepsake.operators.merge import merge_cells
from keepsake.operators.series import health_days

from . import boxes, formats

Library = dict[str, DataFrame]


def field(record: Column, *wanted: str) -> Column:
    """The value of a map's first key that is one of these, case and punctuation aside."""
    plain = [w.lower().replace(" ", "").replace("_", "") for w in wanted]
    found = F.filter(F.map_entries(record), lambda e: F.regexp_replace(F.lower(e["key"]), "[^a-z]", "").isin(plain))
    return F.get(found, F.lit(0))["value"]


def _like(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("path").rlike(pattern))


def _records(files: DataFrame, pattern: str) -> DataFrame:
    """(source_id, path, key, r): objects in lists under the keys of a JSON file, values as strings."""
    lists = _like(files, pattern).select("source_id", "path", F.explode(F.from_json("content", "map<string,array<map<string,string>>>")).alias("key", "list"))
    return lists.select("source_id", "path", "key", F.explode("list").alias("r"))


def csv_cells(files: DataFrame, pattern: str = r"(?i)\.csv$") -> DataFrame:
    return formats.section_cells(_csv_sections(files, pattern))


def _csv_sections(files: DataFrame, pattern: str = r"(?i)\.csv$") -> DataFrame:
    """(source_id, path, table_id, title, row_no, header, r) of CSV files; files of several sources may share a path."""
    return formats.section_rows(_like(files, pattern).select("source_id", "path", formats.csv_rows("content").alias("rows")))


def _json_tables(files: DataFrame) -> DataFrame:
    return formats.json_tables(files.select("source_id", "path", "content"))


def _as_cells(rows: DataFrame, table_id: Column, title: Column, row_no: Column, values: dict[str, Column]) -> DataFrame:
    """rows(source_id, ...) as cells."""
    cell = F.array(*(F.struct(F.lit(i).alias("col_no"), F.lit(n).alias("col_name"), c.cast("string").alias("value")) for i, (n, c) in enumerate(values.items())))
    return rows.select("source_id", table_id.alias("table_id"), title.alias("title"), row_no.cast("long").alias("row_no"), F.inline(cell))


def rows_of(files: DataFrame, pattern: str) -> DataFrame:
    """(source_id, path, row_no, r): a CSV file's rows as maps from column name to value."""
    read = _like(files, pattern).select("source_id", "path", formats.csv_rows("content").alias("rows"))
    header = F.get("rows", F.lit(0))
    body = read.select("source_id", "path", header.alias("h"), F.posexplode(F.slice("rows", 2, 2**31 - 2)).alias("row_no", "v"))
    unique = F.transform("h", lambda c, i: F.when(F.array_position(F.col("h"), c) == i + 1, c).otherwise(F.concat(c, F.lit("#"), i.cast("string"))))
    padded = F.transform("h", lambda c, i: F.get("v", i))
    return body.select("source_id", "path", "row_no", F.map_from_arrays(unique, padded).alias("r"))


def snapchat(files: DataFrame) -> Library:
    """Chats, snaps, memories, locations; friends and account as tables. A chat's direction is told by the
    list that it is in, or by its own flag."""
    chat = _records(files, r"(?i)chat_history[^/]*\.json$")
    mine = F.lower(field(F.col("r"), "IsSender"))
    direction = F.when(mine == "true", "sent").when(mine == "false", "received").when(F.lower("key").contains("sent"), "sent").when(F.lower("key").contains("received"), "received")
    listed = F.lower("key").rlike("history|sent|received")
    messages = chat.select(
        "source_id", F.coalesce(field(F.col("r"), "Conversation Title"), F.when(~listed, F.col("key")), field(F.col("r"), "From", "To")).alias("thread"), field(F.col("r"), "From").alias("sender"), direction.alias("direction"),
        field(F.col("r"), "Content", "Text").alias("text"), F.lower(field(F.col("r"), "Media Type")).alias("type"), dates.parse_date(field(F.col("r"), "Created")).alias("at"),
    )
    memories = _records(files, r"(?i)memories_history[^/]*\.json$").select("source_id", dates.parse_date(field(F.col("r"), "Date")).alias("at"), F.lit("memory").alias("kind"), field(F.col("r"), "Media Type").alias("label"))
    snaps = _records(files, r"(?i)snap_history[^/]*\.json$").select("source_id", dates.parse_date(field(F.col("r"), "Created")).alias("at"), F.lit("snap").alias("kind"), field(F.col("r"), "Media Type").alias("label"))
    spot = _records(files, r"(?i)location_history[^/]*\.json$")
    pair = F.coalesce(field(F.col("r"), "Latitude Longitude", "Location"), F.concat_ws(",", field(F.col("r"), "Latitude"), field(F.col("r"), "Longitude")))
    two = r"(-?\d+(?:\.\d+)?)[^\d-]+(-?\d+(?:\.\d+)?)"
    places = spot.select("source_id", dates.parse_date(field(F.col("r"), "Time", "Date")).alias("at"), F.regexp_extract(pair, two, 1).try_cast("double").alias("lat"), F.regexp_extract(pair, two, 2).try_cast("double").alias("lon")).where("lat IS NOT NULL")
    tables = _json_tables(_like(files, r"(?i)(friends|account)[^/]*\.json$"))
    return {"messages": messages, "events": memories.unionByName(snaps), "places": places, "cells": tables}


_THREAD = "title string, participants array<struct<name:string>>, messages array<struct<sender_name:string,timestamp_ms:bigint,content:string,photos:array<string>,videos:array<string>,audio_files:array<string>,share:string,sticker:string>>"


def meta(files: DataFrame) -> Library:
    """Threads as messages, posts as events, other lists as tables; encodings repaired throughout. What a
    message is goes by its attachments; who sent it isn't said, so direction is null."""
    doc = _like(files, r"(?i)messages/.*/message_\d+\.json$").select("source_id", "path", F.from_json("content", _THREAD).alias("d"))
    folder = F.regexp_replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), r"_[A-Za-z0-9-]+$", "")
    m = doc.select("source_id", F.coalesce(F.nullif(F.trim(text.repair(F.col("d.title"))), F.lit("")), folder).alias("thread"), F.explode("d.messages").alias("m"))
    kind = F.when(F.size("m.photos") > 0, "photo").when(F.size("m.videos") > 0, "video").when(F.size("m.audio_files") > 0, "audio").when(F.col("m.sticker").isNotNull(), "sticker").when(F.col("m.share").isNotNull(), "link").otherwise("text")
    messages = m.select(
        "source_id", "thread", text.repair(F.col("m.sender_name")).alias("sender"), F.lit(None).cast("string").alias("direction"), text.repair(F.col("m.content")).alias("text"), kind.alias("type"), dates.from_epoch_ms(F.col("m.timestamp_ms")).alias("at")
    )
    post = _like(files, r"(?i)posts?_\d+\.json$").select("source_id", F.explode(F.from_json("content", "array<struct<timestamp:bigint,title:string,data:array<struct<post:string>>>>")).alias("p"))
    label = F.coalesce(F.col("p.title"), F.get("p.data", F.lit(0))["post"])
    events = post.select("source_id", dates.from_epoch_ms(F.col("p.timestamp") * 1000).alias("at"), F.lit("post").alias("kind"), text.repair(label).alias("label"))
    rest = files.where(F.col("path").rlike(r"(?i)\.json$") & ~F.col("path").rlike(r"(?i)message_\d+\.json$|posts?_\d+\.json$"))
    cells = _json_tables(rest).withColumn("value", text.repair(F.col("value")))
    return {"messages": messages, "events": events, "cells": cells}


#: Folders and file of a history of places; what stands for a title or a subject that isn't there.
TIMELINE = r"(?i)(^|/)(location history|timeline)( \(timeline\))?/"
UNTITLED, NO_SUBJECT, NOBODY = "Watched a video", "(no subject)", "Unknown"


def google(files: DataFrame, records: DataFrame | None = None) -> Library:
    """Photo sidecars, location records, watch and search history, activity pages, mailboxes, tables. A position
    of 0, 0 is none. Sidecars are joined with photos after the union of all parts. A folder for a
    history of places without any is a note.

    records(source_id, path, record, raw), as archive_records gives them with `headers`, are the
    mails; without them those of the files' contents."""
    side = _like(files, r"(?i)\.(jpe?g|png|heic|gif|webp|mp4|mov)[^/]*\.json$").select("source_id", "path", F.from_json("content", "photoTakenTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double>, description string").alias("d"))
    known = (F.col("d.geoData.latitude") != 0) | (F.col("d.geoData.longitude") != 0)
    sidecars = side.select(
        "source_id", "path", dates.from_epoch_ms(F.col("d.photoTakenTime.timestamp").try_cast("long") * 1000).alias("taken"), F.when(known, F.col("d.geoData.latitude")).alias("lat"),
        F.when(known, F.col("d.geoData.longitude")).alias("lon"), F.nullif("d.description", F.lit("")).alias("caption"),
    )
    spot = _like(files, r"(?i)records\.json$").select("source_id", F.explode(F.from_json("content", "locations array<struct<latitudeE7:bigint,longitudeE7:bigint,timestamp:string,timestampMs:string>>")["locations"]).alias("l"))
    places = spot.select("source_id", dates.parse_date(F.coalesce("l.timestamp", "l.timestampMs")).alias("at"), (F.col("l.latitudeE7") / 1e7).alias("lat"), (F.col("l.longitudeE7") / 1e7).alias("lon")).where("lat IS NOT NULL")
    timeline = _like(files, TIMELINE).select("source_id").distinct().join(places.select("source_id").distinct(), "source_id", "left_anti")
    notes = timeline.select("source_id", F.lit("timeline_empty").alias("code"), F.lit(1).cast("long").alias("n"), F.lit("There is a folder for the history of places, but none in it: that history is kept on the phone now.").alias("text"))
    seen = _like(files, r"(?i)(watch|search)-history\.json$").select("source_id", F.col("path").rlike("(?i)watch-history").alias("video"), F.explode(F.from_json("content", "array<struct<title:string,titleUrl:string,time:string>>")).alias("w"))
    title = F.coalesce(F.nullif("w.title", F.lit("")), F.when(F.col("video"), UNTITLED))
    watched = seen.select("source_id", dates.parse_date(F.col("w.time")).alias("at"), F.when(F.col("video"), "video").otherwise("record").alias("kind"), title.alias("label")).where("at IS NOT NULL")
    acted = formats.activity(_like(files, r"(?i)my ?activity.*\.html$").select("source_id", "path", "content")).select("source_id", "at", F.lit("record").alias("kind"), F.concat_ws(" ", "verb", "what").alias("label"))
    mails = formats.mails(mails_in(files) if records is None else records.where("raw IS NOT NULL"), "source_id", "path", "record")
    cells = csv_cells(files).unionByName(fit_series(files)).unionByName(sender_cells(mails))
    return {"sidecars": sidecars, "places": places, "events": watched.unionByName(acted).unionByName(mail_events(mails)), "cells": cells, "notes": notes}


#: What is said before a measure's name, what after it, and the columns that aren't measures.
FIT_WORDS, FIT_UNIT, FIT_TIMES = r"(?i)^(average|avg|max|min|maximum|minimum)\s+", r"\s*\([^)]*\)\s*$", r"(?i)^(|date|start ?time|end ?time)$"


def fit_series(files: DataFrame) -> DataFrame:
    """Cells of fitness files, a table (Date, Value) a measure and source. A source's daily summary counts
    alone where there is one. Of columns that tell the same measure (average, max, min) the first
    average stays, without one the first column. Order within a source's measure is by file and row."""
    fit = _like(files, r"(?i)(^|/)fit/.*\.csv$").where(~F.col("path").rlike("(?i)/activities/")).withColumn("_daily", F.col("path").rlike(r"(?i)daily\s*summar"))
    daily = fit.where("_daily")
    # contents stream past the sources that have a summary; a merge would sort them
    alone = fit.where(~F.col("_daily")).join(daily.select("source_id").distinct().hint("shuffle_hash"), "source_id", "left_anti")
    rows = _csv_sections(daily.unionByName(alone))
    dated = rows.select("source_id", "path", "row_no", formats.under(F.col("header"), F.col("r"), "(?i)^(date|start ?time)$").alias("date"), "header", F.posexplode("r").alias("col_no", "value")).where("date IS NOT NULL")
    label = F.trim(F.get("header", F.col("col_no")))
    stem = F.trim(F.lower(F.regexp_replace(F.regexp_replace("label", FIT_WORDS, ""), FIT_UNIT, "")))
    number = F.col("value").try_cast("double")
    points = dated.withColumn("label", label).where(~F.col("label").rlike(FIT_TIMES) & (F.abs(number) < float("inf"))).withColumn("stem", stem)
    columns = points.select("source_id", "stem", "label", "path", "col_no").distinct()  # hashed, so that few are left to sort
    named = columns.groupBy("source_id", "stem", "label").agg(F.min(F.struct("path", "col_no")).alias("_at"))
    average = F.when(F.col("label").rlike("(?i)^average"), F.col("_at"))
    best = named.groupBy("source_id", "stem").agg(F.coalesce(F.min_by("label", average), F.min_by("label", "_at")).alias("label"), F.min("_at.path").alias("_file"))
    kept = points.join(best, ["source_id", "stem", "label"])
    place = F.row_number().over(Window.partitionBy("source_id", "label").orderBy("path", "row_no")) - 1
    return _as_cells(kept.withColumn("_place", place), F.concat_ws("#", "_file", "label"), F.col("label"), F.col("_place"), {"Date": F.col("date"), "Value": F.col("value")})


def mails_in(files: DataFrame) -> DataFrame:
    """(source_id, path, record, raw): mails of mailboxes whose contents are there, from their separators on."""
    whole = F.concat(F.lit("\n"), F.regexp_replace("content", "\r\n", "\n"))
    cut = _like(files, r"(?i)\.mbox$").select("source_id", "path", F.posexplode(F.split(whole, r"\nFrom (?=\S)")).alias("record", "raw"))
    return cut.where("record > 0").select("source_id", "path", (F.col("record") - 1).cast("long").alias("record"), F.concat(F.lit("From "), "raw").alias("raw"))


def mail_events(mails: DataFrame) -> DataFrame:
    """Dated mails as events, under their subject."""
    return mails.where("at IS NOT NULL").select("source_id", "at", F.lit("email").alias("kind"), F.coalesce("subject", F.lit(NO_SUBJECT)).alias("label"))


def sender_cells(mails: DataFrame) -> DataFrame:
    """Cells of mails(source_id, path, record, name, address): who writes how often, the most frequent first. Senders
    go by the name that they show; the address is that of their first mail."""
    who = F.coalesce("name", F.lit(NOBODY)).alias("name")
    count = mails.select("source_id", "path", "record", who, F.coalesce("address", F.lit("")).alias("address")).groupBy("source_id", "path", "name").agg(F.min_by("address", "record").alias("address"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source_id", "path").orderBy(F.desc("n"), "address", "name")) - 1
    return _as_cells(count.withColumn("_place", place), F.concat_ws("#", "path", F.lit("senders")), F.lit("Mail: who writes to you"), F.col("_place"), {"Sender": F.col("name"), "Address": F.col("address"), "Messages": F.col("n")})


def mail_senders(files: DataFrame) -> DataFrame:
    """Cells of mailboxes, by sender_cells. Only headers are read."""
    return sender_cells(formats.mails(mails_in(files), "source_id", "path", "record"))


#: Fixed value: types of readings that add up over a day.
SUMMED = "^(StepCount|FlightsClimbed|DistanceWalking|DistanceCycling|DistanceSwimming|ActiveEnergyBurned|BasalEnergyBurned|AppleExerciseTime|AppleStandTime|DietaryWater|SwimmingStrokeCount|PushCount|Asleep|InBed)"


HEALTH = r"(?i)(^|/)apple_health_export/(.*/)?export\.xml$"


def health_series(files: DataFrame) -> DataFrame:
    """Cells of health exports, a table (Date, Value) a type of reading; energy at rest has a name of its own."""
    return health_cells(formats.health_readings(_like(files, HEALTH), "source_id", "path"))


def health_cells(readings: DataFrame) -> DataFrame:
    """The same of readings(source_id, path, type, at, value)."""
    per_day = health_days(readings, SUMMED, "source_id", "path").where("value IS NOT NULL")
    spaced = F.regexp_replace(F.regexp_replace("type", "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    readable = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 2**31 - 1)))
    label = F.when(F.col("type") == "Asleep", "Sleep").when(F.col("type") == "InBed", "Time in bed").when(readable.startswith("Basal energy"), "Resting energy").otherwise(readable)
    return _as_cells(per_day, F.concat_ws("#", "path", label), label, F.unix_date(F.col("day").cast("date")), {"Date": F.date_format("day", "yyyy-MM-dd"), "Value": F.col("value")})


def apple(files: DataFrame, records: DataFrame | None = None, tables: DataFrame | None = None, objects: DataFrame | None = None) -> Library:
    """Every CSV file and JSON list as a table, health by type and day; rows of a table with a date and a
    label are events. records(source_id, path, raw), as archive_records gives them for Record elements,
    are the health readings; without them those of the files' contents. tables and objects, as it gives
    them for tables and json, are the tables of files that are too large to be contents."""
    rows = _csv_sections(files)
    lists = _json_tables(_like(files, r"(?i)\.json$"))
    if tables is not None:
        rows = rows.unionByName(formats.section_records(tables))
    if objects is not None:
        lists = lists.unionByName(formats.json_records(objects))
    under = lambda p: formats.under(F.col("header"), F.col("r"), p)
    dated = rows.select("source_id", dates.parse_date(under("(?i)date|time|purchase")).alias("at"), F.lit("record").alias("kind"), F.nullif(under("(?i)item|title|name|description|product"), F.lit("")).alias("label"))
    health = health_series(files) if records is None else health_cells(formats.health_elements(records.where("raw IS NOT NULL"), "source_id", "path"))
    cells = formats.section_cells(rows).unionByName(lists).unionByName(health)
    return {"events": dated.where("at IS NOT NULL AND label IS NOT NULL"), "cells": cells}


#: Fixed value: tables of things that happened, not of measurements.
OCCASION = "(?i)exercise|workout|activity_?type|reward|badge|milestone|trophy|challenge|social"


def samsung(files: DataFrame) -> Library:
    """Sectioned CSV files under a service's mark, with readable column names. Rows of tables of occasions
    are events, under the name of their table."""
    rows = _csv_sections(files)
    #: What an export adds to the names of its files, in this order.
    added = [r"(?i)^com\.samsung\.(shealth\.|health\.)?", r"(?i)[_-][a-z]{0,3}\d{6,}[_-]\d{6,}[_-]access$", r"[._-]\d{6,}$", r"[._-]+$"]
    bare = paths.stem(F.col("path"))
    for mark in added:
        bare = F.regexp_replace(bare, mark, "")
    name = F.concat_ws(": ", F.nullif(F.trim(bare), F.lit("")), "title")
    at = dates.parse_date(formats.under(F.col("header"), F.col("r"), "(?i)start_time|create_time|day_time|date|time"))
    told = rows.select("source_id", at.alias("at"), F.lit("record").alias("kind"), name.alias("label"), F.concat_ws(" ", "path", name).rlike(OCCASION).alias("_occasion"))
    return {"events": told.where("_occasion AND at IS NOT NULL").drop("_occasion"), "cells": formats.tidy_columns(csv_cells(files))}


def reddit(files: DataFrame) -> Library:
    """Posts and comments as events, messages as conversations, all files as tables."""
    said = rows_of(files, r"(?i)(^|/)(posts|comments)\.csv$")
    r = F.col("r")
    kind = F.when(F.col("path").rlike(r"(?i)posts\.csv$"), "post").otherwise("comment")
    label = F.concat_ws(": ", names.subreddit(field(r, "subreddit")), F.coalesce(field(r, "title"), field(r, "body")))
    events = said.select("source_id", dates.parse_date(field(r, "date")).alias("at"), kind.alias("kind"), label.alias("label"))
    sent = rows_of(files, r"(?i)(^|/)(messages|chat_history)[^/]*\.csv$")
    messages = sent.select(
        "source_id", F.coalesce(field(r, "thread_id", "channel_url", "subject"), field(r, "to")).alias("thread"), field(r, "from", "username").alias("sender"), F.lit(None).cast("string").alias("direction"),
        field(r, "body", "message").alias("text"), F.lit("text").alias("type"), dates.parse_date(field(r, "date", "created_at")).alias("at"),
    )
    return {"events": events, "messages": messages, "cells": csv_cells(files)}


def generic(files: DataFrame) -> Library:
    """An export of a service that isn't known: its tables, and no guesses at what they mean."""
    return {"cells": csv_cells(files).unionByName(_json_tables(_like(files, r"(?i)\.json$")))}


def sheet_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks, files(source_id, path, raw binary): each table of their first sheet."""
    rows = _like(files, r"(?i)\.xlsx$").select("source_id", "path", F.posexplode(formats.xlsx_rows("raw")).alias("line", "r"))
    return formats.stacked_cells(formats.stacked_lines(rows))


READERS = {"snapchat": snapchat, "instagram": meta, "facebook": meta, "google": google, "apple": apple, "samsung": samsung, "reddit": reddit}


def media_of(entries: DataFrame, sidecars: DataFrame | None = None, contents: DataFrame | None = None) -> DataFrame:
    """Photos, videos and audio of entries(source_id, path, size, crc32, mod_date, mod_time), dated by a
    movie's header, their sidecar, EXIF, their name or the archive, in this order.

    contents(source_id, path, content binary) are read where they are given; only dates and positions
    of them go into the join. A sidecar's position counts before that of EXIF. Where both entries and
    sidecars have an export_key, sidecars only go with photos of the same export."""
    nothing = F.lit(None).cast("timestamp_ntz")
    found = entries.withColumn("kind", paths.media_kind(F.col("path"))).where("kind IS NOT NULL")
    if sidecars is not None:
        by = [c for c in ("export_key",) if c in entries.columns and c in sidecars.columns]
        found = with_sidecars(found, sidecars.select(*by, "path", "taken", "lat", "lon", "caption"), ["taken", "lat", "lon", "caption"], by)
    else:
        found = found.withColumns({"taken": nothing, "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "caption": F.lit(None).cast("string")})
    if contents is not None:
        kind = paths.media_kind(F.col("path"))
        read = contents.withColumn("_k", kind).where("_k IN ('photo', 'video')").select("source_id", "path", F.when(F.col("_k") == "video", boxes.movie_date(F.col("content"))).alias("_movie"), formats.exif("content").alias("_e"))
        told = read.select("source_id", "path", "_movie", dates.exif_date(F.col("_e.taken")).alias("_shot"), F.col("_e.lat").alias("_lat"), F.col("_e.lon").alias("_lon")).dropDuplicates(["source_id", "path"])
        found = found.join(told, ["source_id", "path"], "left")
    else:
        found = found.withColumns({"_movie": nothing, "_shot": nothing, "_lat": F.lit(None).cast("double"), "_lon": F.lit(None).cast("double")})
    name = dates.date_from_name(paths.base(F.col("path")))
    archive = dates.dos_date(F.col("mod_date"), F.col("mod_time"))
    best = dates.best_date(F.col("kind"), F.col("taken"), F.col("_shot"), F.col("_movie"), name, archive)
    where = [F.coalesce(F.when(F.col("lat").isNotNull(), F.col(c)), F.col(f"_{c}")).alias(c) for c in ("lat", "lon")]
    return found.withColumn("_d", best).select("source_id", "path", paths.base(F.col("path")).alias("name"), "size", "crc32", "kind", "_d.at", "_d.at_source", *where, "caption")


def finish(library: Library, entries: DataFrame, contents: DataFrame | None = None, workbooks: DataFrame | None = None) -> Library:
    """What all services have in common, after their readers: workbooks become tables, pages of a table one
    table, overlays meet their pictures, and media get the best date that there is evidence for, the
    weakest last. entries: those of archive_dir; contents and workbooks(source_id, path, raw) are read
    where they are given."""
    cells = library.get("cells")
    if workbooks is not None:
        sheets = sheet_cells(workbooks)
        cells = sheets if cells is None else cells.unionByName(sheets)
    media = media_of(entries.where("path IS NOT NULL"), library.get("sidecars"), contents)
    overlays = with_overlays(media.where(F.lower("path").rlike("(^|/)memories/")).select("path")).where("base IS NOT NULL AND overlay IS NOT NULL").dropDuplicates(["overlay"])
    taken = overlays.select(F.col("overlay").alias("path"))
    paired = media.join(taken, "path", "left_anti").join(overlays.select(F.col("base").alias("path"), "overlay"), "path", "left").select(*media.columns, "overlay")
    return library | {"media": paired} | ({} if cells is None else {"cells": merge_cells(cells)})
