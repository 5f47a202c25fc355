"""The tables of a library, as DDL: what readers emit and operators take."""

from __future__ import annotations

ENTRIES = "source_id INT, path STRING, size BIGINT, comp_size BIGINT, crc32 BIGINT, method INT, encrypted BOOLEAN, mod_ts TIMESTAMP_NTZ, nested_in STRING"
SOURCES = "source_id INT, name STRING, provider STRING, export_key STRING"
MEDIA = "source_id INT, path STRING, name STRING, size BIGINT, crc32 BIGINT, kind STRING, at TIMESTAMP_NTZ, at_source STRING, lat DOUBLE, lon DOUBLE, caption STRING"
MESSAGES = "source_id INT, thread STRING, sender STRING, direction STRING, text STRING, type STRING, at TIMESTAMP_NTZ"
EVENTS = "source_id INT, at TIMESTAMP_NTZ, kind STRING, label STRING"
PLACES = "source_id INT, at TIMESTAMP_NTZ, lat DOUBLE, lon DOUBLE"
CELLS = "source_id INT, table_id STRING, title STRING, row_no BIGINT, col_no INT, col_name STRING, value STRING"
FILES = "source_id INT, path STRING, name STRING, size BIGINT, sniffed_as STRING"
NOTES = "source_id INT, code STRING, n BIGINT, text STRING"

LIBRARY = {"media": MEDIA, "messages": MESSAGES, "events": EVENTS, "places": PLACES, "cells": CELLS, "files": FILES, "notes": NOTES}
