"""Dates, positions and descriptions written into JPEG files, as EXIF and XMP segments."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Heads of the two kinds of segment, tags, and what a segment holds at most.
EXIF, XMP, MOST = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", 65_533
DESCRIPTION, CHANGED, EXIF_AT, GPS_AT, ORIGINAL, DIGITIZED = 0x010E, 0x0132, 0x8769, 0x8825, 0x9003, 0x9004
ASCII, LONG, RATIONAL = 2, 4, 5


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of the segments between a JPEG's start and its picture, marker and length included."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if end > len(data):
            return
        yield data[at + 1], at, end
        at = end


def directory(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
    """A directory of (tag, kind, count, value) for offset `at`; values of over four bytes follow it."""
    entries = sorted(entries)
    after = at + 2 + 12 * len(entries) + 4
    head, tail = struct.pack(">H", len(entries)), b""
    for tag, kind, count, value in entries:
        head += struct.pack(">HHI", tag, kind, count)
        if len(value) <= 4:
            head += value.ljust(4, b"\0")
        else:
            head += struct.pack(">I", after + len(tail))
            tail += value + b"\0" * (len(value) % 2)
    return head + b"\0" * 4 + tail


def _degrees(x: float) -> bytes:
    """Degrees, minutes and ten-thousandths of a second."""
    units = round(abs(x) * 36_000_000)
    return struct.pack(">6I", units // 36_000_000, 1, units // 600_000 % 60, 1, units % 600_000, 10_000)


def exif_block(at: str | None, lat: float | None, lon: float | None, text: str | None) -> bytes:
    """An EXIF segment's content; at as `2024:01:02 03:04:05`, text as far as it is ASCII."""
    string = lambda s: s.encode("ascii", "replace") + b"\0"
    ascii_ = lambda tag, s: (tag, ASCII, len(string(s)), string(s))
    top = ([ascii_(CHANGED, at)] if at else []) + ([ascii_(DESCRIPTION, text)] if text else [])
    inner = [(EXIF_AT, [ascii_(ORIGINAL, at), ascii_(DIGITIZED, at)])] if at else []
    if lat is not None and lon is not None:
        letters = ("S" if lat < 0 else "N", "W" if lon < 0 else "E")
        inner.append((GPS_AT, [ascii_(1, letters[0]), (2, RATIONAL, 3, _degrees(lat)), ascii_(3, letters[1]), (4, RATIONAL, 3, _degrees(lon))]))
    pointers = [(tag, LONG, 1, b"\0" * 4) for tag, _ in inner]
    where, body = 8 + len(directory(top + pointers, 8)), b""
    for i, (tag, entries) in enumerate(inner):
        pointers[i] = (tag, LONG, 1, struct.pack(">I", where + len(body)))
        body += directory(entries, where + len(body))
    return EXIF + b"MM\0*" + struct.pack(">I", 8) + directory(top + pointers, 8) + body


def xmp_block(text: str) -> bytes:
    packet = (
        '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        '<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:description><rdf:Alt><rdf:li xml:lang="x-default">' + escape(text) + "</rdf:li></rdf:Alt></dc:description></rdf:Description></rdf:RDF></x:xmpmeta>"
        '<?xpacket end="w"?>'
    )
    return XMP + packet.encode()


def stamp(data: bytes, at: str | None, lat: float | None, lon: float | None, text: str | None) -> bytes:
    """A JPEG with new EXIF data in place of its own, and with a description, if it is given, in place of its
    XMP. Anything else comes back as it is, and so does a JPEG without anything to say. A description
    that no segment holds is only in the EXIF data as far as it fits there, or else left out."""
    if data[:2] != b"\xff\xd8" or not (at or text or (lat is not None and lon is not None)):
        return data
    xmp = xmp_block(text) if text else b""
    exif = exif_block(at, lat, lon, text)
    if len(exif) > MOST:
        exif = exif_block(at, lat, lon, None)
    new = [b for b in (exif, xmp if len(xmp) <= MOST else b"") if b]
    gone = tuple(h for h, b in ((EXIF, exif), (XMP, xmp)) if b)
    out, kept = [data[:2]], 2
    out += [b"\xff\xe1" + struct.pack(">H", len(b) + 2) + b for b in new]
    for marker, start, end in segments(data):
        if marker == 0xE1 and data[start + 4 : end].startswith(gone):
            out.append(data[kept:start])
            kept = end
    return b"".join([*out, data[kept:]])


@F.pandas_udf(BinaryType())
def stamped(content: pd.Series, at: pd.Series, lat: pd.Series, lon: pd.Series, text: pd.Series) -> pd.Series:
    """Files with a date (a timestamp), a position and a description written into them, by stamp(). Null stays null."""

    def one(data, when, y, x, said):
        if data is None:
            return None
        pair = (None, None) if pd.isna(y) or pd.isna(x) or abs(y) > 90 or abs(x) > 180 else (float(y), float(x))
        return stamp(bytes(data), None if pd.isna(when) else when.strftime("%Y:%m:%d %H:%M:%S"), *pair, said or None)

    return pd.Series([one(*row) for row in zip(content, at, lat, lon, text)], dtype=object)


@F.pandas_udf(StringType())
def description(content: pd.Series) -> pd.Series:
    """The description in a JPEG's XMP data; null without one."""
    found = re.compile(rb"<dc:description>.*?<rdf:li[^>]*>(.*?)</rdf:li>", re.DOTALL)

    def one(data):
        if data is None or bytes(data[:2]) != b"\xff\xd8":
            return None
        data = bytes(data)
        for marker, start, end in segments(data):
            if marker == 0xE1 and data[start + 4 : end].startswith(XMP) and (m := found.search(data, start, end)):
                return unescape(m[1].decode("utf-8", "replace"))
        return None

    return content.map(one)
