"""Box trees of movies and HEIF pictures: nested boxes, each with its length before it.

The tree is listed first, boxes with their path of types; what a file says is then looked up by path.
Files may be cut off: a box that goes on beyond what is there ends there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: Boxes that hold boxes, and how many bytes come before those; `iinf` has a count too.
HOLDERS = {"moov": 0, "trak": 0, "mdia": 0, "meta": 4, "iprp": 0, "ipco": 0, "iref": 4}
#: Seconds from 1904 to 1970, the years that a movie's date may be in; boxes that configure a decoder.
EPOCH, YEARS, CODECS = 2_082_844_800, (1990, 2100), ("hvcC", "av1C", "vvcC")
DEPTH = 8


@dataclass
class Box:
    path: str
    start: int
    end: int


def tree(data: bytes, start: int = 0, end: int | None = None, within: str = "") -> Iterator[Box]:
    """Boxes in order, each before those in it. A size of 1 stands for 64 bits that follow, 0 for all the
    rest; one that is smaller than its own head ends the list."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        name = data[at + 4 : at + 8].decode("latin-1")
        box = Box(f"{within}/{name}" if within else name, at + head, min(at + size, end))
        yield box
        skip = HOLDERS.get(name)
        if name == "iinf" and box.start < box.end:
            skip = 6 if data[box.start] == 0 else 8
        if skip is not None and box.path.count("/") < DEPTH:
            yield from tree(data, box.start + skip, box.end, box.path)
        at += size


class Reader:
    """Numbers one after the other; beyond the end is an error."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def take(self, size: int) -> int:
        if self.at + size > self.end:
            raise ValueError("box ends too soon")
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")


def movie_seconds(data: bytes) -> int | None:
    """Seconds since 1970 that the first movie header says; None without one, or out of range."""
    box = next((b for b in tree(data) if b.path == "moov/mvhd"), None)
    if box is None:
        return None
    r = Reader(data, box.start, box.end)
    try:
        version = r.take(4) >> 24
        seconds = (r.take(4) if version == 0 else r.take(8) if version == 1 else 0) - EPOCH
    except ValueError:
        return None
    return seconds if 0 < seconds < 1 << 33 else None


def _places(data: bytes, box: Box) -> dict[int, list[tuple[int, int]]]:
    """(offset, length) of each item's extents."""
    r = Reader(data, box.start, box.end)
    version = r.take(4) >> 24
    sizes = r.take(2)
    offset, length, base, index = (sizes >> 12) & 15, (sizes >> 8) & 15, (sizes >> 4) & 15, sizes & 15
    wide, out = 2 if version < 2 else 4, {}
    for _ in range(r.take(wide)):
        item = r.take(wide)
        r.take(2 if version in (1, 2) else 0)
        r.take(2)
        start = r.take(base)
        found = []
        for _ in range(r.take(2)):
            r.take(index if version in (1, 2) else 0)
            at = r.take(offset)
            found.append((start + at, r.take(length)))
        out[item] = found
    return out


def _properties(data: bytes, box: Box) -> dict[int, list[int]]:
    """Numbers, from 1, of each item's properties."""
    r = Reader(data, box.start, box.end)
    kind = r.take(4)
    out: dict[int, list[int]] = {}
    for _ in range(r.take(4)):
        item = r.take(2 if kind >> 24 < 1 else 4)
        out[item] = [r.take(2) & 0x7FFF if kind & 1 else r.take(1) & 0x7F for _ in range(r.take(1))]
    return out


def picture(data: bytes) -> dict:
    """What a HEIF file says of its main picture: brand, kind (single or grid), sizes, tiles and their places,
    which box configures the decoder, where its EXIF data are. Raises ValueError where it can't be told."""
    boxes = list(tree(data))
    by = lambda path: [b for b in boxes if b.path == path]
    if not by("meta"):
        raise ValueError("no meta box")
    brand = next((data[b.start : b.start + 4].decode("latin-1") for b in by("ftyp")), "")
    number = lambda at, size: Reader(data, at, len(data)).take(size)
    main = next((number(b.start + 4, 2 if data[b.start] == 0 else 4) for b in by("meta/pitm")), 0)
    kinds = {}
    for b in by("meta/iinf/infe"):
        size = 4 if data[b.start] >= 3 else 2
        kinds[number(b.start + 4, size)] = data[b.start + 4 + size + 2 : b.start + 4 + size + 6].decode("latin-1")
    places: dict[int, list[tuple[int, int]]] = {}
    for b in by("meta/iloc"):
        places |= _places(data, b)
    listed = [b for b in boxes if b.path.startswith("meta/iprp/ipco/") and b.path.count("/") == 3]
    owned: dict[int, list[int]] = {}
    for b in by("meta/iprp/ipma"):
        owned |= _properties(data, b)
    has = lambda item, *names: next((p for n in names for i in owned.get(item, []) if 0 < i <= len(listed) for p in [listed[i - 1]] if p.path.endswith(f"/{n}")), None)
    links = {}
    for b in boxes:
        if b.path == "meta/iref/dimg":
            r = Reader(data, b.start, b.end)
            links.setdefault(r.take(2), [r.take(2) for _ in range(r.take(2))])
    size = lambda box: (number(box.start + 4, 4), number(box.start + 8, 4)) if box else None
    exif = next((places[i][0] for i, k in kinds.items() if k == "Exif" and places.get(i)), (None, None))
    told = {"brand": brand, "exif_offset": exif[0], "exif_length": exif[1]}
    if kinds.get(main) == "grid":
        if not places.get(main):
            raise ValueError("grid without data")
        tiles = links.get(main, [])
        if not tiles:
            raise ValueError("grid without tiles")
        at = places[main][0][0]
        _, flags, down, across = (number(at + i, 1) for i in range(4))
        width, height = (number(at + 4, 4), number(at + 8, 4)) if flags & 1 else (number(at + 4, 2), number(at + 6, 2))
        codec, each = has(tiles[0], *CODECS), size(has(tiles[0], "ispe")) or (-(-width // (across + 1)), -(-height // (down + 1)))
        if codec is None:
            raise ValueError("tiles without a decoder's configuration")
        held = [places[t][0] for t in tiles if places.get(t)]
        return told | {"kind": "grid", "width": width, "height": height, "n_rows": down + 1, "n_cols": across + 1, "tile_width": each[0], "tile_height": each[1], "codec": codec.path[-4:], "tiles": held}
    codec, whole = has(main, *CODECS), size(has(main, "ispe"))
    if codec is None or whole is None or not places.get(main):
        raise ValueError("a layout that isn't known")
    return told | {"kind": "single", "width": whole[0], "height": whole[1], "n_rows": 1, "n_cols": 1, "tile_width": whole[0], "tile_height": whole[1], "codec": codec.path[-4:], "tiles": places[main][:1]}


_TILE = StructType([StructField("offset", LongType()), StructField("length", LongType())])
_PICTURE = StructType(
    [StructField("brand", StringType()), StructField("kind", StringType())] + [StructField(c, LongType()) for c in ("width", "height")] + [StructField(c, IntegerType()) for c in ("n_rows", "n_cols")]
    + [StructField(c, LongType()) for c in ("tile_width", "tile_height")] + [StructField("codec", StringType()), StructField("tiles", ArrayType(_TILE)), StructField("exif_offset", LongType()), StructField("exif_length", LongType()), StructField("readable", BooleanType()), StructField("error", StringType())]
)


@F.pandas_udf(LongType())
def _movie(head: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else movie_seconds(bytes(h)) for h in head], dtype="Int64")


def movie_date(head: Column) -> Column:
    """When a movie says it was made: the mvhd box in its moov box, either version; 1990 to 2100."""
    at = F.timestamp_add("SECOND", _movie(head), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return F.when(F.year(at).between(*YEARS), at)


@F.pandas_udf(_PICTURE)
def heif(content: pd.Series) -> pd.DataFrame:
    """A struct of what picture() tells; where it can't, readable is false and error says why. Null: all null."""

    def one(raw):
        if raw is None:
            return {}
        try:
            return picture(bytes(raw)) | {"readable": True}
        except (ValueError, IndexError) as problem:
            return {"readable": False, "error": str(problem)}

    names = _PICTURE.fieldNames()
    rows = [one(c) for c in content]
    frame = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})
    frame["tiles"] = [None if r.get("tiles") is None else [{"offset": o, "length": n} for o, n in r["tiles"]] for r in rows]
    return frame
