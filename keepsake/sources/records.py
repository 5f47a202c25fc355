"""Records of a stream: mails, XML elements, CSV rows, rows of the tables in a CSV text, elements of JSON arrays,
blocks of a page. Each holds a piece of the stream and one record."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

#: Characters read at once (a separator's at least); the longest element before it is given up.
PIECE, LONGEST = 1 << 18, 1 << 24
SEPARATOR = re.compile(r"From \S")


def read(kind: str, stream, headers: bool = False) -> Iterator[tuple]:
    """(raw, fields) of each record, of rows of tables their table as well. Bytes that aren't UTF-8 are replaced."""
    text = io.TextIOWrapper(io.BufferedReader(stream, PIECE) if isinstance(stream, io.RawIOBase) else stream, "utf-8", "replace", newline="\n")
    if kind == "mbox":
        return ((m, None) for m in mails(text, headers))
    if kind == "csv":
        return ((None, r) for r in rows(text))
    if kind == "tables":
        return ((None, r, *table) for *table, r in tables(rows(text)))
    if kind == "json":
        return objects(text)
    if kind.startswith("after:"):
        return ((b, None) for b in blocks(text, kind[6:]))
    if kind.startswith("xml:"):
        return ((e, None) for e in elements(text, kind[4:]))
    raise ValueError(f"no records of kind {kind}")


def mails(text, headers: bool = False) -> Iterator[str]:
    """Mails of a mailbox, each from its separator line on; with headers only up to the first blank line. What
    comes before the first separator is none's."""
    mail: list[str] | None = None
    fresh = taking = True
    while piece := text.readline(PIECE):  # a longer line comes in several pieces
        begins, fresh = fresh, piece.endswith("\n")
        if begins and SEPARATOR.match(piece):
            if mail is not None:
                yield "".join(mail)
            mail, taking = [piece], True
        elif mail is not None and taking:
            if headers and begins and not piece.strip("\r\n"):
                taking = False
            else:
                mail.append(piece)
    if mail is not None:
        yield "".join(mail)


def elements(text, tag: str) -> Iterator[str]:
    """The attributes of each element with this tag; quoted values may hold angle brackets. An element
    without an end within LONGEST characters isn't one."""
    whole = re.compile(rf"""<{re.escape(tag)}(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
    begin = re.compile(rf"<{re.escape(tag)}(?=[\s/>]|\Z)")
    held = ""
    while piece := text.read(PIECE):
        held += piece
        at = 0
        for m in whole.finditer(held):
            yield m[1].strip().removesuffix("/").strip()
            at = m.end()
        start = begin.search(held, at)
        if start is None:  # the tag itself may be cut
            at = max(at, len(held) - len(tag) - 1)
        else:
            at = start.start() + int(len(held) - start.start() > LONGEST)
        held = held[at:]


def rows(text) -> Iterator[list[str]]:
    """Rows of a CSV text; quoted fields may hold line ends, blank rows at the end are dropped."""
    import csv

    csv.field_size_limit(2**31 - 1)
    blank: list[list[str]] = []
    for row in csv.reader(line.replace("\r\n", "\n").replace("\r", "") for line in text):
        if any(c.strip() for c in row):
            yield from blank
            blank = []
            yield row
        else:
            blank.append(row)


def tables(rows: Iterable[list[str]]) -> Iterator[tuple[int, str | None, int, list[str], list[str]]]:
    """(section, title, row_no, header, row) of the tables in CSV rows, with the next row known.

    A lone field above a wider row is a heading; a heading or a row after a blank one starts a
    section. A section's first wide row has its column names; `com.samsung...` on the first line
    is a service's mark, not a heading."""
    width = lambda r: sum(c is not None and c.strip(" ") != "" for c in r)
    marked = lambda k, r: k == 0 and len(r) > 0 and (r[0] or "").lower().startswith("com.samsung")
    wide = ((width(r), r) for k, r in enumerate(rows) if not marked(k, r))
    section, title, header, n, last = 0, None, None, 0, 0
    for (w, row), (following, _) in pairwise(chain(wide, [(0, None)])):
        heading = w == 1 and following > 1
        if w and (heading or last == 0):
            section, title, header, n = section + 1, (row[0] or "").strip(" ") if heading else None, None, 0
        if w and not heading and header is None:
            header = row
        elif w and not heading:
            yield section, title, n, header, row
            n += 1
        last = w


def blocks(text, mark: str) -> Iterator[str]:
    """What follows each occurrence of a mark, up to the next one."""
    held, inside = "", False
    while piece := text.read(PIECE):
        *whole, held = (held + piece).split(mark)
        yield from whole if inside else whole[1:]
        inside = inside or bool(whole)
        if not inside:
            held = held[-len(mark) :]
    if inside:
        yield held


def objects(text) -> Iterator[tuple[str, list[str]]]:
    """(raw, [key, *names]) of the objects in arrays at the top of a JSON text, or under any key there: their key
    (at the top none) and the names in their array's first element, in order. Other elements have no
    record, null has. A value that can't be read ends the text with a ValueError."""

    def refuse(constant: str):
        raise ValueError(constant)

    decode = json.JSONDecoder(parse_constant=refuse, strict=False).raw_decode
    space = re.compile(r"\s*")
    held, at, ended = "", 0, False

    def more() -> None:
        """Reads as much as is held, so that a long value costs its length."""
        nonlocal held, at, ended
        piece = text.read(max(PIECE, len(held) - at))
        held, at, ended = held[at:] + piece, 0, not piece

    def mark() -> str:
        """The next character that isn't white space; it stays."""
        nonlocal at
        while True:
            at = space.match(held, at).end()
            if at < len(held) or ended:
                return held[at : at + 1]
            more()

    def value() -> tuple[object, str]:
        nonlocal at
        mark()
        while True:
            try:
                found, end = decode(held, at)
                if end < len(held) or ended:  # a number may go on
                    raw, at = held[at:end], end
                    return found, raw
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    def expect(wanted: str) -> str:
        nonlocal at
        if not (found := mark()) or found not in wanted:
            raise ValueError(f"{found!r} instead of one of {wanted}")
        at += 1
        return found

    def array(key: str) -> Iterator[tuple[str, list[str]]]:
        names: list[str] | None = None
        expect("[")
        if mark() == "]":
            expect("]")
            return
        while True:
            found, raw = value()
            if names is None:
                names = sorted(found, key=lambda k: k.encode("utf-16-be", "surrogatepass")) if isinstance(found, dict) else []
            if found is None or isinstance(found, dict):
                yield raw, [key, *names]
            if expect(",]") == "]":
                return

    if mark() == "[":
        yield from array("")
    elif mark() == "{":
        expect("{")
        while mark() != "}":
            key, _ = value()
            expect(":")
            if not isinstance(key, str):
                raise ValueError("a key that is no string")
            if mark() == "[":
                yield from array(key)
            else:
                value()
            if mark() != "}":
                expect(",")
