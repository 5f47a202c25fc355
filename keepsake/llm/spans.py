"""Spans of a text by regular expressions, with code point offsets, as Column expressions.

Splitting by an expression and extracting its matches give the same matches in the same order,
so the lengths of what lies between and of the matches add up to offsets. Expressions that repeat
a group do so possessively: Java's matcher would recurse for each repetition otherwise.

All of it is linear in the number of spans: running values are made in chunks (an array that
grows by one is copied each time, so only short ones grow), arrays are bound by once() before
they are indexed in a lambda (an expression there is computed again for every element), and
overlaps come from running ends and starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a chunk of running(); code points of a piece of Slices.
CHUNK, PIECE = 128, 1024
SPAN = "struct<s:int,kind:int,e:int>"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Array of the states (of type kind) after each item: step(state before, item)."""

    def chunks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(xs, i + 1, F.lit(CHUNK)))

    def walked(last: Column, chunk: Column) -> Column:
        first = F.array(last).cast(f"array<{kind}>")
        return F.aggregate(chunk, first, lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x)).cast(f"array<{kind}>")))

    whole = f"struct<last:{kind},out:array<array<{kind}>>>"
    done = F.aggregate(
        once(items, chunks),
        F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out")).cast(whole),
        lambda a, c: once(walked(a["last"], c), lambda w: F.struct(F.element_at(w, -1).alias("last"), F.concat(a["out"], F.array(F.slice(w, 2, F.size(w) - 1))).alias("out"))).cast(whole),
        lambda a: F.flatten(a["out"]),
    )
    return F.coalesce(done, F.array().cast(f"array<{kind}>"))


def find(text: str, pattern: str, where: Column | None = None, context: int = 40) -> Column:
    """Array of (s, e, m, left, right) of a text column: start, end (exclusive), the match, up to
    `context` characters before it (and after the match before), one character after it. Texts
    for which `where` is false aren't searched. No match, or no search: null or empty."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(g: Column, m: Column, ends: Column) -> Column:
        return F.transform(
            m,
            lambda x, i: once(
                F.get(ends, i),
                lambda e: F.struct(
                    (e - F.length(x)).alias("s"), e.alias("e"), x.alias("m"), F.right(F.get(g, i), F.lit(context)).alias("left"), F.left(F.get(g, i + 1), F.lit(1)).alias("right")
                ),
            ),
        )

    def walked(g: Column) -> Column:
        # gaps has one element more than found; the last pair has no match
        steps = lambda m: F.zip_with(m, g, lambda x, y: F.length(y) + F.coalesce(F.length(x), F.lit(0)))
        return once(found, lambda m: once(running(steps(m), F.lit(0), lambda a, n: a + n, "int"), lambda ends: spans(g, m, ends)))

    read = once(gaps, lambda g: F.when(F.size(g) > 1, walked(g)))
    return read if where is None else F.when(where, read)


def kept(found: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.filter(found, test), F.array())


def count(spans: str, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def plain(x: Column) -> Column:
    """A span's start, kind and end alone."""
    return F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined, of spans with s, e and kind (position in names), in order of
    start, then kind."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.sort_array(F.transform(spans, plain)), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def apart(spans: Column) -> Column:
    """Spans (s, e, ...) as (s, kind, e), sorted, without those that overlap an earlier one that stays."""

    def chosen(xs: Column) -> Column:
        state = "struct<at:int,ok:boolean>"
        seen = running(
            xs,
            F.struct(F.lit(0).alias("at"), F.lit(False).alias("ok")),
            lambda a, x: F.struct(F.when(x["s"] >= a["at"], x["e"]).otherwise(a["at"]).alias("at"), (x["s"] >= a["at"]).alias("ok")),
            state,
        )
        return once(seen, lambda r: F.filter(xs, lambda x, i: F.get(r, i)["ok"]))

    ordered = F.sort_array(F.transform(spans, plain))
    return F.when(F.size(spans) > 1, once(ordered, chosen)).otherwise(ordered)


def free_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, sorted by start; both have s, kind and e and may have more.

    In one order of starts, a span overlaps one of the others that begins before it, or where it
    does, if the furthest end so far lies beyond its start; and one that begins later if the
    nearest start from there on lies before its end."""
    mark = "struct<s:int,own:boolean,at:int,e:int>"
    order = F.sort_array(
        F.concat(
            F.transform(others, lambda x: F.struct(x["s"].alias("s"), F.lit(False).alias("own"), F.lit(0).alias("at"), x["e"].alias("e")).cast(mark)),
            F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), F.lit(True).alias("own"), i.alias("at"), x["e"].alias("e")).cast(mark)),
        )
    )

    def clear(xs: Column) -> Column:
        far = running(xs, F.lit(0), lambda a, x: F.when(x["own"], a).otherwise(F.greatest(a, x["e"])), "int")
        most = F.lit(2**31 - 1)
        near = F.reverse(running(F.reverse(xs), most, lambda a, x: F.when(x["own"], a).otherwise(x["s"]), "int"))
        ok = once(far, lambda f: once(near, lambda n: F.filter(xs, lambda x, i: x["own"] & (F.get(f, i) <= x["s"]) & (F.get(n, i) >= x["e"]))))
        return once(F.transform(ok, lambda x: x["at"]), lambda at: once(spans, lambda all_: F.transform(at, lambda i: F.get(all_, i))))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), once(order, clear)).otherwise(spans)


class Slices:
    """Parts of a long text by code points, each at the cost of its own length and one piece's."""

    def __init__(self, text: Column):
        self.text = text

    def bind(self, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
        pieces = F.regexp_extract_all(self.text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return once(pieces, lambda p: body(lambda a, b: self._cut(p, a, b)))

    def _cut(self, p: Column, a: Column, b: Column) -> Column:
        i, j = F.shiftright(a, PIECE.bit_length() - 1), F.shiftright(b, PIECE.bit_length() - 1)
        x, y = a.bitwiseAND(PIECE - 1), b.bitwiseAND(PIECE - 1)
        head, tail = F.substring(F.get(p, i), x + 1, F.lit(PIECE)), F.coalesce(F.left(F.get(p, j), y), F.lit(""))
        return F.when(b <= a, F.lit("")).when(i == j, F.substring(F.get(p, i), x + 1, b - a)).otherwise(
            F.concat(head, F.when(j > i + 1, F.array_join(F.slice(p, i + 2, j - i - 1), "")).otherwise(F.lit("")), tail)
        )
