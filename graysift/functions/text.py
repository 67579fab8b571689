"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DOT = "•"
MATCHES = "array<struct<start:int,value:string>>"
SPANS = "array<struct<start:int,end:int>>"
#: Matches whose places are summed up together, and steps that are taken together.
CHUNK = 256
#: Characters of a block of a text.
BLOCK = 1024


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: str, pattern: str) -> Column:
    """All non-overlapping matches in a column, leftmost first, with the characters before each: what matched and what
    lies between is folded into running positions, CHUNK matches at a time, so that the work is linear in their number.
    (In SQL, as an expression of many parts is made in one call.)"""
    step = "(h, x) -> named_struct('at', h.at + x.gap + length(x.value), 'found', concat(h.found, array(named_struct('start', h.at + x.gap, 'value', x.value))))"
    placed = lambda part, at: f"aggregate({part}, named_struct('at', {at}, 'found', cast(array() as {MATCHES})), {step})"
    parts = f"transform(sequence(0, cast(floor((size(p) - 1) / {CHUNK}) as int)), k -> slice(p, k * {CHUNK} + 1, {CHUNK}))"
    more = f"(all, part) -> get(transform(array({placed('part', 'all.at')}), d -> named_struct('at', d.at, 'parts', concat(all.parts, array(d.found)))), 0)"
    chunked = f"flatten(aggregate({parts}, named_struct('at', 0, 'parts', cast(array() as array<{MATCHES}>)), {more}).parts)"
    pairs = f"get(transform(array(regexp_extract_all({text}, {quoted(pattern)}, 0)), v -> zip_with(v, slice(split({text}, {quoted(pattern)}, -1), 1, size(v)), (v, g) -> named_struct('gap', length(g), 'value', v))), 0)"
    return F.expr(f"get(transform(array({pairs}), p -> if(size(p) <= {CHUNK}, {placed('p', '0')}.found, {chunked})), 0)")


def count_below(places: Column, x: Column) -> Column:
    """How many of the sorted places lie before x, by halving."""
    start = F.struct(F.lit(0).alias("low"), F.size(places).alias("high"))

    def half(h: Column, _: Column) -> Column:
        middle = F.floor((h["low"] + h["high"]) / 2).cast("int")
        below = F.get(places, middle) < x
        return F.when(h["low"] >= h["high"], h).otherwise(F.struct(F.when(below, middle + 1).otherwise(h["low"]).alias("low"), F.when(below, h["high"]).otherwise(middle).alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(places) + 1.0)).cast("int"))
    return F.aggregate(steps, start, half, lambda h: h["low"])


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters, from which part_of() takes parts without passing over what lies before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def items(held: Column, first: Column, last: Column) -> Column:
    """The items from first to last (from 0). slice() would copy the whole array each time."""
    return F.transform(F.sequence(first, last), lambda k: F.get(held, k))


def part_of(held: Column, start: Column, length: Column) -> Column:
    """length characters from start (from 0) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    inside = start - first * BLOCK
    some = items(held, first, first + F.floor((inside + F.greatest(length, F.lit(1)) - 1) / BLOCK).cast("int"))
    return F.array_join(some, "").substr(inside + 1, length)


def newlines(held: Column) -> Column:
    """The places of the newlines of a text in blocks, in order: one pass, a block at a time."""

    def places(block: Column, base: Column) -> Column:
        lines = F.split(block, "\n", -1)
        start = F.struct((base - 1).alias("at"), F.array().cast("array<int>").alias("found"))
        after = lambda h, x: let((h["at"] + F.length(x) + 1).cast("int"), lambda at: F.struct(at.alias("at"), F.concat(h["found"], F.array(at)).alias("found")))
        return F.when(F.contains(block, F.lit("\n")), F.aggregate(F.slice(lines, 1, F.size(lines) - 1), start, after, lambda h: h["found"])).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(held, lambda b, i: places(b, (i * BLOCK).cast("int"))))


def index(text: Column) -> Column:
    """struct<n, blocks, newlines> of a text: its length, its blocks and the places of its newlines."""
    return let(blocks(text), lambda held: F.struct(F.length(text).alias("n"), held.alias("blocks"), newlines(held).alias("newlines")))


def first_places(keys: Column) -> Column:
    """Places (from 0) where each different key comes first, in order: keys are sorted with their places, and of each run of
    equal ones the first is taken."""
    rows = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    firsts = let(rows, lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["k"] != x["k"])))
    return F.array_sort(F.transform(firsts, lambda x: x["i"]))


def strip(text: Column) -> Column:
    """Without the white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def mask(value: Column) -> Column:
    """Hides the middle: an address keeps two characters and its domain, other values two at each end."""
    at = F.locate("@", value)
    n = F.length(value)
    address = F.concat(F.substring(value, 1, 2).substr(F.lit(1), F.least(F.lit(2), at - 1)), F.repeat(F.lit(DOT), F.greatest(F.lit(3), at - 3)), value.substr(at, n))
    plain = F.concat(F.substring(value, 1, 2), F.repeat(F.lit(DOT), F.greatest(F.lit(3), n - 4)), F.substring(value, -2, 2))
    return F.when(at > 0, address).when(n <= 4, F.repeat(F.lit(DOT), n)).otherwise(plain)


def mask_secret(value: Column) -> Column:
    """A secret shows two characters at each end whatever it holds."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit(DOT), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit(DOT), F.greatest(F.lit(3), n - 4)), F.substring(value, -2, 2)))


def line_number(text: Column, start: Column) -> Column:
    """From 1; start counts characters from 0."""
    before = text.substr(F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def snippet(text: Column, start: Column, length: Column, margin: int = 70, n: Column | None = None, held: Column | None = None) -> Column:
    """The value with what stands around it, white space as single spaces, … where it is clipped. n, held: the text's length
    and blocks, where they are known."""
    n = F.length(text) if n is None else n
    low, high = F.greatest(F.lit(0), start - margin), F.least(n, start + length + margin)
    part = text.substr(low + 1, high - low) if held is None else part_of(held, low, high - low)
    core = F.trim(F.regexp_replace(part, r"(?U)\s+", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), core, F.when(high < n, "…").otherwise(""))


def around(text: Column, start: Column, length: Column, before: int, after: int, held: Column | None = None) -> Column:
    low = F.greatest(F.lit(0), start - before)
    return text.substr(low + 1, start + length + after - low) if held is None else part_of(held, low, start + length + after - low)


def human_size(n: Column) -> Column:
    """Bytes in steps of 1000: no decimals for bytes and from 100, else one; halves go to the even neighbour."""
    value = F.coalesce(n.cast("double"), F.lit(0.0))
    shown = lambda x, unit: F.concat(F.when(x >= 100, F.bround(x, 0).cast("long").cast("string")).otherwise(F.format_string("%.1f", x)), F.lit(f" {unit}"))
    return (
        F.when(value < 1000, F.concat(F.bround(value, 0).cast("long").cast("string"), F.lit(" B")))
        .when(value < 1e6, shown(value / 1e3, "kB"))
        .when(value < 1e9, shown(value / 1e6, "MB"))
        .when(value < 1e12, shown(value / 1e9, "GB"))
        .otherwise(shown(value / 1e12, "TB"))
    )


def duration(seconds: Column) -> Column:
    """m:ss."""
    s = F.floor(F.coalesce(seconds, F.lit(0.0)) + 0.5)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def name_as_text(name: Column) -> Column:
    return F.translate(name, "_-.", "   ")


def html_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def chunks(whole: Column, size: int = 6000, overlap: int = 200) -> Column:
    """array<struct<start, end, text>>: blocks of a text of at most size characters that overlap. A block ends at its last
    newline if that lies beyond 60 % of it. A text that fits is one block. size must exceed 2 * overlap.

    One pass finds the newlines; a block's end is then found by halving, and its text taken from blocks of the text, so
    the work is linear in the text's length. The recurrence is folded over as many steps as the text can need, CHUNK at a
    time; only positions are carried.
    """
    if overlap < 0 or 0.6 * size <= overlap:
        raise ValueError("60 % of size must exceed overlap")
    least = int(size * 0.6)

    def spans(t: Column) -> Column:
        n = t["n"]

        def end_of(start: Column) -> Column:
            full = F.least(n, start + size)
            last = F.get(t["newlines"], count_below(t["newlines"], full) - 1)
            return let(full, lambda f: F.when((f < n) & (last > start + least), last).otherwise(f))

        def step(held: Column, _: Column) -> Column:
            span = lambda e: F.array(F.struct(held["at"].alias("start"), e.alias("end")))
            more = let(end_of(held["at"]), lambda e: F.struct((e - overlap).alias("at"), (e >= n).alias("done"), F.concat(held["found"], span(e)).alias("found")))
            return F.when(held["done"], held).otherwise(more)

        def several(held: Column, _: Column) -> Column:
            start = F.struct(held["at"].alias("at"), held["done"].alias("done"), F.array().cast(SPANS).alias("found"))
            taken = F.aggregate(F.sequence(F.lit(1), F.lit(CHUNK)), start, step)
            return let(taken, lambda r: F.struct(r["at"].alias("at"), r["done"].alias("done"), F.concat(held["parts"], F.array(r["found"])).alias("parts")))

        steps = F.sequence(F.lit(0), F.floor(n / (least - overlap) / CHUNK).cast("int"))
        first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(f"array<{SPANS}>").alias("parts"))
        return F.aggregate(steps, first, several, lambda h: F.flatten(h["parts"]))

    def cut(t: Column) -> Column:
        taken = lambda s: part_of(t["blocks"], s["start"], s["end"] - s["start"])
        return F.transform(spans(t), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), taken(s).alias("text")))

    one = F.array(F.struct(F.lit(0).alias("start"), F.length(whole).alias("end"), whole.alias("text")))
    return F.when(F.length(whole) <= size, one).otherwise(let(index(whole), cut))
