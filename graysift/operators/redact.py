"""Texts with the values found replaced by labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands in the place of a value, around its type.
OPEN, CLOSE = "[GEREDIGEERD:", "]"
PAIRS = "array<struct<o:int,v:string,t:string>>"


def pairs_of(findings: Column) -> Column:
    """array<struct<o, v, t>>: values to replace and their types, longer ones first, equally long ones by value and type. Words of
    special categories stay, as do values of under three characters."""
    usable = F.filter(findings, lambda f: (f["category"] != "bijzonder") & (F.length(f["value"]) >= 3))
    return F.array_sort(F.array_distinct(F.transform(usable, lambda f: F.struct((-F.length(f["value"])).alias("o"), f["value"].alias("v"), f["type"].alias("t")))))


def swept(text: str, pairs: list[tuple[str, str]]) -> tuple[str, int]:
    """The text with all values replaced, in one pass however many there are, and the number of places.

    An automaton of all values finds every place of each. Places are taken in order of the values, then from the left,
    where nothing taken before lies: as values come longest first, a place is free if its first and last characters are.
    That is what replacing one value after another gives, unless a value can meet a label; then it is done that way.
    """
    import ahocorasick

    first: dict[str, str] = {}
    for value, kind in pairs:
        first.setdefault(value, kind)
    labels = {f"{OPEN}{kind}{CLOSE}" for kind in first.values()}
    if any("[" in v or "]" in v or any(v in label for label in labels) for v in first):
        n = 0
        for value, kind in first.items():
            n += text.count(value)
            text = text.replace(value, f"{OPEN}{kind}{CLOSE}")
        return text, n
    automaton = ahocorasick.Automaton()
    for rank, (value, kind) in enumerate(first.items()):
        automaton.add_word(value, (rank, len(value), kind))
    automaton.make_automaton()
    places = sorted((rank, end - length + 1, length, kind) for end, (rank, length, kind) in automaton.iter(text))
    taken, chosen = bytearray(len(text)), []
    for _, start, length, kind in places:
        if not taken[start] and not taken[start + length - 1]:
            taken[start : start + length] = b"\1" * length
            chosen.append((start, start + length, kind))
    out, at = [], 0
    for start, end, kind in sorted(chosen):
        out += [text[at:start], OPEN, kind, CLOSE]
        at = end
    return "".join([*out, text[at:]]), len(chosen)


def redacted_texts(results: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, replaced) of results of scan(docs, every=True): as redact(), for any number of values of a text. Null texts
    count as empty. Rows do not move; the values of one text are held at a time."""
    rows = results.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"), pairs_of(F.col("findings")).cast(PAIRS).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece = batch.slice(k, 64)
                found = []
                for text, pairs in zip(piece["text"].to_pylist(), piece["pairs"].to_pylist(), strict=True):
                    found.append(swept(text, [(p["v"], p["t"]) for p in pairs]) if pairs else (text, 0))
                yield pa.RecordBatch.from_arrays([piece[id_col], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], [id_col, "text", "replaced"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string, replaced long")


def redact(text: Column, findings: Column) -> Column:
    """struct<text, n>: the text with each value found as [GEREDIGEERD:type], and the number of places replaced.

    Words of special categories stay, as do values of under three characters. Longer values are replaced first,
    equally long ones in order of value and type. A value that also stands in the name is replaced in the text.

    Only listed findings are replaced: values beyond the report's caps (25 a type, 15 matches of names) stay. For all values
    of a text use redacted_texts() with scan(docs, every=True); here each value is one pass over the text.
    """
    pairs = pairs_of(findings)
    first = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("n"))

    def step(held: Column, p: Column) -> Column:
        left = F.replace(held["text"], p["v"], F.lit(""))
        times = ((F.length(held["text"]) - F.length(left)) / F.length(p["v"])).cast("int")
        return F.struct(F.replace(held["text"], p["v"], F.concat(F.lit(OPEN), p["t"], F.lit(CLOSE))).alias("text"), (held["n"] + times).alias("n"))

    return F.aggregate(pairs, first, step)


def redacted_copies(results: DataFrame) -> DataFrame:
    """(path, text, replaced) of the redacted copy of each plain-text file in which something was replaced: results of a scan
    with path, kind, text and findings. The copy's name has .geschoond before its extension."""
    rows = redacted_texts(results.filter(F.col("kind") == "tekst"), "path").filter("replaced > 0")
    path = F.when(F.col("path").rlike(r"[^/.][^/]*\.[^./]*$"), F.regexp_replace("path", r"(\.[^./]*)$", ".geschoond$1")).otherwise(F.concat("path", F.lit(".geschoond")))
    return rows.select(path.alias("path"), "text", "replaced")
