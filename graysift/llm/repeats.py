"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are retained at minimisers: each window of min_words words chooses its word group of the least hash, the
leftmost of equals. Windows of equal words choose the same place, so two copies of a passage always retain suffixes
that face each other, and a suffix answers for the windows that chose it. Retained suffixes that begin alike are
sorted; each is compared with its neighbours to the right and extended to the left, which gives the windows that
both hold. A document's repeated passages are the unions of its windows that another document holds too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import likely_rows, materialize
from graysift.llm.ngram_join import mix, word_hashes

#: Words of the group that a minimiser is chosen by; every suffix that can match begins with the same group.
GROUP_WORDS = 10
#: Suffixes of one beginning that are sorted together (about); the windows of more are matched by their hashes too.
TOGETHER = 2000
#: Up to so many suffixes of one beginning, each is compared with all; more go by runs of equal prefixes.
NEIGHBOURS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(m - 1, b, np.uint64)]) for b in (_BASE, _INVERSE))
        return self.up, self.down


_powers = _Powers()


def minimisers(words: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """The retained suffixes of a document: key (hash of the group), context (hash of all words of its windows and
    of its place in them), position, words to the left, windows."""
    n, group = len(words), min(GROUP_WORDS, min_words)
    if n < min_words:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    up, down = _powers.get(n + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * up[:n])]
    groups = mix((sums[group:] - sums[:-group]) * down[: n - group + 1])
    view = np.lib.stride_tricks.sliding_window_view(groups, min_words - group + 1)
    at = view.argmin(axis=1) + np.arange(len(view))
    low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    high = np.r_[low[1:], len(at)]
    position, left, windows = at[low], at[low] - low, high - low
    context = (sums[high - 1 + min_words] - sums[low]) * down[low]
    context = mix(context ^ mix((left * 4096 + windows).astype(np.uint64)))
    return groups[position].view(np.int64), context.view(np.int64), position, left, windows


def _suffixes(min_words: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                piece = batch.slice(begin, 256)
                parts = [minimisers(word_hashes(t), min_words) for t in piece["text"].to_pylist()]
                doc = np.repeat(piece["doc_id"].to_numpy(), [len(p[0]) for p in parts])
                key, context, position, left, windows = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(key), pa.array(context), *(pa.array(x.astype(np.int32)) for x in (position, left, windows))], ["doc", "key", "context", "position", "left", "windows"]
                )

    return found


def _beside(min_words: int):
    """Texts with the suffixes to fetch from each -> their words to the right and (backwards) to the left."""
    names = ["key", "salt", "right", "left", "context", "windows", "least", "most", "spread"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                words = word_hashes(text).astype(">u8")
                rows = []
                for x in wanted:
                    p, low = x["position"], x["position"] - x["left"]
                    right, left = words[p : low + x["windows"] - 1 + min_words], words[low:p][::-1]
                    rows.append((x["key"], x["salt"], right.tobytes(), left.tobytes(), x["context"], x["windows"], x["least"], x["most"], x["spread"]))
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return found


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    sizes = np.array([len(v) // 8 for v in values])
    out = np.zeros((len(values), int(sizes.max(initial=0)) + 1), np.uint64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(values), ">u8")
    return out, sizes


def _common(matrix: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    differ = matrix[a] != matrix[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def _prefix_hashes(matrix: np.ndarray) -> np.ndarray:
    """Column x: hash of the first x words of each row."""
    out = np.zeros((matrix.shape[0], matrix.shape[1] + 1), np.uint64)
    for x in range(matrix.shape[1]):
        out[:, x + 1] = mix(out[:, x] ^ matrix[:, x])
    return out


def match_windows(rows: pa.Table, min_words: int) -> np.ndarray:
    """For each suffix, sorted by key, salt and words to the right, the bits of its windows that another document
    holds among these. Bit t is the window that starts t words after the suffix's first."""
    right, right_size = _matrix(rows["right"])
    left, left_size = _matrix(rows["left"])
    windows, least, most = (rows[c].to_numpy() for c in ("windows", "least", "most"))
    key, salt = rows["key"].to_numpy(), rows["salt"].to_numpy()
    new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    bits = np.zeros(len(key), np.int64)
    one = np.int64(1)

    def mark(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Windows with from low to high words to the left of the suffix."""
        first, last = np.maximum(left_size[at] - high, 0), np.minimum(left_size[at] - low, windows[at] - 1)
        some = first <= last
        np.bitwise_or.at(bits, at[some], (one << (last[some] + 1)) - (one << first[some]))

    for apart in range(1, NEIGHBOURS):
        a = np.flatnonzero(group[apart:] == group[:-apart]) if apart < len(group) else np.zeros(0, np.int64)
        a = a[size[group[a]] <= NEIGHBOURS]
        b = a + apart
        other = np.minimum(least[a], least[b]) != np.maximum(most[a], most[b])
        a, b = a[other], b[other]
        if len(a):
            low, high = np.maximum(min_words - _common(right, right_size, a, b), 0), _common(left, left_size, a, b)
            for at in (a, b):
                mark(at, low, high)
    for g in np.flatnonzero(size > NEIGHBOURS):
        at = np.flatnonzero(group == g) if len(size) < 64 else np.arange(np.searchsorted(group, g), np.searchsorted(group, g, side="right"))
        common = _common(right, right_size, at[:-1], at[1:])
        hashes = _prefix_hashes(left[at])
        for j in range(int(left_size[at].max()) + 1):
            t = left_size[at] - j
            mine = np.flatnonzero((t >= 0) & (t < windows[at]))
            if len(mine) < 2:
                continue
            run = np.cumsum(np.r_[0, common < min_words - j])[mine].astype(np.uint64)
            _, of = np.unique(mix(run) ^ hashes[mine, j], return_inverse=True)
            low, high = np.full(of.max() + 1, np.iinfo(np.int64).max), np.full(of.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, of, least[at[mine]])
            np.maximum.at(high, of, most[at[mine]])
            held = (low != high)[of]
            bits[at[mine[held]]] |= one << t[mine[held]]
    return bits


_MATCHED = "kind byte, key long, context long, bits long, window long, least long, most long"
FOUND, OPEN = 0, 1


def _match(min_words: int):
    """Sorted suffixes -> FOUND rows (key, context, bits), and for beginnings that are dealt to several tasks OPEN
    rows, one for each window (key, context, bits: the window's, window: its hash, least, most)."""

    def rows_of(kind: int, key, context, bits, window, least, most) -> pa.RecordBatch:
        columns = [np.full(len(key), kind, np.int8), key, context, bits, window, least, most]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "context", "bits", "window", "least", "most"])

    def handle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bits = match_windows(rows, min_words)
        key, context, least, most = (rows[c].to_numpy() for c in ("key", "context", "least", "most"))
        some = bits != 0
        yield rows_of(FOUND, key[some], context[some], bits[some], bits[some], least[some], most[some])
        spread = np.flatnonzero(rows["spread"].to_numpy(zero_copy_only=False))
        if len(spread):
            right, _ = _matrix(rows["right"].take(spread))
            left, left_size = _matrix(rows["left"].take(spread))
            windows, right, left = rows["windows"].to_numpy()[spread], _prefix_hashes(right), _prefix_hashes(left)
            for t in range(int(windows.max())):
                mine = np.flatnonzero(t < windows)
                j = left_size[mine] - t
                value = mix(left[mine, j] ^ mix(right[mine, min_words - j] ^ mix(key[spread[mine]].view(np.uint64) + j.astype(np.uint64))))
                at = spread[mine]
                yield rows_of(OPEN, key[at], context[at], np.full(len(at), 1 << t, np.int64), value.view(np.int64), least[at], most[at])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 8192:
                continue
            rows = pa.Table.from_batches(held)
            key, salt = rows["key"].to_numpy(), rows["salt"].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1])).max(initial=-1)) + 1
            if cut:
                yield from handle(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            n -= cut
        if n:
            yield from handle(pa.Table.from_batches(held))

    return found


def _spans(min_words: int):
    """Rows (doc, position, left, bits), sorted -> unions of windows: doc_id, start_word, n_words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, end = None, 0, -1
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for new, position, left, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = 0
                while bits:
                    skip = (bits & -bits).bit_length() - 1
                    bits >>= skip
                    t += skip
                    run = (~bits & (bits + 1)).bit_length() - 1
                    low, high = position - left + t, position - left + t + run - 1 + min_words
                    bits >>= run
                    t += run
                    if new == doc and low <= end:
                        end = max(end, high)
                        continue
                    if doc is not None:
                        out.append((doc, start, end - start))
                    doc, start, end = new, low, high
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start_word", "n_words"])
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (doc, start, end - start)], ["doc_id", "start_word", "n_words"])

    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """One row for each repeated passage: doc_id, start_word (from 0), n_words (min_words at least).

    Words are runs without ASCII white space, A-Z lower-cased. A word is in a passage if and only if it lies in
    a window of min_words words that another document holds too (words are told apart by 64-bit hashes, and windows by
    their words or 64-bit hashes of these). min_words is from 10 to 60.

    Null and empty texts and texts of fewer words have no passages. Rows with a null id are left out. Rows that repeat
    an id count as one document, so they do not make each other's passages repeated. An empty table gives an empty
    table. Copies of a suffix and its windows are one row before anything is sorted; a beginning that very many
    different suffixes share is dealt to several tasks, whose windows then meet by their hashes. Very long texts are read
    whole, one at a time. Other columns are not read, so none clashes.
    """
    if not GROUP_WORDS <= min_words <= 60:
        raise ValueError("min_words is from 10 to 60")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null and text is not null")
    rows = texts.withColumnRenamed("doc", "doc_id").mapInArrow(_suffixes(min_words), "doc long, key long, context long, position int, left int, windows int")
    suffixes = materialize(rows, "suffixes")
    contexts = suffixes.groupBy("key", "context", "left", "windows").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(F.struct("doc", "position")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    contexts = materialize(contexts, "contexts")
    keys = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.min("least").alias("l"), F.max("most").alias("m"))
    keys = materialize(keys.filter("different > 1 and l != m").select("key", "different"), "keys")
    whole = contexts.filter("least != most").select("key", "context", F.expr("shiftleft(1L, windows) - 1").alias("bits"))

    salts = F.ceil(F.col("different") / TOGETHER).cast("int")
    wanted = contexts.join(keys, "key").select(
        F.col("first.doc").alias("doc"),
        F.struct(
            "key", F.pmod(F.hash("context"), salts).alias("salt"), "context", F.col("first.position").alias("position"), "left", "windows", "least", "most", (salts > 1).alias("spread")
        ).alias("wanted"),
    )
    wanted = materialize(wanted.groupBy("doc").agg(F.collect_list("wanted").alias("wanted")), "wanted")
    beside = likely_rows(texts, "doc", wanted).join(wanted, "doc").select("text", "wanted")
    beside = beside.mapInArrow(_beside(min_words), "key long, salt int, right binary, left binary, context long, windows int, least long, most long, spread boolean")
    beside = beside.repartition("key", "salt").sortWithinPartitions("key", "salt", "right", "context")
    matched = materialize(beside.mapInArrow(_match(min_words), _MATCHED), "matched")
    several = matched.filter(F.col("kind") == OPEN)
    held = several.groupBy("window").agg(F.min("least").alias("l"), F.max("most").alias("m")).filter("l != m").select("window")
    found = whole.union(matched.filter(F.col("kind") == FOUND).select("key", "context", "bits")).union(several.join(held, "window").select("key", "context", "bits"))
    found = materialize(found.groupBy("key", "context").agg(F.bit_or("bits").alias("bits")), "found")
    rows = suffixes.join(found, ["key", "context"]).select("doc", "position", "left", "bits").distinct()
    rows = rows.repartition("doc").sortWithinPartitions("doc", "position")
    return rows.mapInArrow(_spans(min_words), "doc_id long, start_word long, n_words long")


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of their passages; what remains of a text keeps its white space. Texts without
    passages are unchanged. A document's passages are one row, bounded by its own length."""
    spans = passages.groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words"))).alias("__spans"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    within = lambda i: F.exists("__spans", lambda s: (i >= s["start_word"]) & (i < s["start_word"] + s["n_words"]))
    head = F.regexp_extract(F.col(text_col), r"^[\x20\x09-\x0D]*", 0)
    rest = F.concat(head, F.array_join(F.filter(words, lambda w, i: ~within(i)), ""))
    joined = docs.join(spans, F.col(id_col) == F.col("__doc"), "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(rest)).select(docs.columns)
