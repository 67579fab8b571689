"""Packing documents into sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so counts by length describe an instance of any size. The driver
solves the packing on these counts (at most ``capacity`` of them) and gets a plan: runs of equal sequences.
Executors then number the pieces of each length and look their places up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graysift.llm.common import materialize
from graysift.llm.tokens import BYTE_BPE, MEMORY, encoder, portions, vocabulary_path

CAPACITY = 2048


class _Counts:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, k: int, without: int) -> int | None:
        """The sum of the k smallest pieces when one piece of length ``without`` is set aside."""
        total = 0
        for s in self.sizes:
            m = min(k, self.n[s] - (s == without))
            total, k = total + m * s, k - m
            if not k:
                return total
        return None

    def largest(self, most: int, without: int = 0) -> int | None:
        """The largest length up to ``most``, one piece of length ``without`` set aside."""
        i = bisect_right(self.sizes, most) - 1
        if i >= 0 and self.sizes[i] == without and self.n[without] == 1:
            i -= 1
        return self.sizes[i] if i >= 0 else None


def _best_pair(left: _Counts, room: int, size: int) -> int:
    """The largest sum of two other pieces that fits in room."""
    best, sizes = 0, left.sizes
    low, high = 0, bisect_right(sizes, room) - 1
    while low <= high:
        a, b = sizes[low], sizes[high]
        need = left.n[a] - (a == size) if a != b else (left.n[a] - (a == size)) // 2
        if need < 1 and a == b:
            break
        if left.n[a] - (a == size) < 1:
            low += 1
        elif left.n[b] - (b == size) < 1 or a + b > room:
            high -= 1
        else:
            best = max(best, a + b)
            low += 1
    return best


def dominance_reduction(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some best packing holds, as (lengths, how many), and the counts that are left.

    Martello and Toth: a set with the largest piece is fixed if it dominates every other set that holds that
    piece, that is, if any such set's other pieces could change places with the fixed ones. With room the rest
    of the sequence: (1) nothing else fits: alone; (2) a piece fills the room exactly; (3) no two others fit,
    or of at most two the best pair is no longer than the longest single: with the longest that fits;
    (4) at most two fit and the longest single leaves room for a second that no other pair's shorter piece
    exceeds: with both. Each fixed set shrinks the instance and may make a further one possible.
    """
    left, fixed = _Counts(counts), []
    for size in sorted(left.n, reverse=True):
        while left.n.get(size):
            c, room = left.n[size], capacity - size
            other = left.largest(room, size)
            if other is None:
                fixed.append(((size,), c))
                left.take(size, c)
                continue
            if other == room:
                k = c // 2 if other == size else min(c, left.n[other])
                fixed.append(((size, other), k))
                left.take(size, k)
                left.take(other, k)
                continue
            three, two = left.smallest(3, size), left.smallest(2, size)
            single = two is None or two > room
            double = three is None or three > room
            if single or (double and _best_pair(left, room, size) <= other):
                k = c // 2 if other == size else min(c, left.n[other])
                fixed.append(((size, other), k))
                left.take(size, k)
                left.take(other, k)
                continue
            if double:
                aside = _Counts({s: n - (s == size) - (s == other) for s, n in left.n.items()})
                second, half = aside.largest(room - other), left.largest(room // 2, size)
                if second is not None and half is not None and half <= second:
                    chosen = Counter((size, other, second))
                    k = min(left.n[s] // m for s, m in chosen.items())
                    fixed.append(((size, other, second), k))
                    for s, m in chosen.items():
                        left.take(s, k * m)
                    continue
            break
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: each step fills as many equal sequences alike as it can."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(lengths: tuple[int, ...], k: int, room: int) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([lengths, k])

    for size in sorted(counts, reverse=True):
        c = counts[size]
        while c:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = min(c, capacity // size)
                k, lengths, room = c // per, (size,) * per, capacity - per * size
            else:
                room = rooms[i]
                before, n = open_[room][-1]
                per = min(c, room // size)
                k = min(n, c // per)
                if k < n:
                    open_[room][-1][1] -= k
                else:
                    open_[room].pop()
                    if not open_[room]:
                        del open_[rooms.pop(i)]
                lengths, room = before + (size,) * per, room - per * size
            c -= k * per
            put(lengths, k, room)
    return [(lengths, k) for stack in open_.values() for lengths, k in stack]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """The whole plan: runs (lengths, how many sequences). Reduction repeats while it shrinks the instance."""
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    runs: list[tuple[tuple[int, ...], int]] = []
    while True:
        fixed, counts = dominance_reduction(counts, capacity)
        runs += fixed
        if not fixed:
            return runs + best_fit(counts, capacity)


def _places(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of places."""
    places: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for lengths, k in runs:
        offset = 0
        for size in lengths:
            places.setdefault(size, []).append((used[size], base, offset))
            used[size] += k
            offset += size
        base += k
    return {s: tuple(np.array(x, np.int64) for x in zip(*p, strict=True)) for s, p in places.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with columns doc_id, piece and length (1 to capacity).

    Pieces of one length are alike to the plan; a rank among them tells each its place. Ranks are counted
    within salts of a length and shifted by the salts before, so that a frequent length is spread. The plan
    on the driver has at most ``capacity`` lengths, whatever the table holds. An empty table stays empty.
    """
    spark = pieces.sparkSession
    salts = max(64, pieces.count() // 100_000)
    pieces = pieces.drop("sequence_id", "offset")
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__rank", (F.row_number().over(within) - 1).cast("long")).join(shifts, ["length", "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__rank") + F.col("__shift")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["__rank"].to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for rows in np.split(order, cuts[1:]) if len(order) else []:
                first, base, offsets = places.value[int(lengths[rows[0]])]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = base[k] + ranks[rows] - first[k], offsets[k]
            columns = [batch[c] for c in batch.schema.names if c != "__rank"]
            names = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, memory: int = MEMORY
) -> DataFrame:
    """The documents as pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and,
    with keep_ids, ids (little-endian unsigned 32-bit). Only longer documents are cut; all their pieces but
    the first are full. A document ends with end_id, so even a null or empty text gives one piece."""
    vocabulary = vocabulary or vocabulary_path(BYTE_BPE)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in portions(batch):
                rows: list[tuple] = []
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder(vocabulary, memory).encode(part["text"].to_pylist()), strict=True):
                    ids += end
                    n, start, piece = len(ids) // 4, 0, 0
                    length = n % capacity or capacity
                    while start < n:
                        data = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, piece, start, length, zlib.crc32(data), data))
                        start, piece, length = start + length, piece + 1, capacity
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[i], t) for i, t in enumerate(types)], names[: len(types)])
                pa.default_memory_pool().release_unused()  # else a worker that serves other stages later keeps the room of its largest piece

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """token_pieces() with their places. The pieces are written to the shared folder once, as counting,
    ranking and placing each read them.

    Null text: one piece of one token. Null ids are packed like others. Rows that repeat an id are packed
    each. An empty table gives an empty table. Very long texts are encoded whole, one at a time. Columns of the input other
    than id and text are not carried, so none clashes.
    """
    return pack(materialize(token_pieces(docs, capacity=capacity, **options), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves (needs keep_ids): sequence_id, n_tokens, ids, at most capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
