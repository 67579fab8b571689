"""Importance resampling of documents towards a target distribution, without replacement.

Words fall into hashed buckets; a bucket's gain is how much more often the target's texts have it than the documents.
A document's weight is the mean gain of its words and its score adds Gumbel noise of its id, so that the highest scores
are a weighted draw. Each task sorts the scores of the eligible documents it reads into runs; a slice of scores is
merged from the runs' blocks by a tournament tree, and ranks are given until the draw is full.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import ascii_lower, materialize

#: A word: a run of ASCII letters and digits and of what is not ASCII. A-Z are lower-cased before.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Documents taken together, and words whose bucket a worker remembers.
TOGETHER, WORDS = 512, 500_000
#: Documents of a run, of a block of a run, and (about) of a slice of scores that one task merges.
RUN, BLOCK, SLICE = 1 << 18, 4096, 1 << 20


class _Buckets(dict):
    """crc32 of a word's UTF-8 bytes modulo the number of buckets; forgets all when full."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = zlib.crc32(word.encode()) % self.buckets
        return found


def _runs_of(words: list[str], length: int) -> list[str]:
    """All runs of 1 to length consecutive words, joined by one space."""
    return words + [" ".join(words[k : k + n]) for n in range(2, length + 1) for k in range(len(words) - n + 1)]


def features(texts: DataFrame, text_col: str, buckets: int, length: int) -> DataFrame:
    """texts (text_col gone) with n_words and ``held``, the buckets of all features as little-endian 16-bit integers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    rows = texts.withColumn(text_col, ascii_lower(F.col(text_col)))
    others = [f for f in rows.schema.fields if f.name != text_col]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Buckets(buckets).__getitem__
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(begin, TOGETHER)
                held, words = [], []
                for text in piece[text_col].to_pylist():
                    found = WORD.findall(text) if text else []
                    words.append(len(found))
                    every = _runs_of(found, length) if length > 1 else found
                    held.append(np.fromiter(map(place, every), "<u2", len(every)).tobytes())
                arrays = [piece[f.name] for f in others] + [pa.array(words, pa.int64()), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in others), "n_words", "held"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(find, f"{schema}{', ' * bool(others)}n_words long, held binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs. A task sums what it reads, so at most ``buckets`` rows a task are shuffled, and
    ``buckets`` sums go to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch["held"].to_pylist():
                total += np.bincount(np.frombuffer(held, "<u2"), minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    sums = rows.select("held").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums:
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares), in doubles."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


class TournamentTree:
    """The least of several sorted sources: a complete tree whose leaves are the sources' heads (None: nothing there) and
    whose inner nodes name the winner below. Replacing a head replays one path."""

    def __init__(self):
        self.size = 1
        self.heads: list = [None]
        self.win = [0, 0]
        self.free = [0]

    def _play(self, leaf: int) -> None:
        at = (leaf + self.size) >> 1
        while at:
            a, b = (self.win[2 * at], self.win[2 * at + 1]) if 2 * at < self.size else (2 * at - self.size, 2 * at + 1 - self.size)
            x, y = self.heads[a], self.heads[b]
            self.win[at] = a if y is None or (x is not None and x <= y) else b
            at >>= 1

    def replace(self, leaf: int, head) -> None:
        self.heads[leaf] = head
        if head is None:
            self.free.append(leaf)
        self._play(leaf)

    def add(self, head) -> int:
        """The leaf of a new source; a full tree doubles."""
        if not self.free:
            self.heads += [None] * self.size
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.size *= 2
            self.win = [0] * max(2, self.size)
            for leaf in range(0, self.size, 2):
                self._play(leaf)
        leaf = self.free.pop()
        self.heads[leaf] = head
        self._play(leaf)
        return leaf

    def least(self) -> tuple:
        """(leaf, head); head None: all sources are empty."""
        leaf = self.win[1] if self.size > 1 else 0
        return leaf, self.heads[leaf]


def merged(blocks: Iterator[list[tuple]]) -> Iterator[tuple]:
    """The keys of blocks in order. Blocks are sorted lists, given in order of their first keys, so a block is opened only
    when the merge has come to it: open are about as many as there are runs."""
    tree, open_ = TournamentTree(), {}
    coming = next(blocks, None)
    while True:
        leaf, head = tree.least()
        while coming is not None and (head is None or coming[0] <= head):
            rest = iter(coming)
            own = tree.add(next(rest))
            open_[own] = rest
            coming = next(blocks, None)
            leaf, head = tree.least()
        if head is None:
            return
        yield head
        tree.replace(leaf, next(open_[leaf], None))


def draw_ranks(scored: DataFrame, draw: int, counts: list[tuple[int, int]], slice_rows: int = SLICE, run_rows: int = RUN) -> DataFrame:
    """row, rank of the ``draw`` rows of scored (row, doc_id, score) with the highest scores, ties to the smaller doc_id
    (null last), then to the smaller row. counts: (score, rows) of all scores.

    The scores are cut into slices of about slice_rows documents; a score that alone has more is cut by id as well, at
    quantiles of its ids. Slices after the draw are not written. How many documents a slice has is counted, so each
    slice knows its first rank, and the last one stops where the draw is full.
    """
    spark = scored.sparkSession
    heavy, bounds, held, total, cut = [], [], 0, 0, 0
    for key, n in sorted((-score, n) for score, n in counts):
        if total >= draw:
            break
        if held and held + n > slice_rows:
            bounds.append((key, -(2**63)))
            held = 0
        if n > slice_rows:
            heavy.append((key, -(-n // slice_rows)))
        held, total, cut = held + n, total + n, key
    eligible = scored.select((-F.col("score")).alias("key"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), "row")
    eligible = eligible.filter(F.col("key") <= cut)
    for key, n in heavy:
        ids = eligible.filter(F.col("key") == key).agg(F.percentile_approx(F.when(~F.col("no_id"), F.col("id")), [k / n for k in range(1, n)], 10 * n)).first()[0]
        bounds += [(key, b) for b in sorted(set(ids or ()))]
    bounds.sort()

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slice", "key", "no_id", "id", "row"]
        kept: list[np.ndarray] = []

        def written() -> Iterator[pa.RecordBatch]:
            key, none, ids, row = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.lexsort((row, ids, none, key))
            key, none, ids, row = key[order], none[order], ids[order], row[order]
            place = np.array([bisect_right(bounds, (k, 2**63 if no else i)) for k, no, i in zip(key.tolist(), none.tolist(), ids.tolist(), strict=True)])
            ends = [*(np.nonzero(np.diff(place))[0] + 1).tolist(), len(place)]
            begin, out = 0, []
            for end in ends:
                out += [(a, min(a + BLOCK, end)) for a in range(begin, end, BLOCK)]
                begin = end
            lists = [[c[a:b] for a, b in out] for c in (key, none, ids, row)]
            yield pa.RecordBatch.from_arrays([pa.array([place[a] for a, _ in out], pa.int64()), pa.array(lists[0], pa.list_(pa.int64())), pa.array([x.astype(bool).tolist() for x in lists[1]], pa.list_(pa.bool_())), pa.array(lists[2], pa.list_(pa.int64())), pa.array(lists[3], pa.list_(pa.int64()))], names)

        size = 0
        for batch in batches:
            kept.append(tuple(batch[n].to_numpy(zero_copy_only=False) for n in names[1:]))
            size += batch.num_rows
            if size >= run_rows:
                yield from written()
                kept, size = [], 0
        if size:
            yield from written()

    blocks = materialize(eligible.mapInArrow(sorted_runs, "slice long, key array<long>, no_id array<boolean>, id array<long>, row array<long>"), "sorted-runs")
    sizes = dict(blocks.groupBy("slice").agg(F.sum(F.size("row"))).collect())
    begins, at = {}, 0
    for k in sorted(sizes):
        begins[k], at = at, at + sizes[k]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 16):
                    yield from batch.slice(begin, 16).to_pylist()

        source = rows()
        coming = next(source, None)
        while coming is not None:
            current, out = coming["slice"], []

            def own() -> Iterator[list[tuple]]:
                nonlocal coming
                while coming is not None and coming["slice"] == current:
                    block = list(zip(coming["key"], coming["no_id"], coming["id"], coming["row"], strict=True))
                    coming = next(source, None)
                    yield block

            rank = begins[current]
            for _, _, _, row in merged(own()):
                if rank >= draw:
                    break
                rank += 1
                out.append((row, rank))
                if len(out) == 65536:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "rank"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "rank"])
            while coming is not None and coming["slice"] == current:
                coming = next(source, None)

    first = [F.element_at(c, 1) for c in ("key", "no_id", "id", "row")]
    dealt = blocks.repartition(min(max(len(sizes), 1), int(spark.conf.get("spark.sql.shuffle.partitions"))), "slice").sortWithinPartitions("slice", *first)
    return dealt.mapInArrow(merge, "row long, rank long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, length: int = 1, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", slice_rows: int = SLICE, run_rows: int = RUN,
) -> DataFrame:
    """One row for each document: doc_id, n_features, weight, score, rank (1, 2, 3 ... of the drawn, else null).

    Drawn are floor(percent * N / 100) of the N documents with at least least_words words, the highest scores first, ties
    to the smaller doc_id. Features are runs of 1 to length words. The score's noise comes from sha256 of
    ``seed:doc_id``, so reruns agree.

    Ids are integers. A null id hashes as an empty string and loses ties; rows that repeat an id are documents of their
    own, with the same noise. Null and empty texts have no features: weight 0, and a rank only where least_words is 0. An
    empty target gives gains against smoothed shares alone; empty docs give an empty result. Very long texts are read
    whole, a few at a time. Other columns are not read, so none clashes.

    What goes to the driver: two arrays of ``buckets`` counts, and the number of documents of each score, a whole number
    within 90000 of zero whatever the data. Nothing is shuffled by a value that documents share but their scores, which
    are summed where they are read.
    """
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = materialize(features(held, "text", buckets, length).withColumn("row", F.monotonically_increasing_id()), "features")
    wanted = features(target.select(F.col(target_col).alias("text")), "text", buckets, length)
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gains.value
        for batch in batches:
            found = [np.frombuffer(x, "<u2") for x in batch["held"].to_pylist()]
            weights = [int(own[x].sum()) // len(x) if len(x) else 0 for x in found]
            numbers = [pa.array([len(x) for x in found], pa.int64()), pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["n_words"], *numbers], ["doc_id", "row", "n_words", "n_features", "weight"])

    scored = held.select("doc_id", "row", "n_words", "held").mapInArrow(weigh, "doc_id long, row long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(scored.withColumn("score", F.col("weight") + noise), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    counts = [tuple(r) for r in eligible.groupBy("score").count().collect()]
    draw = percent * sum(n for _, n in counts) // 100
    result = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*result, F.lit(None).cast("long").alias("rank"))
    return scored.join(draw_ranks(eligible, draw, counts, slice_rows, run_rows), "row", "left").select(*result, "rank")
