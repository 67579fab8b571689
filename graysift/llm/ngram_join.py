"""Exact Jaccard self-join of documents' word shingles by PartEnum signatures.

A document is the set of its distinct shingles (64-bit hashes); equal sets are one node, named by a 64-bit
digest. At first a share of the elements, the same of all sets, is looked up in all other sets: a set with more
elements of its own than similarity allows links with nothing and goes no further, however many passages it shares.

The sets that remain are ordered inside, elements that fewest of them have first. Of two similar sets each has the
first element that both hold among its first ones, one more than it may have apart (a prefix); sets joined by such elements
are kin, and links lie within kin. Passages of many texts stand last in that order, so they make no kin.

Kin are put into size bands so that similar sets lie in one band or two neighbouring ones, and get
signatures for their band and the next. In a band two similar sets differ in at most k elements. The hash range
is cut into n1 partitions of n2 parts: at least one partition holds at most k2 of the differences, so one of its
subsets of n2 - k2 parts is equal in both. A signature is the sum of hashes in such a subset. A small set of a band can
differ from a similar one in less than k elements, so it needs only the first of the partitions.

What kin and common signatures chain together, sketches of the sets part again before texts are compared; they only ever part sets that cannot be similar. A sketch has some bits for each difference
that similarity allows, so large sets have large ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import likely_rows, materialize
from graysift.llm.components import connected_components, join_labels

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: One in so many elements (a power of two) is looked up in other sets.
LOOKED_UP = 2
#: Elements that more sets have are all alike in the order of a prefix.
FREQUENT = 1000
#: Signature rows, or elements, that a task combines at a time before it hands them on.
BLOCK = 500_000
#: Rows of them that it hands on at once.
PART = 1 << 16
#: Nodes and (about) shingles of a block of a cluster, and shared shingles that are multiplied at a time.
BLOCK_NODES, BLOCK_SIZE, COLUMNS = 512, 1_000_000, 4096
#: Bits of a sketch for each element that similar sets may differ in, and 64-bit words that are looked at first.
SKETCH_BITS, FIRST = 8, 4
#: Sketches of a block of a cluster, and their bytes.
BLOCK_SKETCHES, SKETCH_BYTES = 32768, 1 << 23


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __init__(self, keep: int = 100_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words: runs without ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words than width make one shingle, no words none."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    found = hashes[:n]
    for k in range(1, min(width, len(hashes))):
        found = mix(found) + hashes[k : k + n]
    return np.unique(mix(found + np.uint64(min(width, len(hashes)))))


def sketch(elements: np.ndarray, n: int) -> bytes:
    """The parity of the number of elements in each of n parts (a power of two) of the hash range. Two sets differ in at
    least as many elements as their sketches differ in bits."""
    odd = np.bincount((mix(elements) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: bytes, n: int) -> bytes:
    """A sketch in fewer parts: each is the sum of the parts that fall together."""
    held = np.frombuffer(bits, np.uint8)
    while len(held) * 8 > n:
        held = held[: len(held) // 2] ^ held[len(held) // 2 :]
    return held.tobytes()


def maybe_similar(bits: np.ndarray, sizes: np.ndarray, rows: slice, columns: slice, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the pairs whose sketches allow a similarity of num / den, none lost. The columns are the
    rows (each pair once, row < column) or follow them. Both are taken in order of size, so that a run of rows meets only
    columns of a size in reach."""
    same, found = rows == columns, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    down, across = rows.start + np.argsort(sizes[rows], kind="stable"), columns.start + np.argsort(sizes[columns], kind="stable")
    a_bits, b_bits, a_size, b_size = bits[down], bits[across], sizes[down], sizes[across]
    at_once = max(16, (1 << 20) // max(1, len(across)))
    for start in range(0, len(down), at_once):
        part = slice(start, min(start + at_once, len(down)))
        low, high = np.searchsorted(b_size, (a_size[start] * num // den, a_size[part.stop - 1] * den // num + 1))
        reach = slice(max(int(low), start) if same else int(low), int(high))
        if reach.start >= reach.stop:
            continue
        limit = (a_size[part, None] + b_size[None, reach]) * (den - num) // (den + num)
        apart = np.abs(a_size[part, None] - b_size[None, reach])
        differ = np.zeros(limit.shape, np.uint16)
        for w in range(min(FIRST, bits.shape[1])):
            differ += np.bitwise_count(a_bits[part, w, None] ^ b_bits[None, reach, w])
        i, j = np.nonzero((differ <= limit) & (apart <= limit))
        most, i, j = limit[i, j], i + start, j + reach.start
        step = max(1, (1 << 20) // bits.shape[1])
        all_bits = np.concatenate([np.bitwise_count(a_bits[i[k : k + step]] ^ b_bits[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)] or [np.zeros(0, int)])
        close = all_bits <= most
        if same:
            close &= i < j
        i, j = down[i[close]], across[j[close]]
        found.append((np.minimum(i, j), np.maximum(i, j)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class PartEnum:
    """Signatures for Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int, n2: int = 2, k2: int = 1):
        self.num, self.den, self.n2, self.k2 = num, den, n2, k2
        self.subsets = np.array([[j in s for j in range(n2)] for s in combinations(range(n2), n2 - k2)], np.uint64)
        self.low, self.high = [1], [den // num]

    def band(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)
        return int(np.searchsorted(self.high, size))

    @lru_cache(maxsize=4096)  # noqa: B019
    def shape(self, tag: int) -> tuple[int, int, int]:
        """k, n1 and slack of a band. slack partitions more than needed allow a set with at most so many
        partitions that have an empty subset to leave out its empty subsets, which unrelated sets share."""
        while len(self.high) <= tag:
            self.band(self.high[-1] + 1)
        k = (self.den - self.num) * 2 * self.high[tag] // (self.den + self.num)
        base, size = k // (self.k2 + 1) + 1, self.low[max(tag - 1, 0)]
        slack = 0
        while slack < base:
            mu = (base + slack) * len(self.subsets) * math.exp(-size / (base + slack) * (self.n2 - self.k2) / self.n2)
            if slack >= mu + 4 * math.sqrt(mu):
                break
            slack += 1
        return k, base + slack, slack

    def sketch_bits(self, tag: int) -> int:
        """Bits of a sketch for comparing sets of a tag."""
        return 1 << max(6, (SKETCH_BITS * self.shape(tag)[0]).bit_length())

    def enough(self, size: int, tag: int) -> int:
        """How many of the first partitions serve a set: as the smaller of two similar sets it differs from the larger in
        at most (den - num) / num of its size, and the larger gives at least as many."""
        _, n1, slack = self.shape(tag)
        return min(n1, (self.den - self.num) * size // self.num // (self.k2 + 1) + 1 + slack)

    def signatures(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures of a set, those of its empty subsets where more partitions than the slack have one); none for
        bands where only equal sets can be similar. Two similar sets share one of the first kind unless both have
        some of the second, and then may share only one of these."""
        none = np.zeros(0, np.uint64)
        if not len(elements):
            return none, none
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ _C))])
        high, out, extra, band = elements >> np.uint64(32), [], [], self.band(len(elements))
        for tag in (band, band + 1):
            k, n1, slack = self.shape(tag)
            if not k:
                continue
            some = self.enough(len(elements), tag)
            part = (high * np.uint64(n1 * self.n2)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(some * self.n2 + 1, dtype=np.uint64))
            parts = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(some, self.n2)
            sizes = np.diff(cuts).reshape(some, self.n2).astype(np.uint64)
            held = parts @ self.subsets.T
            names = np.arange(some * len(self.subsets), dtype=np.uint64).reshape(some, -1) + np.uint64(tag << 40)
            found = mix(held ^ mix(names))
            empty = (sizes @ self.subsets.T) == 0
            out.append(found[~empty])
            if np.count_nonzero(empty.any(axis=1)) > slack:
                extra.append(found[empty])
        return np.concatenate(out) if out else none, np.concatenate(extra) if extra else none


def digest(elements: np.ndarray) -> np.uint64:
    """The name of the node of a set."""
    return np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes()))


def looked_up(elements: np.ndarray) -> np.ndarray:
    """The elements of a set that are looked up in other sets; an element is taken from all sets or from none."""
    return elements[elements & np.uint64(LOOKED_UP - 1) == 0]


def least_shared(size: int, n_looked_up: int, num: int, den: int) -> int:
    """How many of the looked up elements of a set other sets must have if one of these is similar: a similar set lacks at
    most (den - num) / den of its elements."""
    return n_looked_up - (den - num) * size // den


def _first(keys: np.ndarray) -> np.ndarray:
    """Where each run of sorted keys starts, for every row."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


_LOOKED_UP = "kind byte, key long, node long, doc_id long, size long, shared long"
ROW, ELEMENT, SHARED = 0, 1, 2


def _looked_up_rows(kind: int, key, node, doc_id=None, size=None, shared=None) -> pa.RecordBatch:
    columns = [pa.nulls(len(key), pa.int64()) if c is None else c if isinstance(c, pa.Array) else pa.array(np.asarray(c).astype(np.int64)) for c in (key, node, doc_id, size, shared)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), *columns], ["kind", "key", "node", "doc_id", "size", "shared"])


def _in_parts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in batches that take little room where Spark reads them."""
    for begin in range(0, rows.num_rows, PART):
        yield rows.slice(begin, PART)


def _shared_rows(node: np.ndarray) -> pa.RecordBatch:
    node, times = np.unique(node, return_counts=True)
    return _looked_up_rows(SHARED, mix(node.astype(np.uint64)), node, shared=times)


def _element_rows(width: int, num: int, den: int):
    """Rows of one kind each: ROW (a document's node, doc_id, set size and in shared what least_shared says), ELEMENT (key = an
    element looked up, and the node that has it, null if several of this block have it) and SHARED (a node, and how many
    of its elements other nodes of this block have)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements, nodes, held, seen = [], [], 0, set()

        def combined() -> Iterator[pa.RecordBatch]:
            key, node = np.concatenate(elements), np.concatenate(nodes)
            order = np.argsort(key)
            key, node = key[order], node[order]
            seed = np.concatenate([[True], key[1:] != key[:-1]])
            alone = seed & np.concatenate([seed[1:], [True]])
            at = np.flatnonzero(seed)
            at = at[np.argsort(node[at], kind="stable")]  # rows of one node together are fewer bytes to shuffle
            yield from _in_parts(_looked_up_rows(ELEMENT, key[at], pa.array(node[at].view(np.int64), mask=~alone[at])))
            if not alone.all():
                yield from _in_parts(_shared_rows(node[~alone]))

        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                piece = batch.slice(begin, 512)
                ids, sizes, least = [], [], []
                for text in piece["text"].to_pylist():
                    whole = shingle_set(text, width)
                    some, node = looked_up(whole), digest(whole)
                    ids.append(node)
                    sizes.append(len(whole))
                    least.append(least_shared(len(whole), len(some), num, den))
                    if node in seen or not len(some):
                        continue
                    seen.add(node)
                    elements.append(some)
                    nodes.append(np.full(len(some), node, np.uint64))
                    held += len(some)
                    if held >= BLOCK:
                        yield from combined()
                        elements, nodes, held, seen = [], [], 0, set()
                node = np.array(ids, np.uint64)
                yield _looked_up_rows(ROW, mix(node ^ mix(np.arange(len(node), dtype=np.uint64))), node, piece["doc_id"], sizes, least)
        if held:
            yield from combined()

    return found


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ELEMENT rows, sorted by key, as SHARED rows of the nodes whose element other nodes have too; others as they are."""
    key, node, several = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    held, n_held = [], 0

    def shared(upto: int) -> np.ndarray:
        if not upto:
            return node[:0]
        first = _first(key[:upto])
        starts = np.flatnonzero(first == np.arange(upto))
        common = np.logical_or.reduceat(several[:upto] | (node[:upto] != node[first]), starts)
        return node[:upto][np.repeat(common, np.diff(np.append(starts, upto))) & ~several[:upto]]

    for batch in batches:
        kind = batch["kind"].to_numpy()
        if (kind != ELEMENT).any():
            yield batch.filter(pa.array(kind != ELEMENT))
            batch = batch.filter(pa.array(kind == ELEMENT))
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch["key"].to_numpy()])
        node = np.concatenate([node, batch["node"].fill_null(0).to_numpy()])
        several = np.concatenate([several, batch["node"].is_null().to_numpy(zero_copy_only=False)])
        upto = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        held.append(shared(upto))
        n_held += len(held[-1])
        key, node, several = key[upto:], node[upto:], several[upto:]
        if n_held >= BLOCK:
            yield from _in_parts(_shared_rows(np.concatenate(held)))
            held, n_held = [], 0
    held.append(shared(len(key)))
    if sum(map(len, held)):
        yield from _in_parts(_shared_rows(np.concatenate(held)))


_HELD, _TIMES = "element long, node long, size long", "element long, node long, size long, times int"


def _whole_rows(width: int):
    """(element, node, size) for every element of the sets of texts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                sets = [x for x in (shingle_set(t, width) for t in batch["text"].slice(begin, 512).to_pylist()) if len(x)]
                if sets:
                    size = np.array([len(x) for x in sets], np.int64)
                    columns = [np.concatenate(sets).view(np.int64), np.repeat(np.array([digest(x) for x in sets], np.uint64).view(np.int64), size), np.repeat(size, size)]
                    yield from _in_parts(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["element", "node", "size"]))

    return found


def _runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by key, cut so that no run of a key is, unless it has over most rows; runs with at least
    most rows come by themselves."""
    held, names = None, []
    for batch in batches:
        names = batch.schema.names
        new = [c.to_numpy() for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        keys = held[names.index(key)]
        if not len(keys):
            continue
        upto = int(np.searchsorted(keys, keys[-1]))
        if upto:
            yield [c[:upto] for c in held]
            held = [c[upto:] for c in held]
        if most and len(held[0]) >= 2 * most:  # what is left is still a long run
            yield [c[:-most] for c in held]
            held = [c[-most:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(element, node, size), sorted by element, with times: in how many rows the element is, FREQUENT at most. Rows of
    elements that one node alone has are left out."""
    for element, node, size in _runs(batches, "element", FREQUENT):
        first = _first(element)
        starts = np.flatnonzero(first == np.arange(len(element)))
        lengths = np.diff(np.append(starts, len(element)))
        times = np.minimum(lengths, FREQUENT)
        common = np.logical_or.reduceat(node != node[first], starts) | (times == FREQUENT)
        some = np.repeat(common, lengths)
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (element, node, size, np.repeat(times, lengths).astype(np.int32))], ["element", "node", "size", "times"])


def _prefixes(num: int, den: int):
    """(element, node, size, times), sorted by node, times and element -> (element, node): the prefix of each node, without
    elements that it alone has. These come first of all, so a node with too many of them has no rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for element, node, size, _ in _runs(batches, "node"):
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (element[1:] != element[:-1])])
            element, node, size = element[new], node[new], size[new]
            first = _first(node)
            held = np.diff(np.append(np.flatnonzero(first == np.arange(len(node))), len(node)))
            alone = size - np.repeat(held, held)
            some = np.arange(len(node)) - first + alone <= (den - num) * size // den
            yield pa.RecordBatch.from_arrays([pa.array(element[some]), pa.array(node[some])], ["element", "node"])

    return found


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id nodes name, and about one in seventy of the others (one in eight passes a look-up)."""
    again = F.xxhash64("doc_id", F.lit("again")).alias("again")
    rows = likely_rows(texts, "doc_id", nodes).select("*", again)
    return likely_rows(rows, "again", nodes.select(again)).drop("again")


def kin(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, kin): the sets of texts that prefixes join with others; similar ones have one kin."""
    rows = texts.mapInArrow(_whole_rows(width), _HELD).repartition("element").sortWithinPartitions("element")
    rows = rows.mapInArrow(_counted, _TIMES).repartition("node").sortWithinPartitions("node", "times", "element")
    rows = materialize(rows.mapInArrow(_prefixes(num, den), "element long, node long"), "prefixes")
    least = rows.groupBy("element").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least != most").drop("most")
    found = connected_components(rows.join(least, "element").filter("node != least").select("node", "least"), "node", "least")
    return materialize(found.withColumnsRenamed({"id": "node", "component": "kin"}), "kin")


def _rows(kind: int, key, a, b, sig, bits=None) -> pa.RecordBatch:
    n = len(a)
    bits = pa.nulls(n, pa.binary()) if bits is None else pa.array(bits, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *(pa.array(np.asarray(x).astype(np.int64)) if not isinstance(x, pa.Array) else x for x in (key, a, b, sig)), bits], ["kind", "key", "a", "b", "sig", "bits"])


_SCHEMA = "kind byte, key long, a long, b long, sig long, bits binary"
DOC, SEED, MEMBER, EXTRA = 0, 1, 2, 3


def _signature_rows(width: int, num: int, den: int):
    """Rows of one kind each: DOC (a node, b doc_id, sig set size, bits sketch), SEED (key = sig, a node: the first node of a
    signature in this block), MEMBER (a node, b the first node, sig) and EXTRA (key = sig of an empty subset, a node)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum, sigs, nodes, held, seen = PartEnum(num, den), [], [], 0, set()

        def combined() -> Iterator[pa.RecordBatch]:
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            order = np.lexsort((node.view(np.int64), sig))
            sig, node = sig[order], node[order]
            first = _first(sig)
            seed = first == np.arange(len(sig))
            member = ~seed & (node != node[first])
            at = np.flatnonzero(seed)
            at = at[np.argsort(node[at], kind="stable")]  # rows of one node together are fewer bytes to shuffle
            yield from _in_parts(_rows(SEED, sig[at], node[at], pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())))
            if member.any():
                yield from _in_parts(_rows(MEMBER, mix(node[member]), node[member], node[first][member], sig[member]))

        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                piece = batch.slice(begin, 512)
                ids, sizes, bits, extra = [], [], [], []
                for text in piece["text"].to_pylist():
                    elements = shingle_set(text, width)
                    node = digest(elements)
                    ids.append(node)
                    sizes.append(len(elements))
                    bits.append(sketch(elements, enum.sketch_bits(enum.band(len(elements)) + 1)) if len(elements) else b"")
                    if node in seen or not len(elements):
                        continue
                    seen.add(node)
                    got, empty = enum.signatures(elements)
                    extra += [(x, node) for x in empty]
                    sigs.append(got)
                    nodes.append(np.full(len(got), node, np.uint64))
                    held += len(got)
                    if held >= BLOCK:
                        yield from combined()
                        sigs, nodes, held, seen = [], [], 0, set()
                if extra:
                    keys, owners = (np.array(c, np.uint64) for c in zip(*extra, strict=True))
                    yield _rows(EXTRA, keys, owners, pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()))
                node = np.array(ids, np.uint64)
                yield _rows(DOC, mix(node ^ mix(np.arange(len(node), dtype=np.uint64))), node, piece["doc_id"], np.array(sizes), bits)
        if held:
            yield from combined()

    return found


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEED rows, sorted by key, as MEMBER rows of the first node of their signature; others as they are."""
    last_key, last_node = None, None
    for batch in batches:
        kind = batch["kind"].to_numpy()
        if (kind != SEED).any():
            rest = batch.filter(pa.array(kind != SEED))
            yield rest
            batch = batch.filter(pa.array(kind == SEED))
        if not batch.num_rows:
            continue
        key, node = batch["key"].to_numpy(), batch["a"].to_numpy()
        first = node[_first(key)]
        if last_key is not None:
            first = np.where(key == last_key, last_node, first)
        last_key, last_node = key[-1], first[-1]
        member = first != node
        if member.any():
            yield _rows(MEMBER, key[member], node[member], first[member], key[member])


def _banded(num: int, den: int):
    """Rows (cluster, node, size, bits) once for the band of their size and once for the next, as (..., tag)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum = PartEnum(num, den)
        for batch in batches:
            band = np.array([enum.band(n) for n in batch["size"].to_pylist()], np.int64)
            for tag in (band, band + 1):
                bits = [folded(b, enum.sketch_bits(t)) for b, t in zip(batch["bits"].to_pylist(), tag.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["cluster"], batch["node"], batch["size"], pa.array(bits, pa.binary()), pa.array(tag)], ["cluster", "node", "size", "bits", "tag"])

    return found


def _part(num: int, den: int):
    """Rows (cluster, tag, left, right, block, node, size, bits), sorted by the first five -> (node, with): the least
    node that a node is joined with here by sketches that allow the similarity."""

    def one(left: int, right: int, rows: list) -> pa.RecordBatch:
        blocks, nodes, sizes, bits = zip(*rows, strict=True)
        node, size = np.array(nodes, np.int64), np.array(sizes, np.int64)
        held = np.frombuffer(b"".join(bits), np.uint64).reshape(len(rows), -1)
        cut = len(rows) if left == right else int(np.searchsorted(blocks, right))
        i, j = maybe_similar(held, size, slice(0, cut), slice(0 if left == right else cut, len(rows)), num, den) if cut else ([], [])
        label = np.arange(len(rows))
        join_labels(label, np.asarray(i, np.int64), np.asarray(j, np.int64))
        some = label != np.arange(len(rows))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]])], ["node", "with"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for *new, block, node, size, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if new != key:
                    if len(held) > 1:
                        yield one(*key[2:], held)
                    key, held = new, []
                held.append((block, node, size, bits))
        if len(held) > 1:
            yield one(*key[2:], held)

    return found


def parted(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Clusters (cluster, node, size, bits) parted where sketches rule out every link: nodes that stand alone are left out.

    Similar sets lie in one size band or two neighbouring ones, so a cluster is compared band by band, in pairs of
    blocks of about BLOCK_SKETCHES nodes and SKETCH_BYTES; of each pair come at most as many rows as it has nodes.
    """
    rows = materialize(rows.mapInArrow(_banded(num, den), "cluster long, node long, size long, bits binary, tag long"), "sketches")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SKETCHES), F.ceil(F.sum(F.octet_length("bits")) / SKETCH_BYTES)).cast("long")
    sizes = materialize(rows.groupBy("cluster", "tag").agg(blocks.alias("blocks")), "sketch-blocks")
    rows = rows.join(sizes, ["cluster", "tag"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", "tag", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "size", "bits")
    rows = rows.repartition("cluster", "tag", "left", "right").sortWithinPartitions("cluster", "tag", "left", "right", "block", "node")
    joined = materialize(rows.mapInArrow(_part(num, den), "node long, with long"), "parted")
    return connected_components(joined, "node", "with")


def intersections(sets: list[np.ndarray], rows: slice, columns: slice) -> np.ndarray:
    """Sizes of the intersections of two runs of sets, as products of their incidence over COLUMNS shared elements
    at a time. Elements that only one set holds are left out."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, at = owner[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(sets[rows]), len(sets[columns])), np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        low, high = np.searchsorted(at, (start, start + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[low:high], at[low:high] - start] = 1
        total += held[rows] @ held[columns].T
    return total.astype(np.int64)


def _compare(width: int, num: int, den: int):
    """Rows (cluster, left, right, block, node, copies, home, text), sorted by the first four -> (node, links, with,
    pair). In a cluster: how many documents a node links to in this pair of blocks, and the least node that it is
    joined with here. Of an empty subset: each link between nodes of different homes, both ways, as a pair, since
    other subsets may find it too."""

    def one(blocks: list, left: int, right: int, nodes: list, copies: list, homes: list, texts: list) -> pa.RecordBatch:
        first = dict.fromkeys(nodes)
        if len(first) < len(nodes):  # rows that repeat an id
            keep = list({n: k for k, n in reversed(list(enumerate(nodes)))}.values())[::-1]
            blocks, nodes, copies, homes, texts = ([x[k] for k in sorted(keep)] for x in (blocks, nodes, copies, homes, texts))
        node, n_docs = np.array(nodes, np.int64), np.array(copies, np.int64)
        sets = [shingle_set(t, width) for t in texts]
        cut = len(sets) if left == right else int(np.searchsorted(blocks, right))
        rows, columns = slice(0, cut), slice(0 if left == right else cut, len(sets))
        sizes = np.array([len(x) for x in sets], np.int64)
        both = intersections(sets, rows, columns)
        i, j = np.nonzero(both * den >= (sizes[rows, None] + sizes[None, columns] - both) * num)
        j = j + columns.start
        i, j = i[i < j], j[i < j]
        names = ["node", "links", "with", "pair"]
        if homes[0] is not None:
            home = np.array(homes, np.int64)
            i, j = i[home[i] != home[j]], j[home[i] != home[j]]
            a, b = np.concatenate([i, j]), np.concatenate([j, i])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], n_docs[b], node[b], np.ones(len(a), bool))], names)
        links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
        np.add.at(links, i, n_docs[j])
        np.add.at(links, j, n_docs[i])
        join_labels(label, i, j)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[some], links[some], node[label[some]], np.zeros(int(some.sum()), bool))], names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for *new, block, node, copies, home, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if new != key:
                    if len(held) > 1:
                        yield one([h[0] for h in held], *key[1:], *([h[k] for h in held] for k in (1, 2, 3, 4)))
                    key, held = new, []
                held.append((block, node, copies, home, text))
        if len(held) > 1:
            yield one([h[0] for h in held], *key[1:], *([h[k] for h in held] for k in (1, 2, 3, 4)))

    return found


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, links): each row's doc_id, n_shingles and node; the nodes (different sets) with a doc_id
    and the number of their documents; and links summed up (node, links, with), see _compare.

    Nodes with too many elements of their own go first, then those without kin. Nodes of one kin that share a signature are
    joined into clusters, by one edge from each node to the first of a signature. All links lie within clusters, also after
    sketches have parted these. A cluster is compared in pairs of blocks of at most BLOCK_NODES nodes and about
    BLOCK_SIZE shingles, each pair in one task that counts links and joins classes, so a large cluster is spread
    and its pairs are never rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_element_rows(width, num, den), _LOOKED_UP)
    rows = rows.repartition("key").sortWithinPartitions("key")  # one long: sorted by radix
    found = materialize(rows.mapInArrow(_met, _LOOKED_UP), "looked-up")
    documents = found.filter(F.col("kind") == ROW).select("doc_id", F.col("size").alias("n_shingles"), "node", F.col("shared").alias("least"))
    nodes = documents.filter("n_shingles > 0 and doc_id is not null").groupBy("node")
    nodes = nodes.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"), F.max("least").alias("least"))
    shared = found.filter(F.col("kind") == SHARED).groupBy("node").agg(F.sum("shared").alias("shared"))
    nodes = nodes.join(shared, "node", "left").withColumn("open", F.coalesce("shared", F.lit(0)) >= F.col("least"))
    documents, nodes = documents.drop("least"), materialize(nodes.drop("least", "shared"), "nodes")
    open_nodes = nodes.filter("open").drop("open")
    open_nodes = materialize(open_nodes.join(kin(_texts_of(texts, open_nodes), width, num, den), "node"), "open-nodes")
    rows = _texts_of(texts, open_nodes).mapInArrow(_signature_rows(width, num, den), _SCHEMA)
    rows = rows.repartition("key").sortWithinPartitions("key")  # any node may stand for a signature
    found = materialize(rows.mapInArrow(_memberships, _SCHEMA), "signatures")
    bits = found.filter((F.col("kind") == DOC) & F.col("b").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.max("bits").alias("bits"))
    cluster = connected_components(found.filter(F.col("kind") == MEMBER).select("a", "b"))
    cluster = cluster.withColumnsRenamed({"id": "node", "component": "cluster"}).join(open_nodes, "node")
    cluster = materialize(cluster.withColumn("cluster", F.xxhash64("cluster", "kin")).join(bits, "node").select("cluster", "node", "size", "bits"), "chained")
    cluster = parted(cluster, num, den)
    cluster = materialize(cluster.withColumnsRenamed({"id": "node", "component": "cluster"}), "homes")
    # Nodes that share an empty subset are compared by themselves: as edges they would join unrelated clusters.
    extra = found.filter(F.col("kind") == EXTRA).select(F.col("key").alias("cluster"), F.col("a").alias("node")).distinct()
    extra = extra.join(open_nodes.select("node", "kin"), "node").select(F.xxhash64("cluster", "kin").alias("cluster"), "node")
    several = extra.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    extra = extra.join(several, "cluster").join(cluster.withColumnRenamed("cluster", "home"), "node", "left")
    extra = extra.select("node", "cluster", F.coalesce("home", "node").alias("home"))
    members = cluster.select("node", "cluster", F.lit(None).cast("long").alias("home")).union(extra)
    members = materialize(members.join(open_nodes.drop("kin"), "node"), "clusters")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_SIZE)).cast("long")
    sizes = materialize(members.groupBy("cluster").agg(blocks.alias("blocks")), "cluster-sizes")
    members = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = members.select("doc_id", "node", "copies", "home", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left, right = F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    needed = materialize(pairs.select("doc_id", "node", "copies", "home", "cluster", "block", left, right), "needed")
    rows = likely_rows(texts, "doc_id", needed).join(needed, "doc_id").select("cluster", "left", "right", "block", "node", "copies", "home", "text")
    rows = rows.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "block", "node")
    links = materialize(rows.mapInArrow(_compare(width, num, den), "node long, links long, with long, pair boolean"), "links")
    links = links.filter("not pair").union(links.filter("pair").distinct())
    return documents, nodes, links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of
    Jaccard similarity >= num / den, itself included) and n_links (other documents linked directly, copies too).

    Null and empty texts and texts of white space have no shingles, link with nothing and are their own
    component. Rows that repeat an id come back each. Rows with a null id link with nothing (component_id
    null). Ids are taken to be unique up to repeated rows. An empty table gives an empty table. Very long texts are
    read whole. Other columns are not read, so names that clash do no harm. Shingles, sets and signatures are told apart
    by 64-bit hashes.
    """
    documents, nodes, links = jaccard_links(docs, id_col, text_col, width, num, den)
    component = connected_components(links, "node", "with").withColumnRenamed("id", "node")
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = nodes.join(sums, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = materialize(nodes, "node-components")
    least = materialize(nodes.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = materialize(nodes.join(least, "component").select("node", "component_id", n_links), "named")
    # Rows without shingles or id all have one node, or one id: they need no join, and would meet in one task of it.
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = documents.filter(own).join(named, "node").select("doc_id", "n_shingles", "component_id", "n_links")
    return rows.union(documents.filter(~own).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
