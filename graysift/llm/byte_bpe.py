"""Byte-level BPE over padded matrices of token ids, for a file of ranks.

A text falls into units at spaces and these into pieces by the vocabulary's public pattern; a worker remembers the ids of
units that it met lately. New pieces of about the same length become the rows of a
matrix, padded to the bucket's width; in each round every row merges its leftmost pair of least rank, pairs being
looked up in a hash table, and closes the gap. Rows that have nothing left to merge leave the matrix.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graysift.llm.tokens import MARKS, units, vocabulary_path

RANKS = "byte_bpe_50k.tiktoken"
#: Cells of a matrix, texts and characters taken together, and units that a worker remembers (about 200 bytes each).
CELLS, TEXTS, TEXT_BYTES, MEMORY = 1 << 20, 1024, 1 << 23, 400_000
#: Texts that are decoded together.
DECODED = 128
#: Longer units are not remembered, and longer pieces may merge equal pairs at several places in a round.
LONG = 64
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


_LITTLE = struct.Struct("<i").pack


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Open addressing over (left id, right id) -> rank of the joined bytes, looked up for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs) + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.found = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._place(keys)
        while len(keys):  # all keys try their place; those that find it taken go one further
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.found[at[own]] = ranks[own]
            keys, ranks, at = keys[~own], ranks[~own], (at[~own] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no such token or an id is negative (padding)."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        keys[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.found[at], _NONE)
        open_ = np.nonzero((held != keys) & (held >= 0) & (keys >= 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.found[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out.reshape(left.shape)


def _widths(lengths: np.ndarray) -> np.ndarray:
    """The buckets of pieces by their bytes: at most a fifth of a row is padding, but for the shortest."""
    step = 1 << np.maximum(0, np.frexp(lengths.astype(np.float64))[1] - 3)
    return -(-lengths // step) * step


class ByteBPE:
    """encode(texts) -> ids of each text as an int32 array; decode(ids) -> bytes. Ranks are ids; every byte has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = MEMORY):
        import regex

        self.ranks, self.keep, self.spaced = ranks, keep, pattern == public_pattern()
        self.cut = regex.compile(pattern).findall
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Ids of units with the space before them, young and old; of words with a space, of marks, of other pieces.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> PairTable:
        """All pairs of tokens whose bytes together are a token."""
        get = self.ranks.get
        return PairTable({a << 32 | b: r for w, r in self.ranks.items() for k in range(1, len(w)) if (a := get(w[:k])) is not None and (b := get(w[k:])) is not None})

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all tokens one after the other, where each id's begin, how many they are; -1: no such id)."""
        starts, sizes = np.zeros(max(self.ranks.values()) + 1, np.int64), np.full(max(self.ranks.values()) + 1, -1, np.int64)
        at = 0
        for token, rank in self.ranks.items():
            starts[rank], sizes[rank] = at, len(token)
            at += len(token)
        return np.frombuffer(b"".join(self.ranks), np.uint8), starts, sizes

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces by merging, rows of one width together; as little-endian 32-bit bytes."""
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = _widths(lengths)
        order = np.argsort(widths, kind="stable")
        cuts = np.nonzero(np.diff(widths[order]))[0] + 1
        for own in np.split(order, cuts):
            width = int(widths[own[0]]) if len(own) else 0
            for begin in range(0, len(own), max(1, CELLS // max(1, width))):
                part = own[begin : begin + max(1, CELLS // max(1, width))]
                names = part.tolist()
                matrix = np.full((len(part), width), -1, np.int32)
                matrix[np.arange(width)[None, :] < lengths[part, None]] = self.bytes[np.frombuffer(b"".join([pieces[k] for k in names]), np.uint8)]
                self._rounds(matrix, names, out)
        return out

    def _rounds(self, ids: np.ndarray, names: list[int], out: list) -> None:
        """Merges until no row has a pair; the ids of row k go to out[names[k]]."""
        row = np.array(names)
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), _NONE)
            done = least == _NONE
            if done.any():
                ended = ids[done]
                held = ended >= 0
                flat, to = ended[held].astype("<i4").tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
                for k, a, b in zip(row[done].tolist(), [0, *to], to):
                    out[k] = flat[a:b]
                row, ids, ranks, at, least = row[~done], ids[~done], ranks[~done], at[~done], least[~done]
                if not len(row):
                    break
            merge = self._equal_pairs if ids.shape[1] > LONG else self._one_pair
            ids, ranks = merge(ids, ranks, at, least)

    def _one_pair(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row merges the pair at its place; what follows moves up. Only the two new pairs are looked up."""
        n = np.arange(len(ids))
        columns = np.arange(ids.shape[1] - 1)
        source = columns[None, :] + (columns[None, :] > at[:, None])
        ids[n, at] = least
        ids = np.take_along_axis(ids, source, axis=1)
        padded = np.concatenate([ranks, np.full((len(ids), 1), _NONE, np.int32)], axis=1)
        ranks = np.take_along_axis(padded, source, axis=1)[:, :-1]
        if ranks.shape[1]:
            before = np.maximum(at - 1, 0)
            ranks[n, before] = self.pairs.ranks(ids[n, before], ids[n, before + 1])
            inside = at < ranks.shape[1]
            ranks[n[inside], at[inside]] = self.pairs.ranks(ids[n[inside], at[inside]], ids[n[inside], at[inside] + 1])
        wide = int((ids >= 0).sum(axis=1).max())
        return ids[:, :wide], ranks[:, : max(0, wide - 1)]

    def _equal_pairs(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row merges all its pairs of least rank from the left, unless a merge makes a pair of lower rank, which would
        come before the rest: such a row merges the leftmost only. Either way its ids end the same."""
        new_rows = []
        for k in range(len(ids)):
            own = ids[k, : np.count_nonzero(ids[k] >= 0)]
            same = np.nonzero(ranks[k, : len(own) - 1] == least[k])[0]
            if len(same) > 1:  # of places next to each other every second is taken
                first = np.concatenate([[True], np.diff(same) > 1])
                run = np.arange(len(same)) - np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))
                same = same[run % 2 == 0]
                merged = own.copy()
                merged[same] = least[k]
                after = np.delete(merged, same + 1)
                place = same - np.arange(len(same))
                ends = np.concatenate([after, [-1]]).astype(np.int32)
                right_old = np.concatenate([own, [-1]])[np.minimum(same + 2, len(own))].astype(np.int32)
                token = np.full(len(same), least[k], np.int32)
                left = np.where(place > 0, after[np.maximum(place - 1, 0)], -1).astype(np.int32)
                made = [self.pairs.ranks(token, ends[place + 1]), self.pairs.ranks(token, right_old), self.pairs.ranks(left, token)]
                if min(int(m.min()) for m in made) > least[k]:
                    new_rows.append(after)
                    continue
            merged = np.delete(own, at[k] + 1)
            merged[at[k]] = least[k]
            new_rows.append(merged)
        wide = max(map(len, new_rows))
        out = np.full((len(ids), wide), -1, np.int32)
        for k, r in enumerate(new_rows):
            out[k, : len(r)] = r
        return out, self.pairs.ranks(out[:, :-1], out[:, 1:])

    def _learn(self, pieces: list[str], into: dict[str, bytes], before: str = "") -> None:
        """Ids of pieces, with a text before each. A piece that is a token is that token."""
        rest, raws = [], []
        for p in pieces:
            raw = (before + p).encode()
            rank = self.ranks.get(raw)
            if rank is None:
                rest.append(p)
                raws.append(raw)
            else:
                into[p] = _LITTLE(rank)
        into.update(zip(rest, self.merge(raws), strict=True))

    def _units(self, new: set[str]) -> dict[str, bytes]:
        """Ids of units with a space before them. A word of letters is one piece with its space, and marks alone fall apart the
        same after any."""
        words, marks, cut, found, plain, mixed = self.words, self.marks, self.cut, {}, [], {}
        for u in new:
            word = u.rstrip(MARKS)
            if word.isalpha():
                plain.append((u, word, u[len(word) :]))
            else:
                mixed[u] = cut(" " + u)
        self._learn(list({w for _, w, _ in plain}.difference(words)), words, " ")
        tails = {t: cut(t) for t in {t for _, _, t in plain}.difference(marks)}
        known = self.known
        self._learn(list({p for own in (*mixed.values(), *tails.values()) for p in own}.difference(known)), known)
        get = known.__getitem__
        for tail, own in tails.items():
            marks[tail] = b"".join(map(get, own))
        for u, word, tail in plain:
            found[u] = words[word] + marks[tail]
        for u, own in mixed.items():
            found[u] = b"".join(map(get, own))
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(units(t) if self.spaced else [t]) if t else [] for t in texts]
        firsts = [self.cut(own[0]) if own else [] for own in split]
        self._learn(list({p for own in firsts for p in own}.difference(self.known)), self.known)
        get, young, old = self.known.__getitem__, self.young, self.old
        parts = [list(map(young.get, own[1:])) for own in split]
        open_ = [[k for k, ids in enumerate(own) if ids is None] if None in own else () for own in parts]
        new = {own[k + 1] for own, at in zip(split, open_, strict=True) for k in at}
        fresh = {u: old[u] for u in new if u in old}
        fresh |= self._units(new.difference(fresh))
        for own, part, at in zip(split, parts, open_, strict=True):
            for k in at:
                part[k] = fresh[own[k + 1]]
        out = [np.frombuffer(b"".join([*map(get, first), *part]), "<i4") for first, part in zip(firsts, parts, strict=True)]
        young.update((u, ids) for u, ids in fresh.items() if len(u) <= LONG)
        if len(young) > self.keep // 2:
            self.young, self.old = {}, young
        if len(self.words) > self.keep // 4:
            self.words = {}
        if len(self.known) > self.keep // 8 or sum(map(len, self.known)) > 16 * self.keep:
            self.known, self.marks = {}, {}
        return out

    def decode(self, ids: np.ndarray, ends: list[int]) -> list[bytes]:
        """The bytes of ids up to each end."""
        flat, starts, sizes = self.tokens
        if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or sizes[ids].min() < 0):
            raise ValueError("an id that the vocabulary lacks")
        size = sizes[ids]
        upto = np.cumsum(size)
        place = np.repeat(starts[ids] - upto + size, size) + np.arange(upto[-1] if len(ids) else 0)
        whole = flat[place].tobytes()
        cuts = np.concatenate([[0], upto])[[0, *ends]].tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str | None = None) -> ByteBPE:
    """One for each Python worker, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return ByteBPE(ranks, pattern or public_pattern())


def _some(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, as many at a time as TEXTS and TEXT_BYTES allow."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if len(part) >= TEXTS or size >= TEXT_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each whole text.

    Null counts as empty: no ids. Null ids and repeated ids keep a row each. Empty table: empty result. Other columns
    are not read, whatever their names. Very long texts are taken alone; a very long piece of theirs is a matrix of one
    row. Rows do not move, so no key can be hot; a lost task is run again with the same result.
    """
    path = path or vocabulary_path(RANKS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        gc.disable()  # nothing here refers to itself, and looking through the remembered units for that is a third of the time
        try:
            for batch in batches:
                begin = 0
                for texts in _some(batch["text"].to_pylist()):
                    ids = coder.encode(texts)
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, len(texts)), lists], ["doc_id", "ids"])
                    begin += len(texts)
        finally:
            gc.enable()

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with ``decoded`` (binary): the bytes of all ids, one after the other. Null ids (the array): no
    bytes. An id that the vocabulary lacks, or a null id within, is an error."""
    path = path or vocabulary_path(RANKS)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, DECODED):
                piece = batch.slice(begin, DECODED)
                lists = piece["ids"]
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                texts = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), ends)
                yield pa.RecordBatch.from_arrays([piece["doc_id"], lists, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids array<int>, decoded binary")
