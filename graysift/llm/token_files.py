"""Token-ID files: one wavelet matrix per shard, and the jobs that write and read them.

The matrix is shaped by the ids' frequencies: an id has a prefix code, a plane holds one bit of each id whose code is
longer than the planes before, and the codes are dealt out so that ids whose code ends at a plane stand together at the end
of it. The planes are then about as long as the ids' entropy and need no further compression, so that rank and
select read them where they lie.

A shard file (bytes): the 4-byte magic, the length of a JSON header and its crc32 (unsigned 32-bit each), the header, then
its body. Sections of the body: the documents' ids and lengths, the alphabet (the ids that occur, by length of code and
id) and its counts, all four compressed; for each plane its bits and the ones before each BLOCK of them; the crc32 of each
PAGE of all that.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graysift.llm.common import shared_dir
from graysift.llm.tokens import BYTE_BPE, MEMORY, encoder, portions, vocabulary_path

MAGIC = b"WMX2"
#: Bits between two entries of a plane's ranks; bytes whose crc is checked together, when first read; ids that are moved
#: from plane to plane together, so that they stay in the processor's cache.
BLOCK, PAGE, STRIDE = 1024, 4096, 1 << 16
#: Codes are at most this long.
LONGEST = 30


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """The lengths of a prefix code of least total length for symbols met so often; 0 for a single symbol. Where a
    code would be longer than LONGEST, counts are halved, which evens them out."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    while n > 1:
        weight, parent = counts[order].tolist(), [0] * (2 * n - 1)
        leaf, inner = 0, n  # both queues are in order of weight
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (inner == new or weight[leaf] <= weight[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                parent[k] = new
                total += weight[k]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= LONGEST:
            found = np.empty(n, np.int64)
            found[order] = depth[:n]
            return found
        counts = (counts + 1) // 2
    return np.zeros(n, np.int64)


def codes_of(ending: list[int]) -> np.ndarray:
    """The codes, first bit highest of 32, of symbols in order of code length; ending[p] symbols have p bits. Before plane p
    ids stand by their first p bits read backwards, so codes that end there are the last ones in that order."""
    open_, found = np.zeros(1, np.uint32), []
    for p, n in enumerate(ending):
        found.append(open_[len(open_) - n :])
        rest = open_[: len(open_) - n]
        open_ = np.concatenate([rest, rest | np.uint32(1 << (31 - p))])
    return np.concatenate([np.zeros(0, np.uint32), *found])


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The wavelet matrix of ids (unsigned 32-bit) as one file."""
    import zstandard

    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(counts)
    size = code_lengths(counts[alphabet])
    by_size = np.argsort(size, kind="stable")
    alphabet, ending = alphabet[by_size], np.bincount(size).tolist() if len(size) else []
    coded = np.zeros(len(counts), np.uint32)
    coded[alphabet] = codes_of(ending)
    counts, first = counts[alphabet], np.cumsum([0, *ending])
    ended = [int(counts[a:b].sum()) for a, b in zip(first, first[1:], strict=False)]
    press = zstandard.ZstdCompressor(level=3).compress
    sections: dict[str, bytes] = {
        "docs": press(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()),
        "lengths": press(np.asarray(lengths, "<i8").tobytes()),
        "alphabet": press(alphabet.astype("<u4").tobytes()),
        "counts": press(counts.astype("<u8").tobytes()),
    }
    level, zeros = coded[ids], []
    for p in range(len(ending) - 1):
        level = level[: len(level) - ended[p]]
        following, mask, bits = np.empty_like(level), np.uint32(1 << (31 - p)), np.empty(len(level), bool)
        np.not_equal(level & mask, 0, out=bits)
        zero, one = 0, len(level) - int(np.count_nonzero(bits))
        zeros.append(one)
        for begin in range(0, len(level), STRIDE):
            part, high = level[begin : begin + STRIDE], bits[begin : begin + STRIDE]
            # by places: taking by a mask of random bits is several times slower
            low, up = part.take(np.flatnonzero(~high)), part.take(np.flatnonzero(high))
            following[zero : zero + len(low)] = low
            following[one : one + len(up)] = up
            zero, one = zero + len(low), one + len(up)
        packed = np.packbits(bits)
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        sections[f"bits{p}"] = packed.tobytes()
        sections[f"ranks{p}"] = np.cumsum([0, *ones]).astype("<u4" if len(level) < 1 << 32 else "<u8").tobytes()
        level = following
    body = b"".join(sections.values())
    crcs = struct.pack(f"<{-(-len(body) // PAGE)}I", *(zlib.crc32(body[k : k + PAGE]) for k in range(0, len(body), PAGE)))
    head = {"n": len(ids), "zeros": zeros, "ending": ending, "ended": ended, "docs": len(doc_ids), "pages": zlib.crc32(crcs), "sections": [[k, len(v)] for k, v in sections.items()]}
    head = json.dumps(head).encode()
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + body + crcs


class WaveletMatrix:
    """Reads one shard file where it lies: access, rank, count and select touch a few pages of each plane; decode() reads
    all. A page's crc is checked when it is first read, and a damaged one is a ValueError."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size, crc = struct.unpack("<II", data[4:12])
        if zlib.crc32(data[12 : 12 + size]) != crc:
            raise ValueError("a wavelet shard is damaged")
        self.head = json.loads(bytes(data[12 : 12 + size]))
        self.n, self.zeros, ended = self.head["n"], self.head["zeros"], self.head["ended"]
        self.planes, self.at, end = len(self.zeros), {}, 0
        for name, length in self.head["sections"]:
            self.at[name], end = (end, end + length), end + length
        self.body, crcs = data[12 + size : 12 + size + end], data[12 + size + end :]
        if zlib.crc32(crcs) != self.head["pages"]:
            raise ValueError("a wavelet shard is damaged")
        self.crcs, self.seen = np.frombuffer(crcs, "<u4"), np.zeros(len(crcs) // 4, bool)
        #: Ids in each plane, and where the codes that end before it begin in the alphabet.
        self.sizes = (self.n - np.cumsum(ended)).tolist()
        self.first = np.cumsum([0, *self.head["ending"]]).tolist()

    def _read(self, section: str, begin: int = 0, end: int | None = None) -> memoryview:
        low, high = self.at[section]
        low, high = low + begin, high if end is None else min(low + end, high)
        for page in range(low // PAGE, -(-high // PAGE)):
            if not self.seen[page]:
                if zlib.crc32(self.body[page * PAGE : (page + 1) * PAGE]) != self.crcs[page]:
                    raise ValueError("a wavelet shard is damaged")
                self.seen[page] = True
        return self.body[low:high]

    def _unpress(self, section: str) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._read(section))

    @cached_property
    def alphabet(self) -> np.ndarray:
        return np.frombuffer(self._unpress("alphabet"), "<u4")

    @cached_property
    def counts(self) -> np.ndarray:
        return np.frombuffer(self._unpress("counts"), "<u8").astype(np.int64)

    @cached_property
    def codes(self) -> np.ndarray:
        return codes_of(self.head["ending"])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        raw, n = self._unpress("docs"), self.head["docs"]
        nulls = np.unpackbits(np.frombuffer(raw[8 * n :], np.uint8))
        ids = np.frombuffer(raw[: 8 * n], "<i8").tolist()
        return [None if null else d for d, null in zip(ids, nulls, strict=False)], np.frombuffer(self._unpress("lengths"), "<i8")

    def _rank(self, plane: int, block: int) -> int:
        low, high = self.at[f"ranks{plane}"]
        width = 4 if self.sizes[plane] < 1 << 32 else 8
        return int.from_bytes(self._read(f"ranks{plane}", block * width, (block + 1) * width), "little")

    def _ones(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block, rest = divmod(at, BLOCK)
        found = self._rank(plane, block)
        if rest:
            begin = block * BLOCK // 8
            bits = self._read(f"bits{plane}", begin, begin + -(-rest // 8))
            found += (int.from_bytes(bits, "big") >> (-rest % 8)).bit_count()
        return found

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        p = 0
        while at < self.sizes[p]:
            bit, ones = self._read(f"bits{p}", at // 8, at // 8 + 1)[0] >> (7 - at % 8) & 1, self._ones(p, at)
            at = self.zeros[p] + ones if bit else at - ones
            p += 1
        ends = np.cumsum(self.counts[self.first[p] : self.first[p + 1]])
        return int(self.alphabet[self.first[p] + np.searchsorted(ends, at - self.sizes[p], side="right")])

    def _code(self, token: int) -> list[int] | None:
        """The bits of an id's code; None for an id that does not occur."""
        k = np.flatnonzero(self.alphabet == token)
        if not len(k):
            return None
        size = int(np.searchsorted(self.first, k[0], side="right")) - 1
        code = int(self.codes[k[0]])
        return [code >> (31 - p) & 1 for p in range(size)]

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs in [low, high)."""
        code, low, high = self._code(token), max(low, 0), self.n if high is None else min(high, self.n)
        if code is None or low >= high:
            return 0
        for p, bit in enumerate(code):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if bit else (low - a, high - b)
            if low >= high:
                return 0
        return high - low

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id."""
        code, at = self._code(token), 0
        if code is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        for p, bit in enumerate(code):
            ones = self._ones(p, at)
            at = self.zeros[p] + ones if bit else at - ones
        at += k
        for p, bit in reversed(list(enumerate(code))):
            at = self._place(p, bit, at - self.zeros[p] if bit else at)
        return at

    def _place(self, plane: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) bit of its kind in a plane: its block by halving, then the bit in it."""
        before = lambda b: self._rank(plane, b) if bit else b * BLOCK - self._rank(plane, b)
        low, high = 0, -(-self.sizes[plane] // BLOCK)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if before(middle) <= nth else (low, middle)
        raw = np.frombuffer(self._read(f"bits{plane}", low * BLOCK // 8, (low + 1) * BLOCK // 8), np.uint8)
        return low * BLOCK + int(np.flatnonzero(np.unpackbits(raw) == bit)[nth - before(low)])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes' partitions from the last to the first."""
        kind = np.uint16 if len(self.alphabet) <= 65536 else np.uint32
        places, level = np.arange(len(self.alphabet), dtype=kind), np.zeros(0, kind)
        for p in reversed(range(self.planes + 1)):
            if p < self.planes:
                bits = np.unpackbits(np.frombuffer(self._read(f"bits{p}"), np.uint8), count=self.sizes[p]).view(bool)
                up, zero, one = np.empty_like(level), 0, self.zeros[p]
                for begin in range(0, len(bits), STRIDE):
                    part, high = up[begin : begin + STRIDE], bits[begin : begin + STRIDE]
                    low, top = np.flatnonzero(~high), np.flatnonzero(high)
                    part[low], part[top] = level[zero : zero + len(low)], level[one : one + len(top)]
                    zero, one = zero + len(low), one + len(top)
                level = up
            if self.head["ending"]:
                ends = slice(self.first[p], self.first[p + 1])
                level = np.concatenate([level, np.repeat(places[ends], self.counts[ends])])
        return self.alphabet[level] if self.n else np.zeros(0, "<u4")


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = 8_000_000, memory: int = MEMORY
) -> None:
    """Encodes every text, appends end_id to each document, and writes the ids in ascending id order.

    The documents are range-partitioned and sorted by id. Each task encodes its range and closes a shard at
    the first document end past shard_tokens ids. One row (part, shard, n, data) is one shard and one file of
    the output folder; the folder is an ordinary Parquet folder, so that Spark's committer makes a retried or
    lost task leave each shard once, in any store.

    Null text counts as empty and yields the end id alone; null ids come first; rows that repeat an id are
    written each, in order of their text. An empty table leaves an empty folder. A very long text is one document of a
    shard, which then has more ids than others. Other columns are not read. memory: words that a worker remembers,
    see Encoder.
    """
    vocabulary = vocabulary or vocabulary_path(BYTE_BPE)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end, shard = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), 0
        ids, doc_ids, lengths, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = build(np.frombuffer(b"".join(ids), "<u4"), doc_ids, np.array(lengths, np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([sum(lengths)], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n", "data"]
            )

        for batch in batches:
            for piece in portions(batch):
                for doc, got in zip(piece["doc_id"].to_pylist(), encoder(vocabulary, memory).encode(piece["text"].to_pylist()), strict=True):
                    ids.append(got + end)
                    doc_ids.append(doc)
                    lengths.append(len(got) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield close()
                        ids, doc_ids, lengths, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close()

    out = rows.mapInArrow(shards, "part int, shard int, n long, data binary")
    out.write.option("compression", "none").option("maxRecordsPerFile", 1).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the shard files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The shards' starts are running sums within the parts (tasks that wrote), over one small row for each shard, and over
    the parts, of which there is one for each task.
    """
    files = spark.read.schema("part int, shard int, n long, data binary").parquet(path)
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(parts), F.lit(0))).select("part", "base")
    starts = files.select("part", "shard", "n").withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n")
    starts = starts.join(bases, "part").select("part", "shard", (F.col("start") + F.col("base")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(batch["part"].to_pylist(), batch["shard"].to_pylist(), batch["data"], strict=True):
                matrix = WaveletMatrix(data.as_buffer())
                doc_ids, lengths = matrix.documents()
                raw, ends = memoryview(matrix.decode().astype("<u4").tobytes()), np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(crcs), pa.int32()), pa.array([shard] * len(crcs), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "shard", "data").mapInArrow(documents, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_file_index(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files (in the shared folder unless told where) and returns what reading them back gives."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return read_token_files(spark, path)
