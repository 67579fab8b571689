"""Folders of files as tables: listed by tasks, dealt into parts of equal bytes, read or digested as streams.

No list of names is ever on the driver. Folders are listed level by level, each level by one job whose rows are folders.
The files found are put in order and cut into bins of about the same number of bytes; the manifest of bins is a table in
the shared folder. The data source makes an input partition of each bin and reads it file by file.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graysift.functions.rules import SAID
from graysift.sources.shared import shared_path, written

# Fixed value: folders that are passed over.
SKIPPED = r"(^|[/\\])(node_modules|\.git|\.venv|__pycache__|dist|build)([/\\]|$)"
#: Bytes of a bin, of file contents in a batch, and of a read; what a file costs besides its bytes.
BIN_BYTES, BATCH_BYTES, READ_BYTES, OPENING = 256 << 20, 16 << 20, 8 << 20, 64 << 10
#: Names that a listing hands on together.
NAMES = 10_000


def open_store(path: str):
    """(file system, path in it, what stood before it)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:/"):
        return fs.LocalFileSystem(), os.path.abspath(path), ""
    store, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return store, root, path[: path.index(root)]


def _children(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, bytes, is a folder) of what lies in a folder. A local one is read as a stream."""
    from pyarrow import fs

    store, root, start = open_store(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(root) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    yield start + e.path, 0, True
                elif e.is_file():
                    yield start + e.path, e.stat().st_size, False
    else:
        for f in store.get_file_info(fs.FileSelector(root)):
            yield start + f.path, f.size or 0, f.type == fs.FileType.Directory


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch["path"].to_pylist():
            held: list[tuple] = []
            for child in _children(folder):
                held.append(child)
                if len(held) == NAMES:
                    yield _names(held)
                    held = []
            if held:
                yield _names(held)


def _names(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "bytes", "folder"])


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of all files under a folder, whatever their names begin with, or of the file itself. Skipped folders are
    not entered, links to folders not followed. A path that does not exist is an error."""
    from pyarrow import fs

    store, root, start = open_store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return spark.createDataFrame([(start + root, info.size)], "path string, bytes long")
    level, found = spark.createDataFrame([(start + root,)], "path string"), []
    while True:  # once for each level of folders
        found.append(written(level.mapInArrow(_listed, "path string, bytes long, folder boolean"), "level"))
        level = found[-1].filter(F.col("folder") & ~F.col("path").rlike(SKIPPED)).select("path")
        if level.isEmpty():
            break
        level = level.repartition(F.xxhash64("path"))
    files = found[0]
    for more in found[1:]:
        files = files.union(more)
    return files.filter("not folder").select("path", "bytes")


class Bin(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest, self.most, self.digest = options["manifest"], int(options.get("maxBytes", 0)), options.get("digest") == "true"

    def partitions(self) -> list[Bin]:
        """One for each bin: the names of the bins' folders, not of files, are listed here."""
        from pyarrow import fs

        store, root, start = open_store(self.manifest)
        bins = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory]
        return [Bin(start + b) for b in sorted(bins)] or [Bin("")]

    def _files(self, folder: str) -> Iterator[tuple[str, str, int]]:
        import pyarrow.dataset as ds

        if folder:
            store, root, _ = open_store(folder)
            for batch in ds.dataset(root, filesystem=store, format="parquet", partitioning=None).to_batches(batch_size=NAMES):
                yield from zip(*(batch[c].to_pylist() for c in ("path", "name", "bytes")), strict=True)

    def read(self, partition: Bin) -> Iterator[pa.RecordBatch]:
        rows, size, kinds = [], 0, (pa.string(), pa.string(), pa.int64(), pa.string() if self.digest else pa.binary(), pa.string())
        names = ["path", "name", "bytes", "sha256" if self.digest else "content", "failed"]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for path, name, bytes_ in self._files(partition.folder):
            found, failed = None, None
            try:
                store, at, _ = open_store(path)
                with store.open_input_stream(at) as f:
                    found = file_digest(f) if self.digest else f.read(self.most or None)
            except OSError as x:  # one file that cannot be read does not end the scan
                failed = SAID["read"] % x
            rows.append((path, name, bytes_, found, failed))
            size += len(found or "")
            if size >= BATCH_BYTES or len(rows) == NAMES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class FileTree(DataSource):
    """Files of a manifest (option manifest: the path of its table). digest=true: their sha256 instead of their content;
    maxBytes: how much of a content is read."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return f"path string, name string, bytes long, {'sha256 string' if self.options.get('digest') == 'true' else 'content binary'}, failed string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def file_digest(stream) -> str:
    """sha256 of a stream of any length, READ_BYTES at a time."""
    digest = hashlib.sha256()
    while part := stream.read(READ_BYTES):
        digest.update(part)
    return digest.hexdigest()


def binned(files: DataFrame, bin_bytes: int = BIN_BYTES) -> str:
    """The path of a manifest of files (path, bytes): they are put in order by path and cut where bin_bytes are reached, so
    a bin has at most that and one file more. Sums of parts of the order go to the driver, as many as there are shuffle
    partitions."""
    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cost = F.coalesce("bytes", F.lit(0)) + OPENING
    rows = files.select("path", F.regexp_extract("path", r"[^/\\]*$", 0).alias("name"), "bytes", cost.alias("cost"))
    rows = written(rows.repartitionByRange(n, "path").sortWithinPartitions("path").withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "ordered-files")
    before, starts = 0, []
    for part, cost_ in sorted(rows.groupBy("part").agg(F.sum("cost")).collect()):
        starts.append((part, before))
        before += cost_
    starts = spark.createDataFrame(starts, "part int, before long")
    upto = F.sum("cost").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).join(F.broadcast(starts), "part").withColumn("bin", F.expr(f"(before + upto - cost) div {bin_bytes}"))
    path = shared_path(spark, "manifest")
    rows.select("path", "name", "bytes", "bin").repartition("bin").sortWithinPartitions("bin", "path").write.partitionBy("bin").parquet(path)
    return path


def file_contents(files: DataFrame, max_bytes: int | None = None, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """(path, name, bytes, content, failed) of files (path, bytes), at most max_bytes of each. Batches hold BATCH_BYTES and one
    file more."""
    spark = files.sparkSession
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("manifest", binned(files, bin_bytes)).option("maxBytes", max_bytes or 0).load()


def file_digests(files: DataFrame, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """(path, name, bytes, sha256, failed) of files (path, bytes) of any size; no file is held in memory."""
    spark = files.sparkSession
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("manifest", binned(files, bin_bytes)).option("digest", "true").load()


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (path within the folder, content) as files from the tasks and says how many. A task that is run again
    writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root, _ = open_store(folder)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                store.create_dir(os.path.dirname(f"{root}/{path}"), recursive=True)
                with store.open_output_stream(f"{root}/{path}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
