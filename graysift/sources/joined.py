"""One document from many tasks: a writer whose tasks write parts and whose commit joins them in order.

df.write.format("joined_text").mode("overwrite").option("path", file).option("head", ...).option("between", ...).option("tail", ...)
takes a column ``value``. A task writes its rows to a part of its own beside the file; parts of tasks that fail or run
twice are never named in a commit. The commit copies head, parts in order of partitions and tail into a new file as
streams, and moves it to its place: the file is whole or as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from graysift.sources.tree import READ_BYTES, open_store


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class JoinedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.head, self.between, self.tail = options["path"], options.get("head", ""), options.get("between", ""), options.get("tail", "")
        self.run = uuid.uuid4().hex

    def _parts(self):
        store, root, _ = open_store(self.path)
        return store, root, f"{root}.parts-{self.run}"

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        store, _, folder = self._parts()
        store.create_dir(folder, recursive=True)
        path, n = f"{folder}/{uuid.uuid4().hex}", 0
        with store.open_output_stream(path) as f:
            for row in rows:
                f.write(((self.between if n else "") + (row[0] or "")).encode())
                n += 1
        return Part(TaskContext.get().partitionId(), path, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, root, folder = self._parts()
        new = f"{root}.new-{self.run}"
        store.create_dir(root.rpartition("/")[0], recursive=True)
        with store.open_output_stream(new) as out:
            out.write(self.head.encode())
            for k, part in enumerate(sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)):
                out.write(self.between.encode() if k else b"")
                with store.open_input_stream(part.path) as f:
                    while data := f.read(READ_BYTES):
                        out.write(data)
            out.write(self.tail.encode())
        store.move(new, root)
        store.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, _, folder = self._parts()
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class JoinedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "joined_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> JoinedWriter:
        return JoinedWriter(dict(self.options))


def write_joined(values: DataFrame, path: str, head: str = "", between: str = "", tail: str = "") -> None:
    """One file of all rows of values (value), in order of their partitions."""
    values.sparkSession.dataSource.register(JoinedText)
    values.select("value").write.format("joined_text").mode("append").option("path", path).option("head", head).option("between", between).option("tail", tail).save()
