"""A run over files with its options: read, scan, ask a model if there is one, redact, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graysift.functions.rules import MEDIUM, RANK
from graysift.operators.ai import MAX_CHUNKS, ai_results, replies, text_chunks
from graysift.operators.redact import redacted_copies
from graysift.operators.score import exit_code, summarise
from graysift.plans.report import write_report
from graysift.plans.scan import scan
from graysift.sources.files import MAX_BYTES, extract_text, read_files
from graysift.sources.shared import written
from graysift.sources.tree import write_files


@dataclass(frozen=True)
class Options:
    """threshold: the verdict from which a file is blocked. most: files of a folder; None: all. max_chunks and chunk_size: how
    much of a text a model is asked about; None: all. show_values: do not mask values in the report. every: list and
    redact all values, not only those of the report's caps."""

    threshold: str = MEDIUM
    most: int | None = 500
    max_bytes: int = MAX_BYTES
    max_chunks: int | None = MAX_CHUNKS
    chunk_size: int = 6000
    overlap: int = 200
    show_values: bool = False
    every: bool = False

    def __post_init__(self):
        if self.threshold not in RANK:
            raise ValueError(f"threshold is one of {', '.join(RANK)}")


def run(spark: SparkSession, path: str, options: Options = Options(), ask: Callable[[list[str]], list[str | None]] | None = None, memory: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of the files under a path; ask, memory: see operators.ai.replies. The files are read and the model is
    asked here, once; results and summary read what was written of that."""
    # Read and unpacked once, though chunks and scan both use it.
    docs = written(extract_text(read_files(spark, path, options.most, options.max_bytes), options.max_bytes), "unpacked")
    said = None
    if ask is not None:
        chunks = text_chunks(docs, "path", "text", options.chunk_size, options.overlap, options.max_chunks)
        said = written(ai_results(replies(chunks, ask, "path", memory), "path"), "said")
    results = scan(docs, said, id_col="path", every=options.every)
    return results, summarise(results, options.threshold)


def write_run(results: DataFrame, summary: DataFrame, path: str, options: Options = Options(), redact: bool = False) -> int:
    """Writes report.json and report.html under a folder, and with redact the redacted copies of plain texts as files of their own
    names under redacted/; returns the exit code."""
    write_report(results, path, options.threshold, options.show_values)
    if redact:
        write_copies(redacted_copies(results), f"{path}/redacted")
    return exit_code(summary.first()["highest"], options.threshold)


def write_copies(copies: DataFrame, folder: str) -> int:
    """Redacted copies (path, text) as files below a folder, each under the whole path of its original, so that equal names
    do not meet."""
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), r"^[/\\]+", "")
    return write_files(copies.select(inside.alias("path"), F.encode("text", "UTF-8").alias("content")), folder)
