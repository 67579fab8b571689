"""The scan over a stream of texts, and counts of verdicts that stay right when a document comes again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graysift.plans.scan import scan


def scan_stream(docs: DataFrame) -> DataFrame:
    """The scan of a streaming table of documents. It keeps no state: a document is judged by itself."""
    return scan(docs)


def running_counts(results: DataFrame) -> DataFrame:
    """Arrivals by verdict so far; the state is one row for each verdict. A document that comes twice counts twice: for counts of
    documents see keep_counts()."""
    return results.groupBy("verdict").agg(F.count(F.lit(1)).alias("files"))


def each_batch(results: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch's results to a function, which should be idempotent by batch number."""
    return results.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdict_changes(results: DataFrame, id_col: str = "doc_id", version_col: str | None = None) -> DataFrame:
    """verdict, change: what each arrival changes in the number of documents with a verdict. The state is the last verdict of
    each document; another verdict takes one from the old count and gives one to the new, the same verdict changes nothing.

    version_col: a whole number; an arrival with a version that is not above the last one is old and changes nothing, so
    the order of arrivals does not matter. Without it the one that comes last counts, of one batch that with the highest verdict.
    """
    order = F.col(version_col).cast("long") if version_col else F.lit(None).cast("long")
    rows = results.select(F.col(id_col).cast("string").alias("id"), "verdict", order.alias("version"))

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None)
        found = [(v, verdict) for p in parts for v, verdict in zip(p["version"].tolist(), p["verdict"].tolist(), strict=True)]
        if version_col is None:
            new = (None, max((verdict for _, verdict in found), key=lambda v: ("onbekend", "geen", "laag", "middel", "hoog").index(v)))
        else:
            version, verdict = max(((int(v), x) for v, x in found if v == v and v is not None), default=(None, None))
            new = (version, verdict) if version is not None and (held[0] is None or version > held[0]) else held
        if new != held and new[1] is not None:
            state.update(new)
            if new[1] != held[1]:
                changes = [(new[1], 1)] + ([(held[1], -1)] if held[1] is not None else [])
                yield pd.DataFrame(changes, columns=["verdict", "change"])

    return rows.groupBy("id").applyInPandasWithState(follow, "verdict string, change long", "version long, verdict string", "append", GroupStateTimeout.NoTimeout)


def keep_counts(results: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", version_col: str | None = None) -> StreamingQuery:
    """Follows a stream of results: each batch's changes are summed and written as a folder of their own, a few rows each. A
    batch that is tried again writes its folder again."""
    return each_batch(verdict_changes(results, id_col, version_col), lambda rows, n: write_changes(rows, path, n), checkpoint)


def write_changes(changes: DataFrame, path: str, batch: int) -> None:
    changes.groupBy("verdict").agg(F.sum("change").alias("change")).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def document_counts(spark: SparkSession, path: str) -> DataFrame:
    """verdict, files: how many documents have each verdict now."""
    rows = spark.read.schema("verdict string, change long, batch int").option("basePath", path).parquet(path)
    return rows.groupBy("verdict").agg(F.sum("change").alias("files")).filter("files <> 0")
