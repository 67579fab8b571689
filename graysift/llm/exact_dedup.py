"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import ascii_lower, likely, materialize

#: A group with over this share of all copies is hot; there are at most as many hot groups as its inverse says.
HOT = 1000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _repeated(rows: DataFrame, salts: int) -> DataFrame:
    """The digests that several rows (id, text, digest) have: digest, keep_id, group_size, variants (different texts).

    Map tasks combine the rows they read; what they hand on meets in ``salts`` groups of a digest and text, dealt by map
    task, and the winners of the salts meet last. A text that holds a third of all rows reaches a reducer as at most
    one row for each map task. Each step groups by the whole text.
    """
    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "text").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    merged = salted.repartition("digest").groupBy("digest", "text").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    groups = merged.groupBy("digest").agg(F.max("keep").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("variants"))
    return materialize(groups.filter("group_size > 1"), "repeated")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs with ``keep_id`` (largest id among equal texts), ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty, so null and empty
    texts form one group. A null id never wins over another; a group of null ids only keeps none (keep_id
    null, kept false). Rows that repeat an id each come back, all kept if the id wins. An empty table gives
    an empty table. Very long texts are compared whole. Result columns replace columns of the same name; other columns pass through.

    The digests that rows share are found first (when this is called) and written. Rows get their winner by digest, which
    is equality of texts: combining compared all texts of each digest. Should a digest ever stand for several texts,
    its rows are grouped and joined by their whole texts. Rows whose digest nobody shares are told by a broadcast
    bitmap and never move; the at most HOT groups that are large are broadcast too; the others are joined.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    rows = docs.drop(*new).withColumn("__text", normal(F.col(text_col)))
    rows = rows.withColumn("text_sha256", sha256(F.col("__text")))
    rows = rows.withColumn("__digest", F.col("text_sha256") if digest is sha256 else digest(F.col("__text")))
    repeated = _repeated(rows.select(F.col(id_col).alias("id"), F.col("__text").alias("text"), F.col("__digest").alias("digest")), salts)
    copies, several = repeated.agg(F.sum("group_size"), F.max("variants")).first()
    names = [*docs.drop(*new).columns, *new]
    alone = {"keep_id": F.coalesce("__keep", F.col(id_col)), "group_size": F.coalesce("__n", F.lit(1).cast("long"))}

    def finished(found: DataFrame) -> DataFrame:
        return found.withColumns(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("keep_id"), F.lit(False))).select(names)

    if not copies:
        return finished(rows.withColumns({"__keep": F.lit(None).cast(rows.schema[id_col].dataType), "__n": F.lit(None).cast("long")}))
    held = repeated.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__n"), "variants")
    large = F.broadcast(held.filter((F.col("__n") * HOT > copies) & (F.col("variants") == 1)).drop("variants"))
    told = likely(rows, "__digest", held.select("__digest"), "__maybe").join(large, "__digest", "left")
    open_ = F.col("__maybe") & F.col("__n").isNull()
    found = finished(told.filter(~open_))
    rest = told.filter(open_).drop("__keep", "__n")
    if several > 1:
        mixed = held.filter("variants > 1").select("__digest")
        apart = rest.join(mixed, "__digest", "left_semi")
        by_text = apart.groupBy("__digest", "__text").agg(F.max(id_col).alias("__keep"), F.count(F.lit(1)).alias("__n"))
        found = found.unionByName(finished(apart.join(by_text, ["__digest", "__text"])))
        rest = rest.join(mixed, "__digest", "left_anti")
    return found.unionByName(finished(rest.join(held.filter("variants = 1"), "__digest", "left")))
