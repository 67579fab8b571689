"""What several operators share: text normal forms and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that on pure ASCII, and is the quicker of the two."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a
    temporary folder; on a cluster each executor would write to its own disk, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that lost executors cost no
    recomputation and later jobs scan columns instead of repeating Python work. The caller's lazy result still reads
    the table; clear_tables() removes it when that is done with."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> int:
    """Deletes the tables that materialize() wrote for this driver so far and says how many; results that still read them
    must have been written elsewhere before."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def likely(rows: DataFrame, key_col: str, needed: DataFrame, flag: str, most_bits: int = 1 << 26) -> DataFrame:
    """rows with a boolean column: true if the key is in needed, and for a few others. To keep rows out of a join whose
    other side is a small part.

    One hash function into 8 bits for each needed key, most_bits at most (2^20 rows of 64 bits to broadcast); beyond
    that more rows are flagged, and the join that follows stays right.
    """
    bits = min(max(8 * needed.count(), 1 << 16), most_bits)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    held = needed.select(place(F.col(key_col)).alias("__place")).select(F.expr("__place div 64").alias("__word"), F.expr("shiftleft(1L, cast(__place % 64 as int))").alias("__bit"))
    held = held.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = rows.withColumn("__place", place(F.col(key_col))).withColumn("__word", F.expr("__place div 64")).join(F.broadcast(held), "__word", "left")
    return found.withColumn(flag, F.expr("coalesce(getbit(__bits, cast(__place % 64 as int)) = 1, false)")).drop("__place", "__word", "__bits")


def likely_rows(rows: DataFrame, key_col: str, needed: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """The rows whose key is in needed, and a few others."""
    return likely(rows, key_col, needed, "__likely", most_bits).filter("__likely").select(rows.columns)
