"""A training-data pipeline over documents: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graysift.llm import quality
from graysift.llm.common import materialize
from graysift.llm.exact_dedup import exact_dedup
from graysift.llm.mixing import mix
from graysift.llm.ngram_join import near_duplicates
from graysift.llm.packing import pack_documents


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no operator's result column can clash with them."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*own) if own else F.lit(0)).alias("__rest"))


def _given_back(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of a grade above poor is under one half; learnt from labels.

    Null and empty texts have no words and are graded by the thresholds alone; very long ones are graded whole. Equal texts
    are graded alike; repeated rows and rows without id stay or go one by one. Without documents the result is empty; without
    labels every grade is as likely as its threshold's start says. All columns of docs pass through, whatever their names.
    """
    ratings = quality.ratings_from_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.train(docs.select("doc_id", "text"), ratings, grades=3)
    return _given_back(quality.grade(_carried(docs), model).filter("selected"), docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays.

    Null counts as empty text. A row without id gives way to one with an id; of a text that only such rows have, one stays.
    Rows that repeat the id that stays all stay. Very long texts are compared whole. Without documents the result is
    empty. Columns named as the operator's own (kept, group_size, ...) come back as they were.
    """
    found = exact_dedup(_carried(docs))
    kept = found.filter("kept").select("doc_id", "text", "__rest")
    nameless = found.filter("keep_id is null").groupBy("text_sha256").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "__rest")])
    return _given_back(kept.unionByName(nameless.drop("text_sha256")), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of five-word shingles and similarity 0.8, the one with the smallest doc_id stays.

    Documents without words, or without id, link with nothing and stay. Rows that repeat an id stay or go together. Very
    long texts are compared whole. Without documents the result is empty. All columns pass through.
    """
    dropped = near_duplicates(docs, width=5, num=80, den=100).filter("component_id != doc_id").select(F.col("doc_id").alias("__dropped")).distinct()
    dropped = materialize(dropped, "near-dropped")
    return docs.join(dropped, docs["doc_id"] == dropped["__dropped"], "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, up to three times. Documents without words go.

    Ties in the mix are broken by id. Rows that repeat an id, or have none, come as often as the most taken of them. Null
    sources are one source. Very long texts count as their words. Without documents the result is empty. All columns pass
    through.
    """
    times = mix(docs).filter("taken > 0").groupBy("doc_id").agg(F.max(F.expr("taken div size")).cast("int").alias("__times"))
    kept = docs.withColumnRenamed("doc_id", "__id").join(times, F.col("__id").eqNullSafe(F.col("doc_id"))).drop("__id")
    return kept.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048. Null and empty texts are a single end id, very long ones are
    cut into pieces, repeated rows and rows without id are packed one by one. Without documents the result is empty."""
    return pack_documents(docs)


STAGES: list = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: The classifier and the packing are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
