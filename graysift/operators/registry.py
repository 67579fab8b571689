"""A registry of label facts that grows by batches: a log of Parquet folders, one for each batch, read as one table.

Adding a batch writes its folder anew, so a batch that is tried again leaves the registry as it was, and two batches never
touch the same files. A fact is a label's claim on a fingerprint; the first batch that has it counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graysift.operators.provenance import registration_facts
from graysift.sources.shared import written

#: What a fact holds besides its batch.
FACT = "label_id string, sha256 string, kind string, signature_valid boolean"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, facts: DataFrame, batch: int) -> None:
        """Writes facts (columns of FACT; missing ones are null) as a batch. Facts without label or fingerprint are left out; of
        several of one label and fingerprint the least kind and signature stay."""
        have = [c if c in facts.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in FACT.split(", "))]
        rows = facts.select(*have).filter("label_id is not null and sha256 is not null")
        rows = rows.groupBy("label_id", "sha256").agg(F.min("kind").alias("kind"), F.min("signature_valid").alias("signature_valid"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def table(self) -> DataFrame:
        """label_id, sha256, kind, signature_valid, batch: each fact as its first batch has it."""
        rows = self.spark.read.schema(f"{FACT}, batch int").option("basePath", self.path).parquet(self.path)
        first = F.min_by(F.struct("kind", "signature_valid", "batch"), "batch").alias("f")
        return rows.groupBy("label_id", "sha256").agg(first).select("label_id", "sha256", "f.*")

    def compact(self, path: str) -> Registry:
        """The same facts as one batch of a registry elsewhere; their first batches are kept in the facts no longer."""
        out = Registry(self.spark, path)
        out.add(written(self.table(), "registry"), 0)
        return out

    def follow(self, files: DataFrame, checkpoint: str, **columns: str) -> StreamingQuery:
        """Adds the facts of a stream of files (see registration_facts) as it comes, a batch at a time."""
        return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: self.add(registration_facts(rows, **columns), n)).start()
