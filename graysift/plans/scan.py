"""The scan of documents: name and text, merged with a model's findings if there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graysift.functions import text as tx
from graysift.functions.rules import SAID
from graysift.operators.detect import FINDINGS, with_findings
from graysift.operators.score import advice, merge_findings, verdict, weigh_topics

RESULT = ["name", "bytes", "kind", "readable", "ai_used", "verdict", "advice", "ai_summary", "findings", "warnings"]


def scan(docs: DataFrame, ai: DataFrame | None = None, id_col: str = "doc_id", every: bool = False) -> DataFrame:
    """docs (id, text, and optionally name, bytes, kind, readable, truncated, note) with the columns of RESULT.

    ai: (id, ai_findings, ai_summary, ai_warnings, ai_used), one row for each document, as operators.ai makes it.
    Without ai the scan needs no shuffle: each document is judged in the row it is read in. Null texts and names
    count as empty. Other columns pass through; those of RESULT are replaced. every: list all values, for redaction.
    """
    has = set(docs.columns)
    optional = {"name": "string", "bytes": "long", "kind": "string", "note": "string"}
    for c, kind in optional.items():
        if c not in has:
            docs = docs.withColumn(c, F.lit(None).cast(kind))
    docs = docs.withColumn("readable", F.coalesce(F.col("readable"), F.lit(True)) if "readable" in has else F.lit(True))
    docs = docs.withColumn("__cut", F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in has else F.lit(False))
    if ai is None:
        docs = docs.withColumns({"__ai": F.array().cast(FINDINGS), "__said": F.array().cast("array<string>"), "ai_used": F.lit(False), "ai_summary": F.lit("")})
    else:
        ai = ai.select(F.col(id_col), F.col("ai_findings").cast(FINDINGS).alias("__ai"), F.col("ai_warnings").alias("__said"), "ai_used", "ai_summary")
        docs = docs.drop("ai_used", "ai_summary").join(ai, id_col, "left")
        docs = docs.withColumns(
            {
                "__ai": F.coalesce("__ai", F.array().cast(FINDINGS)), "__said": F.coalesce("__said", F.array().cast("array<string>")),
                "ai_used": F.coalesce("ai_used", F.lit(False)), "ai_summary": F.coalesce("ai_summary", F.lit("")),
            }
        )
    if "name" in has:
        docs = with_findings(docs, tx.name_as_text(F.coalesce("name", F.lit(""))), "__by_name", "__ignored", in_filename=True, context=F.col("name"), every=every)
    else:
        docs = docs.withColumn("__by_name", F.array().cast(FINDINGS))
    docs = with_findings(docs, F.col("text"), "__by_text", "__warnings", every=every)
    docs = docs.withColumn("__found", F.concat("__by_name", "__by_text", "__ai"))
    limit = F.when(F.col("__cut"), SAID["cut"])
    docs = docs.withColumn("warnings", F.concat(F.array_compact(F.array(F.col("note"), limit)), "__warnings", "__said"))
    docs = docs.withColumn("findings", F.when(F.size("__found") > 0, merge_findings(F.col("__found"))).otherwise(F.array().cast(FINDINGS)))
    docs = docs.withColumn("findings", weigh_topics(F.col("findings")))
    docs = docs.withColumn("readable", F.col("readable") | (F.size("findings") > 0))
    docs = docs.withColumn("verdict", verdict(F.col("findings"), F.col("readable")))
    docs = docs.withColumn("advice", advice(F.col("verdict")))
    docs = docs.drop("__ai", "__said", "__found", "__cut", "__by_name", "__by_text", "__warnings", "__ignored", "note")
    # As rows of a generator, so that a filter on a verdict is not pushed down through all that makes it.
    return docs.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
