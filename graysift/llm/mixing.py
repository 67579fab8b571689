"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graysift.llm.common import WORD, materialize


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """Adds ``target`` to rows (source_key, source, source_size): weight shares of the total of all sizes,
    none above cap * source_size.

    Sources sorted by code point, null last, take the weights in turn. What a cap cuts off goes to the
    others by weight until none is above its cap: sorted by cap / weight the capped sources come first, so
    running sums give the level at each possible cut and the first level below the next source's ratio is
    the answer. The two windows here see one row for each source, not the documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("w", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("limit") / F.col("w")), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") <= F.col("limit") / F.col("w"))
    cut = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("w"), F.col("level")))).over(everything)
    # The level of the first source that is not capped holds for all that follow it.
    return rows.withColumn("target", F.least("limit", F.coalesce(cut["level"] * F.col("w"), F.col("limit")))).drop("limit", "level", "free", "w")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix"
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words the mix takes).

    Each source's documents are shuffled by a keyed hash; the e-th pass over a document ends at virtual
    time (e * source_size + running size) / target. All passes of all sources are put in order of virtual
    time and cut where the running total reaches the total of all sizes. Virtual time is cut into equal
    slices first: their sums (one row a slice) find the slice that holds the cut, and only that slice is
    sorted. A source's running sizes are summed within hash ranges, whose totals are then added up, so the
    largest source is spread over many tasks.

    Null text: size 0, takes nothing. Null source: a source of its own, sorted last. Rows that repeat an
    id are documents of their own, with the same place in the shuffle. A null id shuffles as id "null".
    Very long texts count as their words. Other columns are not read, so none clashes. Empty table: empty result. The cut is found when this is called (the sized documents are written to
    the shared folder); reruns agree.
    """
    spark = docs.sparkSession
    n = docs.count()
    parts = max(128, min(65536, n // 50_000))
    slices = max(512, min(65536, n // 10_000))
    mark = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mark.alias("mark"),
    )
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source_key")
    sized = materialize(sized.select(key, "*", F.shiftright(F.col("mark"), 60 - 16).cast("int").alias("range")), "mix-sized")
    sized = sized.withColumn("range", (F.col("range") * parts / 65536).cast("int"))
    sums = sized.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"), F.first("source", ignorenulls=True).alias("source"))
    sources = sums.groupBy("source_key").agg(F.sum("range_size").alias("source_size"), F.first("source", ignorenulls=True).alias("source"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.drop("source").withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    offsets = offsets.join(source_targets(sources, weights, cap).drop("source"), "source_key").drop("range_size")
    inside = Window.partitionBy("source_key", "range").orderBy("mark", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("within", F.sum("size").over(inside)).join(offsets, ["source_key", "range"])
    place = F.col("offset") + F.col("within")
    times = [(F.lit(float(e)) * F.col("source_size") + place) / F.col("target") for e in range(cap)]
    rows = rows.select("doc_id", "source", "size", "mark", "source_size", "target", *[F.when(F.col("size") > 0, t).alias(f"t{e}") for e, t in enumerate(times)])
    rows = materialize(rows, "mix-timed")

    passes = rows.filter("size > 0").select("doc_id", "mark", "size", F.posexplode(F.array(*[f"t{e}" for e in range(cap)])).alias("pass", "time"))
    passes = passes.withColumn("slice", F.floor(F.col("time") * slices))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    total = sized.agg(F.sum("size")).first()[0] or 0
    held = passes.groupBy("slice").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    split = held.filter(F.col("upto") > total).orderBy("slice").limit(1).first()
    if split is None:
        taken = F.lit(cap) * F.col("size")
    else:
        order = Window.orderBy("time", "mark", "doc_id", "pass").rowsBetween(Window.unboundedPreceding, 0)
        last = passes.filter(F.col("slice") == split["slice"]).withColumn("upto", F.sum("size").over(order) + F.lit(split["upto"] - split["words"]))
        last = last.filter(F.col("upto") <= total).orderBy(F.desc("upto")).limit(1).first()
        if last is None:
            within = [F.floor(F.col(f"t{e}") * slices) < F.lit(split["slice"]) for e in range(cap)]
        else:
            cut = F.struct(F.lit(last["time"]), F.lit(last["mark"]), F.lit(last["doc_id"]).cast(rows.schema["doc_id"].dataType), F.lit(last["pass"]))
            within = [F.struct(F.col(f"t{e}"), F.col("mark"), F.col("doc_id"), F.lit(e)) <= cut for e in range(cap)]
        taken = F.col("size") * reduce(lambda a, b: a + b, [F.when(x, 1).otherwise(0) for x in within])
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"))
