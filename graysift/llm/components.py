"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import materialize


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the classes of u and v in place; a class is named by its least member."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(id, component) for each node that an edge links: component is the smallest id reachable, itself included.

    Each step takes one minimum for each node (partial aggregates, so a node with very many edges is one row
    for each task) and joins it back to the edges. The minima are written before the join: both sides are then
    plain scans, which adaptive execution may split or broadcast. Every step's edges are written to the shared
    folder, so lineage stays short. Null ids and loops are dropped. No edges: an empty table.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.distinct(), "edges")
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        ends = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "v"))
        least = materialize(ends.groupBy("x").agg(F.min("y").alias("m")), "least")
        large = e.join(least.withColumnRenamed("x", "v"), "v").select("u", F.col("m").alias("v")).filter("u != v")
        large = materialize(large.distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
