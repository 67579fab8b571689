"""Near-duplicate vectors by tiled comparison in PCA order.

Unit vectors are rotated onto their principal axes, so the leading dimensions carry the most of a product. A tile
of products is built up from the leading dimensions; what is left of a product is at most the product of the two
suffix norms, and a pair is given up as soon as this bound cannot reach the threshold. Vectors are dealt into cells by
splits along the leading axes, about one for each block of vectors however many there are. Cells whose boxes lie too far
apart are never brought together: pairs of boxes are followed down the tree of cells, and of two near cells only the vectors
that may reach the other's box are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import materialize
from graysift.llm.components import connected_components, join_labels

#: Vectors of a block and its components at most (about), rows and columns of a tile, the least cells, and the leading axes
#: that cells are cut along.
BLOCK, BLOCK_VALUES, TILE, LEAST_CELLS, LEADING = 4096, 1 << 20, 1024, 16, 8
#: Cuts are proposed by samples, in two rounds of at most DEEP halvings (2^20 cells, of 4 * 10^9 vectors): SAMPLE vectors on
#: the driver, then about CELL_SAMPLE for each new cell in a task for each cell of the first round. All cuts are 16 MB at most.
DEEP, SAMPLE, CELL_SAMPLE = 10, 20_000, 32
#: Halvings that a step down the tree of cells takes: 32 * 32 pairs of boxes for each pair that is near.
STEP = 5
#: Lengths of so few different vectors are compared in one group each, on the given axes.
FEW = 256
#: A tile with at most this share of pairs in reach is finished pair by pair.
SPARSE = 1 / 16


class Vectors:
    """Unit vectors of a block on the principal axes, with the norms of what follows each of ``stops`` dimensions."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray, stops: list[int]):
        raw = raw.astype(np.float64)
        self.raw = raw / np.abs(raw).max(axis=1, keepdims=True, initial=1e-300)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw))
        self.wide = (self.raw / self.norms[:, None]) @ axes
        self.narrow = self.wide.astype(np.float32)
        squares = np.cumsum((self.wide**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {k: np.sqrt(squares[:, k]).astype(np.float32) if k < squares.shape[1] else np.zeros(len(raw), np.float32) for k in stops}


def stops_of(size: int) -> list[int]:
    """Where a tile checks its bound: 16, 32, 64 ... dimensions and the end."""
    found = [k for k in (16 * 2**i for i in range(20)) if k < size]
    return [*found, size]


def linked(x: Vectors, rows: slice, columns: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of a tile whose cosine in double precision is at least the threshold.

    Leading dimensions are summed in single precision; its error is added to the bound. Pairs still in reach are
    computed in double precision, and those within rounding of the threshold once more from the given vectors.
    """
    size = x.wide.shape[1]
    slack = np.float32(threshold - 4 * size * np.finfo(np.float32).eps)
    total, start = None, 0
    for stop in stops_of(size):
        part = x.narrow[rows, start:stop] @ x.narrow[columns, start:stop].T
        total = part if total is None else np.add(total, part, out=total)
        reach = total + np.multiply.outer(x.rest[stop][rows], x.rest[stop][columns]) >= slack
        if np.count_nonzero(reach) <= SPARSE * reach.size:
            break
        start = stop
    i, j = np.nonzero(reach)
    i, j = i + rows.start, j + columns.start
    i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):
        p, q = i[at : at + 65536], j[at : at + 65536]
        cosine = np.einsum("ij,ij->i", x.wide[p], x.wide[q])
        near = np.flatnonzero(np.abs(cosine - threshold) < 1e-9)
        if len(near):
            cosine[near] = np.einsum("ij,ij->i", x.raw[p[near]], x.raw[q[near]]) / (x.norms[p[near]] * x.norms[q[near]])
        keep[at : at + 65536] = cosine >= threshold
    return i[keep], j[keep]


def _compare(axes: np.ndarray | None, threshold: float):
    """All pairs of two blocks (or within one) -> (node, links, with): how many vectors a node links to here, and
    the least node that it is joined with here. No pair leaves the task. Without axes: one block of (size,), as given."""

    def found(key: tuple, rows: pa.Table) -> pa.Table:
        copies, node = rows["copies"].to_numpy(), rows["node"].to_numpy()
        size = axes.shape[0] if axes is not None else key[0].as_py()
        block = rows["block"].to_numpy() if axes is not None else np.zeros(len(node), np.int64)
        raw = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        order = np.lexsort((node, block))
        block, node, copies = block[order], node[order], copies[order]
        vectors = Vectors(raw[order], axes if axes is not None else np.eye(size), stops_of(size))
        n = len(node)
        within = axes is None or key[0].as_py() == key[1].as_py()
        cut = n if within else int(np.searchsorted(block, key[1].as_py()))
        links, label = np.zeros(n, np.int64), np.arange(n)
        for r in range(0, cut, TILE):
            for c in range(r if within else cut, n, TILE):
                i, j = linked(vectors, slice(r, min(r + TILE, cut)), slice(c, min(c + TILE, n)), threshold)
                if len(i):
                    links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                    join_labels(label, i, j)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "with": node[label[some]]})

    return found


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _with_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the unit vectors of rows (digest, node, copies, size, vector); a batch is cut by size."""
    for batch in batches:
        for size in np.unique(batch["size"].to_numpy()).tolist():
            part = batch.filter(pc.equal(batch["size"], size))
            raw = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            raw = raw / np.abs(raw).max(axis=1, keepdims=True)
            unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, size), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "unit"])


def cuts_of(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each cut of a binary tree over the points: a cell is cut at the median of its widest axis. Cut k
    leads to cuts (or cells) 2k + 1 and 2k + 2."""
    axis, value = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    cells = {0: points}
    for k in range(2**depth - 1):
        p = cells.pop(k)
        if len(p):
            axis[k] = p.var(axis=0).argmax()
            value[k] = np.median(p[:, axis[k]])
        right = p[:, axis[k]] > value[k]
        cells[2 * k + 1], cells[2 * k + 2] = p[~right], p[right]
    return axis, value


def cells_of(lead: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The cell of each point. Each point has cuts of its own if there is a row of them for each."""
    at, cuts, every = np.zeros(len(lead), np.int64), axis.shape[-1], np.arange(len(lead))
    while len(at) and at[0] < cuts:
        k, v = (axis[at], value[at]) if axis.ndim == 1 else (axis[every, at], value[every, at])
        at = 2 * at + 1 + (lead[every, k] > v)
    return at - cuts


def _in_cells(axes: np.ndarray, rounds):
    """Adds the leading coordinates and the cell to rows with a unit vector, which goes. rounds: a broadcast list of the
    first round's cuts and, if there is a second, those of each of the first one's cells."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (axis, value), *second = rounds.value
        for batch in batches:
            unit = batch["unit"].flatten().to_numpy(zero_copy_only=False).reshape(-1, axes.shape[0])
            lead = np.ascontiguousarray(unit @ axes[:, :LEADING])
            cell = cells_of(lead, axis, value)
            for of_axis, of_value in second:
                inner = np.zeros(len(cell), np.int64)
                for k in np.unique(cell).tolist():
                    rows = np.flatnonzero(cell == k)
                    inner[rows] = cells_of(lead[rows], of_axis[k], of_value[k])
                cell = cell * (of_axis.shape[1] + 1) + inner
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, lead.size + 1, lead.shape[1]), pa.int32()), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["copies"], batch["vector"], column, pa.array(cell)], ["node", "copies", "vector", "lead", "cell"])

    return found


def _cuts(depth: int):
    """The cuts of one cell's sample, as a row."""

    def found(key: tuple, rows: pa.Table) -> pa.Table:
        lead = rows["lead"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        axis, value = cuts_of(lead, depth)
        return pa.table({"cell": [key[0].as_py()], "axis": [axis], "value": [value]})

    return found


def _near(rows: DataFrame, depth: int, reach: float, leading: int) -> DataFrame:
    """(cell, n, other, other_n, low.., high..): the pairs of cells whose boxes may hold vectors at most reach apart, both ways
    round and with themselves, with the box of the other.

    Boxes of the tree's upper levels enclose those below, so pairs are followed down from the root, STEP halvings at a time, and
    only near pairs go on. Boxes are those of all vectors, not of the sample.
    """
    sides = [(f"{name}{k}", f) for name, f in (("low", F.min), ("high", F.max)) for k in range(leading)]
    leaves = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.get("lead", F.lit(int(name.lstrip("lowhigh"))))).alias(name) for name, f in sides])
    leaves = materialize(leaves, "cells")
    pairs = None
    for above in range(0, depth, STEP):
        level = min(above + STEP, depth)
        boxes = leaves.groupBy(F.shiftright("cell", depth - level).alias("cell")).agg(F.sum("n").alias("n"), *[f(name).alias(name) for name, f in sides])
        boxes = boxes.withColumn("parent", F.shiftright("cell", level - above))
        left = boxes.select(F.col("parent").alias("cell_parent"), "cell", "n", *[F.col(name).alias(f"own_{name}") for name, _ in sides])
        right = boxes.select(F.col("parent").alias("other_parent"), F.col("cell").alias("other"), F.col("n").alias("other_n"), *[name for name, _ in sides])
        if pairs is None:  # below the root, 32 boxes at most
            pairs = left.join(right, F.col("cell_parent") == F.col("other_parent"))
        else:
            pairs = pairs.join(left, "cell_parent").join(right, "other_parent")
        gap = sum((_gap(F.col(f"own_low{k}"), F.col(f"own_high{k}"), k) for k in range(leading)), F.lit(0.0))
        pairs = pairs.filter(gap <= reach**2)
        if level < depth:
            pairs = materialize(pairs.select(F.col("cell").alias("cell_parent"), F.col("other").alias("other_parent")), "near-cells")
    return materialize(pairs.select("cell", "n", "other", "other_n", *[name for name, _ in sides]), "near-cells")


def _gap(low: Column, high: Column, k: int) -> Column:
    """The square of what lies between two boxes along axis k."""
    gap = F.greatest(low - F.col(f"high{k}"), F.col(f"low{k}") - high, F.lit(0.0))
    return gap * gap


def _blocks(nodes: DataFrame, n: int, axes: np.ndarray, reach: float, block: int, deep: int) -> DataFrame:
    """nodes (node, copies, vector, unit) as (node, copies, vector, block, other): once for each block that the vector may reach.

    A cell that is too large for a block is dealt into several by hash.
    """
    spark, size = nodes.sparkSession, axes.shape[0]
    depth = math.ceil(math.log2(max(LEAST_CELLS, n / block)))
    first = min(depth, deep)
    second = min(depth - first, deep)
    sample = np.array(nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("unit").toArrow()["unit"].to_pylist()).reshape(-1, size)
    rounds = [cuts_of(sample @ axes[:, :LEADING], first)]
    kind = nodes.schema["vector"].dataType.simpleString()
    schema = f"node long, copies long, vector {kind}, lead array<double>, cell long"
    if second:
        share = min(1 << 30, math.ceil((1 << 30) * CELL_SAMPLE * 2 ** (first + second) / n))
        drawn = nodes.filter(F.pmod(F.xxhash64(F.lit("cut"), "node"), F.lit(1 << 30)) < share)
        drawn = drawn.mapInArrow(_in_cells(axes, spark.sparkContext.broadcast(rounds)), schema).select("cell", "lead")
        cuts = drawn.groupBy("cell").applyInArrow(_cuts(second), "cell long, axis array<long>, value array<double>").toArrow()
        axis, value = np.zeros((2**first, 2**second - 1), np.int64), np.full((2**first, 2**second - 1), np.inf)
        for k, of_axis, of_value in zip(cuts["cell"].to_pylist(), cuts["axis"], cuts["value"], strict=True):
            axis[k], value[k] = of_axis.values.to_numpy(zero_copy_only=False), of_value.values.to_numpy(zero_copy_only=False)
        rounds = [*rounds, (axis, value)]
    rows = materialize(nodes.mapInArrow(_in_cells(axes, spark.sparkContext.broadcast(rounds)), schema), "nodes")
    leading = min(LEADING, size)
    near = _near(rows, first + second, reach, leading)
    parts = lambda c: F.ceil(F.col(c) / math.ceil(1.25 * block))
    rows = rows.join(near, "cell")
    gap = sum((_gap(F.get("lead", F.lit(k)), F.get("lead", F.lit(k)), k) for k in range(leading)), F.lit(0.0))
    rows = rows.filter(gap <= reach**2).withColumn("block", F.shiftleft("cell", 24) + F.pmod(F.xxhash64("node"), parts("n")))
    return rows.select("node", "copies", "vector", "block", F.explode(F.sequence(F.shiftleft("other", 24), F.shiftleft("other", 24) + parts("other_n") - 1)).alias("other"))


def vector_links(nodes: DataFrame, size: int, threshold: float, block: int | None = None, deep: int = DEEP) -> DataFrame:
    """(node, links, with) over nodes (node, copies, vector of ``size``, unit): each pair within reach is compared in one
    task, which sums links and joins classes before it hands them on."""
    n = nodes.count()
    axes = np.eye(size)
    if n > 1 and size > 1:
        axes = PCA(k=size, inputCol="unit", outputCol="axes").fit(nodes.select(array_to_vector("unit").alias("unit"))).pc.toArray()
    block = block or min(BLOCK, max(TILE // 4, BLOCK_VALUES // size))
    pairs = _blocks(nodes, n, axes, math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6, block, deep)
    pairs = pairs.select(F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "copies", "vector")
    return pairs.groupBy("left", "right").applyInArrow(_compare(axes, threshold), "node long, links long, with long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, few: int = FEW, block: int | None = None, deep: int = DEEP) -> DataFrame:
    """One row for each vector: id, n_links (other vectors of cosine >= threshold), component_id (smallest id
    reachable by links, itself included) and kept (id = component_id).

    Equal vectors are one node with a count, so copies are never compared with each other. Vectors that are null,
    empty or zero or hold null or non-finite components link with nothing, nor do rows with a null id (component_id
    null, kept false). Vectors of different lengths do not link. Rows that repeat an id and vector are vectors of
    their own that link. Ids are taken to be unique up to repeated rows. An empty table gives an empty table. Other
    columns are not read.

    Lengths of more than ``few`` different vectors have axes and a job of their own; the others share one. block: vectors
    of a block (by default set by their length); deep: halvings of each of the two rounds of cuts. Vectors with
    over a thousandth of all copies, a thousand at most, get their result by a broadcast, the others by a join.
    """
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), vector.alias("vector"), _usable(vector).alias("usable"))
    rows = rows.withColumn("usable", F.col("usable") & F.col("id").isNotNull())
    rows = rows.withColumn("digest", F.when(F.col("usable"), F.sha2(F.col("vector").cast("string"), 256)))
    nodes = rows.filter("usable").groupBy("digest", "vector").agg(F.min("id").cast("long").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select("digest", "node", "copies", F.size("vector").alias("size"), "vector")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema], "unit array<double>"])
    nodes = materialize(nodes.mapInArrow(_with_unit, schema), "vectors")
    found = nodes.filter(F.lit(False)).select("node", F.col("copies").alias("links"), F.col("node").alias("with"))
    several = materialize(nodes.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).filter("n > 1 or copies > 1"), "vector-sizes")
    small = nodes.select("node", "copies", "vector", "size").join(several.filter(F.col("n").between(2, few)).select("size"), "size", "left_semi")
    found = found.union(small.groupBy("size").applyInArrow(_compare(None, threshold), "node long, links long, with long"))
    for (size,) in several.filter(F.col("n") > few).select("size").orderBy("size").collect():  # n / few at most
        found = found.union(vector_links(nodes.filter(F.col("size") == size).select("node", "copies", "vector", "unit"), size, threshold, block, deep))
    found = materialize(found, "vector-links")
    component = connected_components(found, "node", "with").withColumnRenamed("id", "node")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("digest", "node", "copies").join(sums, "node", "left").join(component, "node", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = materialize(named.select("digest", "copies", n_links, F.coalesce("component", "node").alias("component_id")), "vectors-named")
    total = named.agg(F.sum("copies")).first()[0] or 0
    is_large = F.col("copies") * 1000 > total
    large, usable = F.broadcast(named.filter(is_large).drop("copies")), rows.filter("usable").select("id", "digest")
    rest = usable.join(large.select("digest"), "digest", "left_anti").join(named.filter(~is_large).drop("copies"), "digest")
    alone = rows.filter(~F.col("usable")).select("digest", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    out = alone.unionByName(usable.join(large, "digest")).unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"))
