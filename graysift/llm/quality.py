"""Quality grades by ordinal cumulative-link regression over hashed words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash space of words and of word shapes.
DIM = 1 << 18
#: Bound of the labelled sample that a fit collects.
MAX_RATED = 6000

_LOWER, _UPPER, _DIGIT, _MANY = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+"), re.compile(r"(.)\1{2,}")


def slots(word: str) -> tuple[int, int]:
    """Where a word and its shape (runs of letters and digits as one mark each) are hashed to."""
    shape = _MANY.sub(r"\1\1", _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", word))))
    return xxhash.xxh32_intdigest("w" + word.lower()) % DIM, xxhash.xxh32_intdigest("s" + shape) % DIM


def spread_slot(distinct: int, n: int) -> int:
    """The slot for the share of distinct words, in tenths."""
    return xxhash.xxh32_intdigest(f"d{10 * distinct // max(n, 1)}") % DIM


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: distinct words, length one together; shapes by share; distinct share."""
    counts = Counter(text.split())
    n, d = sum(counts.values()), len(counts)
    found: dict[int, float] = {spread_slot(d, n): 1.0}
    for word, k in counts.items():
        a, b = slots(word)
        found[a] = found.get(a, 0.0) + d**-0.5
        found[b] = found.get(b, 0.0) + 4.0 * k / n
    return np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(score - thresholds[k - 1]), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, steps: int = 150, rate: float = 0.15, ridge: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam over (grade, slots, values) rows.

    The thresholds start at the smoothed share of each grade, and stay there if there are no rows.
    """
    share = np.bincount([g for g, _, _ in rows], minlength=grades).astype(float) + 1
    above = 1 - np.cumsum(share / share.sum())[:-1]
    first = np.log((1 - above) / above)
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    if not rows:
        return OrdinalModel(np.zeros(DIM, np.float32), first)
    index = np.concatenate([i for _, i, _ in rows])
    value = np.concatenate([v for _, _, v in rows]).astype(float)
    starts = np.cumsum([0] + [len(i) for _, i, _ in rows[:-1]])
    owner = np.repeat(np.arange(len(rows)), [len(i) for _, i, _ in rows])
    grade = np.array([g for g, _, _ in rows])
    used, index = np.unique(index, return_inverse=True)
    p = np.concatenate([np.zeros(len(used)), [first[0]], gaps])
    m, v, k = np.zeros_like(p), np.zeros_like(p), len(used)
    for step in range(1, steps + 1):
        steps_up = np.exp(p[k + 1 :])
        theta = np.concatenate([[-np.inf], p[k] + np.concatenate([[0], np.cumsum(steps_up)]), [np.inf]])
        score = np.add.reduceat(value * p[index], starts)
        low, high = (1 / (1 + np.exp(np.clip(t - score, -40, 40))) for t in (theta[grade], theta[grade + 1]))
        mass = np.maximum(low - high, 1e-12)
        g = np.zeros_like(p)
        g[:k] = -np.bincount(index, value * (1 - low - high)[owner], k) + ridge * len(rows) * p[:k]
        d_theta = np.bincount(grade, low * (1 - low) / mass, grades + 1) - np.bincount(grade + 1, high * (1 - high) / mass, grades + 1)
        after = np.cumsum(d_theta[1:grades][::-1])[::-1]
        g[k] = after[0]
        g[k + 1 :] = after[1:] * steps_up
        g /= len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIM, np.float32)
    weights[used] = p[:k]
    return OrdinalModel(weights, p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))]))


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", max_rated: int = MAX_RATED) -> OrdinalModel:
    """Fits on at most ``max_rated`` rated documents, the first by hash of their id. ratings: id, grade.

    Grades outside 0..grades-1 and null grades are left out; of several ratings of a document the lowest counts.
    """
    rated = ratings.filter(F.col("grade").between(0, grades - 1)).groupBy(id_col).agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64(id_col), id_col).limit(max_rated)
    rows = docs.select(id_col, text_col).join(F.broadcast(rated), id_col).select("grade", F.col(text_col).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["grade"].cast(pa.int32()), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["grade", "slots", "vals"]
            )

    got = rows.mapInArrow(vectors, "grade int, slots binary, vals binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["grade"], r["slots"], r["vals"]))
    return fit([(r["grade"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in got], grades)


class _Weights(dict):
    """Weights of a word and of its shape, remembered for the words met lately."""

    def __init__(self, weights: np.ndarray, keep: int = 100_000):
        self.weights, self.keep = weights, keep

    def __missing__(self, word: str) -> tuple[float, float]:
        if len(self) >= self.keep:
            self.clear()
        a, b = slots(word)
        self[word] = found = (float(self.weights[a]), float(self.weights[b]))
        return found


def grade(docs: DataFrame, model: OrdinalModel, text_col: str = "text", select_grade: int = 1, select_at: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_1 .. tail_{K-1} (P(grade >= k)) and selected (that tail >= select_at).

    Whole texts are scored, one pass, no shuffle. Null counts as empty. An empty text has no words; its score
    is that of its distinct share alone. Rows that repeat an id are graded each, and alike if their texts are. Very long
    texts are held one at a time, as their counts of different words. Result columns replace columns of the same name,
    other columns pass through. Ties at the bound are selected. An empty table gives an empty table.
    """
    k = len(model.thresholds)
    new = ["expected_grade", *[f"tail_{i + 1}" for i in range(k)], "selected"]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        get = _Weights(weights).__getitem__
        for batch in batches:
            scores = []
            for text in batch.column(text_at).to_pylist():
                counts = Counter((text or "").split())
                n, d, words, shapes = sum(counts.values()), len(counts), 0.0, 0.0
                for word, times in counts.items():
                    a, b = get(word)
                    words += a
                    shapes += b * times
                scores.append(float(weights[spread_slot(d, n)]) + (words * d**-0.5 + 4.0 * shapes / n if n else 0.0))
            tails = shared.value.tails(np.array(scores))
            columns = [pa.array(tails.sum(axis=1)), *[pa.array(tails[:, i]) for i in range(k)], pa.array(tails[:, select_grade - 1] >= select_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "expected_grade double", *[f"tail_{i + 1} double" for i in range(k)], "selected boolean"])
    return docs.mapInArrow(score, schema)


def ratings_from_labels(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 poor, 1 sound but toxic, 2 good. A null toxic label counts as 0."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return labels.filter("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(toxic, 1).otherwise(2).alias("grade"))
