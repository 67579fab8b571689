"""Token counts by counting each distinct pre-token once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import materialize
from graysift.llm.tokens import vocabulary_path

PIECE_BPE = "piece_bpe_32k.model"
#: Bounds of the table of frequent pre-tokens that goes to every executor: entries of at most SHORT characters, and
#: longer ones with the characters of one (rulers, banners, blobs that many documents hold).
HEAD, SHORT, LONG_HEAD, LONG_CHARS = 240_000, 64, 1000, 16_384
#: Documents in the sample that proposes the frequent pre-tokens (it decides where they are counted, not how).
SAMPLE_DOCS = 20_000

_RUN = re.compile(" +[^ ]*")


@lru_cache(maxsize=4)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pretokens(text: str) -> list[str]:
    """Parts of a text that the model counts independently, each without the space that starts it.

    The model sets a space before the text, writes each space as its own mark, and no piece holds a mark after
    another character; so a text can be cut before each run of spaces. An empty part is one lone space, or
    the empty text. A text that itself holds the mark is one part.
    """
    parts = text.split(" ")
    if "▁" in text:
        return [text]
    if "" in parts and text:
        return [p[1:] for p in _RUN.findall(" " + text)]
    return parts


def count_pieces(path: str, parts: list[str]) -> list[int]:
    """Tokens of each pre-token; a lone space (the empty part) is one token."""
    found = _library(path).encode(parts, num_threads=1)
    return [len(ids) if part else 1 for part, ids in zip(parts, found, strict=True)]


def pretoken_counts(parts: DataFrame, path: str) -> DataFrame:
    """part -> tokens, over rows that each hold one distinct pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["part"], pa.array(count_pieces(path, batch["part"].to_pylist()), pa.int64())], ["part", "tokens"])

    return parts.select("part").mapInArrow(count, "part string, tokens long")


def dealt(rest: DataFrame) -> DataFrame:
    """Rows (row, part, n) in tasks, equal parts together and one after the other. Parts of more than LONG_CHARS
    characters, which are never among the frequent ones, are spread by row, so that copies of one fill no single task."""
    key = F.when(F.length("part") > LONG_CHARS, F.col("row")).otherwise(F.xxhash64("part"))
    return rest.select("row", "part", "n").repartition(key).sortWithinPartitions("part")


def row_tokens(rest: DataFrame, path: str) -> DataFrame:
    """row -> tokens of its part, times n, over rows as dealt() gives them: a task counts each of its different parts once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            parts = batch["part"].dictionary_encode()
            different = parts.dictionary.to_pylist()
            fresh = [p for p in different if p not in known]
            # parts are in order, so only the last batch's may come again
            known = {p: known[p] for p in different if p in known} | dict(zip(fresh, count_pieces(path, fresh), strict=True))
            tokens = np.array([known[p] for p in different], np.int64)[parts.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(tokens * batch["n"].to_numpy())], ["row", "tokens"])

    return rest.mapInArrow(count, "row long, tokens long")


def frequent_pretokens(texts: DataFrame, head: int, long_head: int = LONG_HEAD) -> DataFrame:
    """part: the most frequent pre-tokens of a sample, ``head`` short and ``long_head`` long ones at most."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(p for text in batch["text"].to_pylist() if text for p in set(pretokens(text)) if p and len(p) <= LONG_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["part", "n"])

    share = min(1.0, SAMPLE_DOCS / max(1, texts.count()))
    counts = texts.select("text").sample(share, seed=7).mapInArrow(parts, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    short = counts.filter(F.length("part") <= SHORT).orderBy(F.desc("n"), "part").limit(head)
    return short.union(counts.filter((F.length("part") > SHORT) & (F.col("n") > 1)).orderBy(F.desc("n"), "part").limit(long_head)).select("part")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row, as the sentencepiece model counts the whole text.

    One pass over the texts counts each document's pre-tokens. Frequent ones (proposed by a bounded sample, counted
    once and broadcast) are summed at once; the rest become rows (row, part, times), of which equal parts meet in one
    task, which counts them once and gives each row its product. So a part's letters are shuffled once. No ids are kept.
    A part that the sample missed is in few rows (168 of check_l's 256,410 documents at most), and copies of very long
    ones are spread over tasks.

    Null counts as empty: 0 tokens. Null ids and repeated ids keep a row each. Empty table: empty result. Very long
    texts are counted whole, as rows of their different pre-tokens. Other columns are not read, so none clashes.
    """
    spark, model = docs.sparkSession, model or vocabulary_path(PIECE_BPE)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = spark.sparkContext.broadcast(dict(pretoken_counts(frequent_pretokens(texts, head), model).toPandas().itertuples(index=False, name=None)) | {"": 1})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        get, row = known.value.get, TaskContext.get().partitionId() << 36
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                piece = batch.slice(begin, 512)
                heads: list[tuple] = []
                keys, parts, times = [], [], []
                for text in piece["text"].to_pylist():
                    row += 1
                    total = 0
                    if text:
                        for part, n in Counter(pretokens(text)).items():
                            tokens = get(part)
                            if tokens is None:
                                keys.append(row)
                                parts.append(part)
                                times.append(n)
                            else:
                                total += tokens * n
                    heads.append((row, len(text.encode()) if text else 0, total))
                none, k = len(heads), len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h[0] for h in heads] + keys, pa.int64()),
                        pa.array(piece["doc_id"].to_pylist() + [None] * k, piece["doc_id"].type),
                        pa.array([h[1] for h in heads] + [None] * k, pa.int64()),
                        pa.array([None] * none + parts, pa.string()),
                        pa.array([h[2] for h in heads] + times, pa.int64()),
                    ],
                    ["row", "doc_id", "n_bytes", "part", "n"],
                )

    schema = f"row long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, part string, n long"
    found = materialize(texts.mapInArrow(rows, schema), "pretokens")
    rest = dealt(found.filter(F.col("part").isNotNull()))
    sums = row_tokens(rest, model).groupBy("row").agg(F.sum("tokens").alias("rest"))
    base = found.filter(F.col("part").isNull()).select("row", "doc_id", "n_bytes", F.col("n").alias("head"))
    tokens = F.col("head") + F.coalesce(F.col("rest"), F.lit(0))
    return base.join(sums, "row", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
