"""Findings of a language model: what to ask, and what of its replies to keep.

The model itself is a function that the caller supplies; replies(...) runs it on executors, chunk by chunk. All that
follows works on the table of replies (id, chunk_no, content, error).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.functions import text as tx
from graysift.functions.rules import HIGH, LOW, MEDIUM, SAID
from graysift.operators.detect import FINDINGS, let
from graysift.sources.shared import shared_path
from graysift.sources.tree import open_store

#: Findings of a reply that are looked at, chunks of a text that are asked about.
MAX_REPLY_FINDINGS, MAX_CHUNKS = 40, 40


def text_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 6000, overlap: int = 200, most: int | None = MAX_CHUNKS) -> DataFrame:
    """(id, chunk_no from 1, n_chunks, start, chunk): the first ``most`` chunks of each text that is not empty; None: all."""
    pieces = tx.chunks(F.col(text_col), size, overlap)
    rows = docs.filter(F.length(text_col) > 0).select(id_col, pieces.alias("p"))
    taken = F.col("p") if most is None else F.slice("p", 1, most)
    rows = rows.select(id_col, F.size("p").alias("n_chunks"), F.posexplode(taken).alias("i", "c"))
    return rows.select(id_col, (F.col("i") + 1).alias("chunk_no"), "n_chunks", F.col("c.start").alias("start"), F.col("c.text").alias("chunk"))


def replies(chunks: DataFrame, ask: Callable[[list[str]], list[str | None]], id_col: str = "doc_id", memory: str | None = None) -> DataFrame:
    """Adds content and error to chunks (id, chunk_no, n_chunks, chunk): ask takes one chunk at a time, as a list of one, and
    returns its reply; if it raises, that row gets the error.

    A document's chunks are asked in order in one task, and not after one of them failed: the rest have neither content
    nor error, and other documents go on. Each reply, and each failure, is put into a file of the memory, a folder, before
    the next chunk is asked; its name is a digest of the document and the chunk. Whatever makes a task run again (another
    action, a lost executor) finds them there and asks nothing twice but what was under way. Without a memory a new folder
    in the shared one is taken; a memory of an earlier run spares its questions. ask runs in Python workers, so it must be
    picklable.
    """
    memory = memory or shared_path(chunks.sparkSession, "replies")
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.sha2("chunk", 256)), 256)
    rows = chunks.withColumn("__key", key).repartition(id_col).sortWithinPartitions(id_col, "chunk_no")
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered, failed_id = Memory(memory), object()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                content = error = None
                if (own := row[id_col][0].as_py()) != failed_id:
                    known = remembered.get(row["__key"][0].as_py())
                    if known is None:
                        try:
                            (content,) = ask([row["chunk"][0].as_py()])
                        except Exception as x:  # the model may fail in any way; the row says how
                            error = str(x) or type(x).__name__
                        remembered.put(row["__key"][0].as_py(), content, error)
                    else:
                        content, error = known
                    if error is not None:
                        failed_id = own
                yield pa.RecordBatch.from_arrays([*(row[n] for n in names), pa.array([content], pa.string()), pa.array([error], pa.string())], [*names, "content", "error"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema], "content string, error string"])
    return rows.mapInArrow(run, schema)


class Memory:
    """Replies by key, a file each, in a folder that all executors see."""

    def __init__(self, folder: str):
        self.store, self.root, _ = open_store(folder)

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> tuple[str | None, str | None] | None:
        try:
            with self.store.open_input_stream(self._path(key)) as f:
                found = json.loads(f.read())
        except FileNotFoundError:
            return None
        return found["content"], found["error"]

    def put(self, key: str, content: str | None, error: str | None) -> None:
        """Written beside its place and moved there, so that no half a reply is ever read."""
        path, new = self._path(key), f"{self._path(key)}.{uuid.uuid4().hex}"
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(new) as f:
            f.write(json.dumps({"content": content, "error": error}).encode())
        self.store.move(new, path)


class Refused(Exception):
    """What send() of a Chat raises if the endpoint answers with a status that is no success."""

    def __init__(self, status: int):
        super().__init__(f"HTTP {status} van het model")
        self.status = status


#: What the model is told to do. The names of the fields and their values are fixed.
INSTRUCTIONS = (
    "Je controleert een stuk tekst op persoonsgegevens voordat het gedeeld wordt. Noem namen, adressen, contactgegevens, nummers van personen, combinaties waaraan iemand te herkennen is, "
    "bijzondere categorieën, inloggegevens en vertrouwelijke bedrijfsgegevens; geen organisaties, functies zonder persoon of verzonnen voorbeelden. Neem elk fragment letterlijk over. Antwoord alleen met JSON: "
    '{"bevindingen":[{"type":"...","label":"...","ernst":"laag|middel|hoog","fragment":"...","toelichting":"...","zekerheid":"laag|middel|hoog"}],"samenvatting":"..."}'
)


@dataclass(frozen=True)
class Chat:
    """An ask for replies(): send takes the body of a request to a chat endpoint and returns its answer, both as dicts. An endpoint
    that refuses to be held to JSON (status 400 or 422) is asked again without."""

    send: Callable[[dict], dict]
    model: str
    instructions: str = INSTRUCTIONS

    def body(self, chunk: str, as_json: bool) -> dict:
        told = {"model": self.model, "messages": [{"role": "system", "content": self.instructions}, {"role": "user", "content": chunk}], "temperature": 0, "max_tokens": 1200, "stream": False}
        return told | ({"response_format": {"type": "json_object"}} if as_json else {})

    def __call__(self, chunks: list[str]) -> list[str]:
        return [self.reply(c) for c in chunks]

    def reply(self, chunk: str) -> str:
        try:
            answer = self.send(self.body(chunk, True))
        except Refused as x:
            if x.status not in (400, 422):
                raise
            answer = self.send(self.body(chunk, False))
        choices = answer.get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""


def reply_json(content: Column) -> Column:
    """The JSON object in a reply, as text: thoughts and a code fence around it are taken away; null if there is none."""
    plain = tx.strip(F.regexp_replace(content, r"(?i)<think>[\s\S]*?</think>", ""))
    fenced = F.regexp_extract(plain, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1)
    inner = F.when(plain.rlike(r"```[\s\S]*```"), tx.strip(fenced)).otherwise(plain)
    found = F.regexp_extract(inner, r"\{[\s\S]*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def _level(value: Column) -> Column:
    return F.when(F.lower(value).isin(LOW, MEDIUM, HIGH), F.lower(value)).otherwise(MEDIUM)


def reply_findings(chunk: Column, json: Column) -> Column:
    """The findings of a reply whose fragment stands in the chunk, white space aside, as findings of source ai."""
    items = F.try_variant_get(F.try_parse_json(json), "$.bevindingen", "array<variant>")
    field = lambda v, name, other: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(other))
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")

    def finding(v: Column, fragment: Column) -> Column:
        return F.struct(
            F.substring(F.lower(field(v, "type", "onbekend")), 1, 30).alias("type"), F.substring(field(v, "label", "Persoonsgegeven"), 1, 120).alias("label"), _level(field(v, "ernst", "")).alias("severity"),
            F.lit("ai").alias("category"), F.lit(None).cast("string").alias("note"), fragment.alias("value"), tx.mask(fragment).alias("masked"), F.lit(None).cast("int").alias("line"),
            F.lit(None).cast("string").alias("context"), F.lit("ai").alias("source"), F.lit(1).alias("n"), F.lit(False).alias("in_filename"), F.lit(False).alias("is_signal"),
            F.lit(None).cast("array<string>").alias("terms"), F.substring(field(v, "toelichting", ""), 1, 300).alias("rationale"), _level(field(v, "zekerheid", "")).alias("confidence"),
        )

    fragment = lambda v: F.substring(tx.strip(field(v, "fragment", "")), 1, 200)
    made = F.transform(F.slice(F.coalesce(items, F.array().cast("array<variant>")), 1, MAX_REPLY_FINDINGS), lambda v: let(fragment(v), lambda f: finding(v, f)))
    stands = lambda f: F.contains(chunk, f["value"]) | F.contains(squeeze(chunk), squeeze(f["value"]))
    return F.filter(made, lambda f: (f["value"] != "") & stands(f)).cast(FINDINGS)


def reply_summary(json: Column) -> Column:
    return F.substring(F.coalesce(F.try_variant_get(F.try_parse_json(json), "$.samenvatting", "string"), F.lit("")), 1, 400)


def ai_results(said: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ai_findings, ai_summary, ai_warnings, ai_used) from replies (id, chunk_no, n_chunks, chunk, content, error).

    A document's replies count up to its first chunk that failed or gave no JSON; what came before is kept. The
    first summary that is not empty counts. A document's group has a reply for each chunk asked about, MAX_CHUNKS unless
    text_chunks was told otherwise, so it is about as long as the text.
    """
    json = reply_json(F.coalesce("content", F.lit("")))
    rows = said.withColumn("__json", json).withColumn("__bad", F.col("error").isNotNull() | F.col("__json").isNull())
    rows = rows.select(
        id_col,
        F.struct(
            "chunk_no", F.col("__bad").alias("bad"), F.coalesce("error", F.lit(SAID["no_json"])).alias("why"), F.col("n_chunks").alias("n"),
            F.when(F.col("__bad"), F.array().cast(FINDINGS)).otherwise(reply_findings(F.col("chunk"), F.col("__json"))).alias("found"), reply_summary(F.col("__json")).alias("summary"),
        ).alias("r"),
    )
    docs = rows.groupBy(id_col).agg(F.array_sort(F.collect_list("r")).alias("r"))
    docs = docs.withColumn("stop", F.array_min(F.transform(F.filter("r", lambda x: x["bad"]), lambda x: x["chunk_no"])))
    docs = docs.withColumn("good", F.filter("r", lambda x: F.col("stop").isNull() | (x["chunk_no"] < F.col("stop"))))
    n, asked = F.get("r", F.lit(0))["n"], F.size("r")
    more = F.when(n > asked, F.format_string(SAID["chunks"], n, asked))
    why = F.get(F.filter("r", lambda x: x["chunk_no"] == F.col("stop")), F.lit(0))["why"]
    failed = F.when(F.col("stop").isNotNull(), F.format_string(SAID["failed"], "stop", asked, why))
    return docs.select(
        id_col, F.flatten(F.transform("good", lambda x: x["found"])).alias("ai_findings"),
        F.coalesce(F.get(F.filter(F.transform("good", lambda x: x["summary"]), lambda s: s != ""), F.lit(0)), F.lit("")).alias("ai_summary"),
        F.array_compact(F.array(more, failed)).alias("ai_warnings"), (F.size("good") > 0).alias("ai_used"),
    )


def model_names(listing: Column) -> Column:
    """Names of the models in an endpoint's listing: id, else name, of each entry of data or models."""
    v = F.try_parse_json(listing)
    entries = F.coalesce(F.try_variant_get(v, "$.data", "array<variant>"), F.try_variant_get(v, "$.models", "array<variant>"), F.array().cast("array<variant>"))
    named = F.transform(entries, lambda e: F.coalesce(F.try_variant_get(e, "$.id", "string"), F.try_variant_get(e, "$.name", "string")))
    return F.filter(named, lambda n: F.coalesce(n, F.lit("")) != "")


def pick_model(names: list[str], wanted: str | None = None) -> tuple[str | None, str | None]:
    """(model, warning): the first if none is wanted, else the wanted one, else the first whose name holds it (letter case
    counts), else the wanted one all the same with a warning. Without names there is no model."""
    if not names:
        return None, SAID["no_model"]
    if not wanted or wanted in names:
        return wanted or names[0], None
    matching = next((n for n in names if wanted in n), None)
    return matching or wanted, None if matching else SAID["other_model"] % (wanted, ", ".join(names))
