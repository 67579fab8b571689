"""The engine's queries over the standard tables, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graysift.functions import checks, text as tx
from graysift.functions.rules import ADVICE, NAME, RULES, SPECIAL
from graysift.operators import ai, provenance as pv
from graysift.operators.detect import FINDINGS, rule_hits, special_hits
from graysift.operators.redact import redact, redacted_texts
from graysift.operators.registry import Registry
from graysift.operators.score import merge_findings, rank, severity_of, summarise
from graysift.plans import samples, sql
from graysift.plans.report import report_json
from graysift.plans.scan import scan
from graysift.sources.files import extract_text, kind_of
from graysift.sources.markup import html_text
from graysift.sources.shared import shared_path
from graysift.sources.tree import file_contents, file_digests, list_tree, write_files

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return docs.unionByName(spark.createDataFrame(samples.TEXTS, "doc_id long, text string").withColumn("source", F.lit("samples")))


def _rule_query(rule, no: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Different values of the rule in each text, 25 at most, with their places."""
        rows = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike(rule.guard))
        rows = rows.withColumn("hits", rule_hits("text", rule, no)["found"]).select("doc_id", "text", F.explode("hits").alias("h"))
        mask = tx.mask_secret if rule.category == "geheim" else tx.mask
        start = F.col("h.start")
        return rows.select(
            "doc_id", start.cast("long").alias("start"), F.col("h.value").alias("value"), mask(F.col("h.value")).alias("masked"), tx.line_number(F.col("text"), start).cast("long").alias("line"),
            tx.snippet(F.col("text"), start, F.length("h.value")).alias("context"),
        )

    return query


def special_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = F.concat(*[special_hits("text", s[2], k) for k, s in enumerate(SPECIAL)])
    rows = docs.select("doc_id", F.explode(hits).alias("h"))
    types = F.array(*[F.lit(s[0]) for s in SPECIAL])
    return rows.select("doc_id", F.get(types, F.col("h.no")).alias("type"), F.col("h.value").alias("terms"), F.size("h.terms").cast("long").alias("n"), F.col("h.start").cast("long").alias("start"))


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged and weighed findings in report order."""
    # inline() takes whole rows of the array; fields taken from posexplode() would be computed one by one.
    rows = scan(texts(spark, sf_dir)).select("doc_id", F.inline(F.transform("findings", lambda f, i: F.struct(i.cast("long").alias("pos"), f.alias("f")))))
    rows = rows.select("doc_id", "pos", F.inline(F.array("f")))
    return rows.select("doc_id", "pos", "type", "label", "severity", "value", "masked", F.col("line").cast("long").alias("line"), F.col("n").cast("long").alias("n"))


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(texts(spark, sf_dir)).select("doc_id", "verdict", "advice", F.size("findings").cast("long").alias("n_findings"), F.size("warnings").cast("long").alias("n_warnings"))


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(scan(texts(spark, sf_dir)), "middel", names=False)


def verdict_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(texts(spark, sf_dir)).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("findings")).cast("long").alias("findings"))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(texts(spark, sf_dir)).withColumn("r", redact(F.col("text"), F.col("findings")))
    return rows.select("doc_id", F.sha2("r.text", 256).alias("text_sha256"), F.col("r.n").cast("long").alias("replaced"))


def redacted_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with all values replaced, also those beyond the report's caps."""
    rows = redacted_texts(scan(texts(spark, sf_dir), every=True))
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "replaced")


def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of each text as findings of its name (the first), of its text and, in capitals, of a model (every second),
    merged."""
    rows = texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.contains("text", F.lit("@")))
    found = tx.let(tx.matches("text", RULES[3].pattern), lambda m: F.concat(*[F.transform(F.filter(m, keep), make) for keep, make in _SOURCES]))
    rows = rows.select("doc_id", merge_findings(found.cast(FINDINGS)).alias("f"))
    rows = rows.select("doc_id", F.inline(F.transform("f", lambda f, i: F.struct(i.cast("long").alias("pos"), f["value"].alias("value"), f["n"].cast("long").alias("n"), f["severity"].alias("severity"), f["in_filename"].alias("in_filename")))))
    return rows


def _as_finding(m, i, source: str, severity, by_name: bool, upper: bool = False):
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit("email").alias("type"), none.alias("label"), severity.alias("severity"), F.lit("contact").alias("category"), none.alias("note"), (F.upper(m["value"]) if upper else m["value"]).alias("value"),
        none.alias("masked"), F.lit(0).alias("line"), none.alias("context"), F.lit(source).alias("source"), F.lit(1).alias("n"), F.lit(by_name).alias("in_filename"), F.lit(False).alias("is_signal"),
        F.lit(None).cast("array<string>").alias("terms"), none.alias("rationale"), none.alias("confidence"),
    )


#: Which matches are findings of the name, the text and the model, and as what.
_SOURCES = (
    (lambda m, i: i == 0, lambda m, i: _as_finding(m, i, "patroon", F.lit("middel"), True)),
    (lambda m, i: i >= 0, lambda m, i: _as_finding(m, i, "patroon", F.lit("middel"), False)),
    (lambda m, i: i % 2 == 0, lambda m, i: _as_finding(m, i, "ai", F.when(i % 3 == 1, "hoog").otherwise("laag"), False, True)),
)


def conversation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), id_col="conv_id")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), severity_of(F.max(rank(F.col("verdict")))).alias("verdict"), F.sum(F.size("findings")).cast("long").alias("findings"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text")), id_col="page_id")
    return rows.select("page_id", "verdict", F.size("findings").cast("long").alias("n_findings"))


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(texts(spark, sf_dir))
    return rows.select("doc_id", report_json(rows).alias("report"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ai.text_chunks(table(spark, sf_dir, "documents"), size=6000, overlap=200, most=None)
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n_chunks").cast("long").alias("n_chunks"), F.col("start").cast("long").alias("start"), F.length("chunk").cast("long").alias("length"))


def ai_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a model's replies to all chunks of each document (each says what stands there) and to samples."""
    docs = ai.text_chunks(table(spark, sf_dir, "documents"), most=None)
    told = F.to_json(F.struct(F.array(F.struct(F.lit("naam").alias("type"), F.substring("chunk", 1, 20).alias("fragment"), F.lit("hoog").alias("ernst")), F.struct(F.lit("naam").alias("type"), F.lit("nergens te vinden").alias("fragment"), F.lit("hoog").alias("ernst"))).alias("bevindingen"), F.lit("kort").alias("samenvatting")))
    docs = docs.select("doc_id", "chunk_no", "n_chunks", "chunk", told.alias("content"), F.lit(None).cast("string").alias("error"))
    said = spark.createDataFrame(samples.REPLIES, "doc_id long, chunk_no int, n_chunks int, chunk string, content string, error string").withColumn("doc_id", F.col("doc_id") + 90_000_000)
    rows = ai.ai_results(docs.unionByName(said))
    return rows.select("doc_id", F.size("ai_findings").cast("long").alias("n_findings"), F.array_join(F.transform("ai_findings", lambda f: f["value"]), "|").alias("fragments"), "ai_summary", F.size("ai_warnings").cast("long").alias("n_warnings"), "ai_used")


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number checks over numbers made from order keys. Products are decimals: keys above 88068 take them past 64 bits."""
    n = F.col("o_orderkey")
    last = lambda by, places: (n.cast("decimal(19,0)") * F.lit(Decimal(by)) % F.lit(Decimal(10**places))).cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(last(7919, 9), 9, "0").alias("nine"), F.lpad(last(104_729_987_654_321, 16), 16, "4").alias("sixteen"))
    iban = F.concat(F.lit("NL"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("ABNA0"), "nine")
    return rows.select("o_orderkey", checks.valid_bsn(F.col("nine")).alias("bsn"), checks.valid_luhn(F.col("sixteen")).alias("luhn"), F.coalesce(checks.valid_iban(iban), F.lit(False)).alias("iban"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pv.fingerprint(F.coalesce("text", F.lit("")).cast("binary")).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a registry of the fingerprints of all documents that the labels rate."""
    files = fingerprints(spark, sf_dir).withColumn("tag_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("tag-"), F.col("doc_id"))))
    known = fingerprints(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.select("sha256", F.concat(F.lit("label-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("label_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2 == 0).alias("signature_valid"))
    return pv.check_registry(files, known).select("doc_id", "state", "label_id")


def registry_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' facts added to a registry in three batches, each of them twice, and the registry that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("label-"), F.coalesce("source", F.lit(""))).alias("label_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    docs = docs.withColumn("marked_sha256", F.when(F.col("doc_id") % 2 == 0, F.sha2(F.concat("sha256", "label_id"), 256)))
    registry = Registry(spark, shared_path(spark, "registry"))
    for batch in (0, 1, 2, 1, 0, 2):
        registry.add(pv.registration_facts(docs.filter(F.col("doc_id") % 3 == batch)), batch)
    return registry.table().select("label_id", "sha256", "kind", F.col("batch").cast("long").alias("batch"))


def label_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(spark, sf_dir)
    fields = {f: F.concat(F.lit(f"{f}-"), F.col("doc_id").cast("string")) for f in ("id", "digitalSourceType", "sig", "keyId", "verifyUrl", "disclosure")}
    label = F.struct(*[c.alias(f) for f, c in fields.items()], F.col("sha256").alias("sha256Original"))
    return rows.select("doc_id", F.explode(pv.tag_map(label)).alias("tag", "content"))


def _picked(key, by: int, items: tuple):
    return F.get(F.array(*map(F.lit, items)), (F.floor(key / by) % len(items)).cast("int"))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for each part, its properties made from the part's key and size."""
    key = F.col("p_partkey")
    made = {n: _picked(key, by, items) for n, (by, items) in samples.VIDEO.items()}
    made["crf"] = made["crf"].cast("long") + F.col("p_size") % 3
    return table(spark, sf_dir, "part").select(key.alias("id"), *[c.alias(n) for n, c in made.items()], (1.0 + (key % 130) / F.lit(10.0)).alias("ratio"))


def badge_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = pv.badge(F.col("width"), F.col("height"), F.col("sar"), F.col("scale"), F.col("ratio"), F.col("corner"))
    return _videos(spark, sf_dir).select("id", b.alias("b")).select("id", *[F.col(f"b.{c}").alias(c) for c in ("height", "margin", "width", "x", "y", "image_width", "image_height", "scaled_width")])


def codec_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _videos(spark, sf_dir).select(
        "id", pv.audio_choice(F.col("container"), F.split("codecs", ",")).alias("audio"), pv.color_matrix(F.col("space"), F.col("width"), F.col("height")).alias("matrix"),
        pv.crf(F.col("container"), F.col("crf")).cast("long").alias("crf"),
    )


def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a number and sizes of all magnitudes, made from the pages' ids."""
    key = F.col("page_id")
    name = F.concat(F.lit("brief_"), F.lpad((key * 7919 % 1_000_000_000).cast("string"), 9, "1"), F.lit("."), _picked(key, 1, samples.FILE_KINDS))
    size = (key % 1000 + 1) * F.pow(F.lit(10.0), F.floor(key / 5) % 14).cast("long") + 1
    rows = scan(table(spark, sf_dir, "pages").select(key.alias("doc_id"), name.alias("name"), size.alias("bytes"), F.lit("").alias("text")))
    return rows.select("doc_id", kind_of(F.col("name")).alias("kind"), tx.human_size(F.col("bytes")).alias("size"), "verdict", tx.duration(F.col("bytes") / 1e6).alias("shown"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as files of a folder in the shared folder, listed, digested and read back; names begin with _."""
    rows = table(spark, sf_dir, "pages").select(F.format_string("%d/_%d.html", F.col("page_id") % 16, F.col("page_id")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    folder = shared_path(spark, "page-files")
    write_files(rows, folder)
    files = list_tree(spark, folder)
    digests = file_digests(files).select("path", "sha256")
    read = extract_text(file_contents(files)).join(digests, "path")
    return read.select("name", "kind", "bytes", "readable", "sha256", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def local_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", checks.local_endpoint(F.col("url")).alias("local"))


QUERIES: dict[str, Query] = {f"findings_{r.type}": _rule_query(r, k) for k, r in enumerate((*RULES, NAME))} | {
    q.__name__: q
    for q in (
        special_categories, document_findings, document_verdicts, verdict_summary, verdict_by_source, redacted_documents, redacted_every, merged_findings, conversation_verdicts, page_text, page_verdicts, report_documents,
        text_chunks, ai_findings, checksums, fingerprints, registry_check, registry_growth, label_tags, badge_geometry, codec_choices, file_facts, page_files, local_pages,
    )
}
SQL: dict[str, str] = sql.queries()
