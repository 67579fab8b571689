"""Files of every kind, model replies, provenance and streaming."""

import hashlib
import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from graysift.operators import ai, provenance as pv
from graysift.operators.registry import Registry
from graysift.plans import catalog, samples
from graysift.plans.scan import scan
from graysift.plans.report import report_envelope
from graysift.plans.run import Options, run, write_run
from graysift.sources import tree
from graysift.sources.joined import write_joined
from graysift.sources.files import extract_text, listed, read_files
from graysift.sources.inflate import TooMuch, inflated, unzipped
from graysift.sources.pdf import CodeMap, code_map, pdf_text, shown_strings
from graysift.sources.markup import html_text
from graysift.streaming.verdicts import document_counts, each_batch, keep_counts, running_counts, scan_stream, write_changes


def docx(member: str, xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(member, xml)
    return out.getvalue()


def test_files_of_every_kind(spark, tmp_path):
    pdf = b"%PDF-1.4 stream\n" + zlib.compress(b"BT (BSN 206451374 en meer tekst \\(zie\\)) Tj [(A) 20 (B)] TJ <4142> Tj ET") + b"\nendstream"
    files = {
        "notitie.md": b"# Titel\nBSN 206451374\n", "test.docx": docx("word/document.xml", "<w:p><w:t>BSN 206451374</w:t></w:p>"), "leeg.docx": docx("other.xml", "x"), "wit.docx": docx("word/document.xml", "<w:p>\n\t </w:p>\n"), "kapot.docx": b"no zip",
        "foto.png": b"\x89PNG", "film.mp4": b"x", "a.pdf": pdf, "b.rtf": rb"{\rtf1 caf\'e9\par BSN 206451374}", "bin.dat": b"\0\1\2", "tekst.dat": b"gewoon", "p.html": "<p>&#72;&#x69; &amp;#65; &lt;b&gt;</p><script>x</script>".encode(),
        "bad.txt": b"a\xffb", "_verborgen.csv": b"naam;bsn\nx;206451374\n", ".punt.txt": b"x", "groot.txt": b"z" * 5000,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_map").mkdir()
    (tmp_path / "_map" / "b.txt").write_bytes(b"BSN 206451374")
    read = read_files(spark, str(tmp_path), max_bytes=4000)
    rows = {r["name"]: r for r in extract_text(read, max_bytes=4000).collect()}
    assert set(rows) == {*files, "b.txt"} - {".punt.txt"}
    assert len(rows["groot.txt"]["text"]) == 4000 and rows["groot.txt"]["truncated"] and rows["groot.txt"]["bytes"] == 5000
    assert [r["name"] for r in read_files(spark, str(tmp_path / ".punt.txt")).collect()] == [".punt.txt"]
    assert rows["test.docx"]["text"] == "--- word/document.xml ---\nBSN 206451374" and rows["wit.docx"]["text"] == ""
    assert not rows["leeg.docx"]["readable"] and not rows["kapot.docx"]["readable"] and rows["kapot.docx"]["note"]
    assert not rows["foto.png"]["readable"] and "zelf" in rows["foto.png"]["note"] and not rows["film.mp4"]["readable"]
    assert rows["a.pdf"]["text"] == "BSN 206451374 en meer tekst (zie) AB AB" and rows["b.rtf"]["text"] == "café\n BSN 206451374"
    assert not rows["bin.dat"]["readable"] and rows["tekst.dat"]["text"] == "gewoon"
    assert rows["p.html"]["text"].strip() == "Hi &#65; <b>" and rows["bad.txt"]["text"] == "a�b"
    verdicts = {r["name"]: r["verdict"] for r in scan(extract_text(read_files(spark, str(tmp_path))), id_col="path").collect()}
    assert verdicts["test.docx"] == "hoog" and verdicts["foto.png"] == "onbekend" and verdicts["tekst.dat"] == "geen"


def test_file_tree(spark, tmp_path):
    """Folders of any depth, skipped and hidden ones, links, bins of equal bytes, batches bounded by bytes."""
    root = tmp_path / "in"
    want = {}
    for k in range(300):
        at = root / f"{k % 7}" / "_x" / f"{k % 3}" / (f"_{k}.txt" if k % 2 else f".{k}")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes([k % 251]) * (k * 10))
        want[str(at)] = k * 10
    (root / "node_modules").mkdir()
    (root / "node_modules" / "a.js").write_text("x")
    (root / "loop").symlink_to(root)
    files = tree.list_tree(spark, str(root))
    assert {r["path"]: r["bytes"] for r in files.collect()} == want
    assert len(tree.list_tree(spark, str(root / "1")).collect()) == 43 and tree.list_tree(spark, str(root / "0" / "_x" / "0" / ".0")).collect()[0]["bytes"] == 0
    with pytest.raises(FileNotFoundError):
        tree.list_tree(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert tree.file_contents(tree.list_tree(spark, str(tmp_path / "empty"))).collect() == []
    read = tree.file_contents(files, max_bytes=500, bin_bytes=8 * tree.OPENING)
    cost = {r["p"]: r["c"] for r in read.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.col("bytes") + tree.OPENING).alias("c")).collect()}
    assert len(cost) == read.rdd.getNumPartitions() > 20 and max(cost.values()) <= 9 * tree.OPENING + 3000
    rows = read.collect()
    assert all(bytes(r["content"]) == bytes([int(r["name"].strip("_.txt")) % 251]) * min(500, r["bytes"]) for r in rows) and len(rows) == 300
    digests = {r["path"]: r["sha256"] for r in tree.file_digests(files).collect()}
    assert digests == {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in want}
    manifest = tree.binned(files, 1 << 40)
    reader = tree.TreeReader({"manifest": manifest, "maxBytes": "0"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == 300 and {r["failed"] for r in rows} == {None}
    gone = tree.file_contents(spark.createDataFrame([(str(tmp_path / "gone.txt"), 3)], "path string, bytes long")).first()
    assert gone["content"] is None and gone["failed"].startswith("Kon dit bestand niet lezen")


def test_batches_hold_few_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "BATCH_BYTES", 1000)
    for k in range(20):
        (tmp_path / f"{k}.txt").write_bytes(b"x" * 400)
    reader = tree.TreeReader({"manifest": tree.binned(tree.list_tree(spark, str(tmp_path))), "maxBytes": "0"})
    assert [b.num_rows for part in reader.partitions() for b in reader.read(part)] == [3] * 6 + [2]


def test_digest_of_a_long_file(spark, tmp_path):
    with open(tmp_path / "long.bin", "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)
    with open(tmp_path / "long.bin", "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    (got,) = tree.file_digests(tree.list_tree(spark, str(tmp_path))).collect()
    assert (got["bytes"], got["sha256"]) == (3 << 30, want)


def test_unpacking_is_bounded(spark, tmp_path):
    """What unpacks to a thousand times its size gives a note and little memory."""
    (tmp_path / "bom.docx").write_bytes(docx("word/document.xml", "<w:p>" + " " * 50_000_000))
    (tmp_path / "bom.pdf").write_bytes(b"%PDF-1.4 stream\n" + zlib.compress(b"BT (x) Tj " + b" " * 50_000_000) + b"\nendstream")
    (tmp_path / "klein.pdf").write_bytes(b"%PDF-1.4 stream\n" + zlib.compress(b"BT (genoeg tekst om te lezen) Tj") + b"\nendstream")
    rows = {r["name"]: r for r in extract_text(read_files(spark, str(tmp_path)), max_bytes=1 << 20).collect()}
    assert all(not rows[n]["readable"] and "betrouwbaar" in rows[n]["note"] for n in ("bom.docx", "bom.pdf")) and rows["klein.pdf"]["readable"]
    with pytest.raises(TooMuch):
        list(inflated(iter([b"x"] * 5), 4))
    data = zlib.compress(b"a" * 3_000_000)
    assert b"".join(unzipped(data)) == b"a" * 3_000_000 and max(map(len, unzipped(data))) <= 1 << 20


def test_listing(spark):
    paths = [("a/.hidden",), ("a/b.txt",), ("a/node_modules/c.js",), ("dist/x.txt",), ("a/a.txt",)]
    assert [r[0] for r in listed(spark.createDataFrame(paths, "path string"), most=5).collect()] == ["a/a.txt", "a/b.txt"]


def test_html(spark):
    cases = [("<style>p{}</style><p>A&nbsp;B</p><!-- weg -->", " A B"), (None, ""), ("&unknown; &#0;x", "&unknown; \x00x")]
    got = spark.createDataFrame(cases, "h string, want string").withColumn("got", html_text(F.col("h"))).collect()
    assert [(r["got"], r["want"]) for r in got if r["got"] != r["want"]] == []


def test_replies(spark):
    said = spark.createDataFrame(samples.REPLIES, "doc_id long, chunk_no int, n_chunks int, chunk string, content string, error string")
    rows = {r["doc_id"]: r for r in ai.ai_results(said).collect()}
    assert [f["value"] for f in rows[1]["ai_findings"]] == ["Noor Verhoeven", "veel wit en"] and rows[1]["ai_summary"] == "inschrijving van een kind"
    assert [f["severity"] for f in rows[1]["ai_findings"]] == ["middel", "middel"] and rows[1]["ai_findings"][1]["type"] == "naam"
    assert rows[2]["ai_findings"] == [] and rows[2]["ai_used"] and "deel 2/3" in rows[2]["ai_warnings"][0]
    assert not rows[3]["ai_used"] and "geen bruikbare JSON" in rows[3]["ai_warnings"][0]
    docs = spark.createDataFrame([(1, "Inschrijving voor Noor Verhoeven, klas 2B. BSN 206451374")], "doc_id long, text string")
    r = scan(docs, ai.ai_results(said)).first()
    assert r["verdict"] == "hoog" and r["ai_used"] and {"bsn", "naam"} <= {f["type"] for f in r["findings"]}


def test_asking(spark):
    chunks = ai.text_chunks(spark.createDataFrame([(1, "tekst"), (2, ""), (3, None)], "doc_id long, text string"))
    got = ai.replies(chunks, lambda texts: ['{"bevindingen":[],"samenvatting":"s"}' for _ in texts]).collect()
    assert [(r["doc_id"], r["error"]) for r in got] == [(1, None)]

    def down(texts):
        raise RuntimeError("weg")

    assert [r["error"] for r in ai.replies(chunks, down).collect()] == ["weg"]
    assert ai.pick_model(["a", "test-model-7b"], "7b") == ("test-model-7b", None) and ai.pick_model([])[0] is None and ai.pick_model(["a"]) == ("a", None)
    assert ai.pick_model(["Abc"], "abc")[0] == "abc" and "Abc" in ai.pick_model(["Abc"], "abc")[1]


def test_each_chunk_is_asked_once(spark, tmp_path):
    """One failure touches one document and ends its questions; other actions and later runs ask nothing again."""
    log = str(tmp_path / "log")

    def ask(texts):
        (text,) = texts
        with open(log, "a") as f:
            f.write(text + "\n")
        if "stuk2" in text:
            raise RuntimeError("geen antwoord")
        return ['{"bevindingen":[],"samenvatting":"' + text[:5] + '"}']

    rows = [(d, k, 3, f"doc{d} stuk{k if d == 2 else 9}{k}") for d in (1, 2, 3) for k in (1, 2, 3)] + [(None, 1, 1, "zonder")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, n_chunks int, chunk string").repartition(4)
    said = ai.replies(chunks, ask, memory=str(tmp_path / "memory"))
    for _ in range(3):
        got = {(r["doc_id"], r["chunk_no"]): (r["content"] is not None, r["error"]) for r in said.collect()}
    assert got == {(d, k): (d != 2 or k < 2, "geen antwoord" if (d, k) == (2, 2) else None) for d in (1, 2, 3) for k in (1, 2, 3)} | {(None, 1): (True, None)}
    results = {r["doc_id"]: r for r in ai.ai_results(said).collect()}
    assert results[2]["ai_warnings"] == ["AI-analyse van deel 2/3 mislukt: geen antwoord"] and results[2]["ai_used"] and results[1]["ai_warnings"] == results[3]["ai_warnings"] == []
    assert ai.replies(chunks, ask, memory=str(tmp_path / "memory")).count() == 10
    with open(log) as f:
        asked = f.read().splitlines()
    assert len(asked) == len(set(asked)) == 9 and asked.index("doc1 stuk91") < asked.index("doc1 stuk92") < asked.index("doc1 stuk93") and "doc2 stuk33" not in asked
    assert ai.replies(chunks, ask).filter("doc_id = 1").count() == 3


def test_a_run_asks_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"tekst {k}")
    log = str(tmp_path / "log")

    def ask(texts):
        with open(log, "a") as f:
            f.write("x")
        return ['{"bevindingen":[],"samenvatting":"s"}']

    results, summary = run(spark, str(tmp_path / "in"), ask=ask)
    assert results.filter("ai_used").count() == 3 and write_run(results, summary, str(tmp_path / "out"), redact=True) == 0
    with open(log) as f:
        assert f.read() == "xxx"


def test_chat():
    """The request, and the second one without JSON mode; other refusals are errors."""
    seen = []

    def send(body):
        seen.append(body)
        if body["model"] == "weg":
            raise ai.Refused(500)
        if "response_format" in body:
            raise ai.Refused(422)
        return {"choices": [{"message": {"content": "ja"}}]}

    assert ai.Chat(send, "m")(["tekst"]) == ["ja"] and [len(b["messages"]) for b in seen] == [2, 2] and seen[1]["messages"][1]["content"] == "tekst"
    with pytest.raises(ai.Refused, match="HTTP 500 van het model"):
        ai.Chat(send, "weg")(["tekst"])
    assert ai.Chat(lambda body: {}, "m")(["x"]) == [""]


def test_query_asks_about_all_chunks(spark, tmp_path):
    texts = [(1, "kort stuk"), (2, "".join(f"woord{i:06d} " for i in range(2000))), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.ai_findings(spark, str(tmp_path)).collect() if r["doc_id"] < 90_000_000}
    assert {k: (r["n_findings"], r["n_warnings"]) for k, r in got.items()} == {1: (1, 0), 2: (5, 0)}
    starts = [0, 5800, 11600, 17400, 23200]
    assert got[2]["fragments"].split("|") == [texts[1][1][s : s + 20].strip() for s in starts] and got[2]["ai_summary"] == "kort"


def test_query_has_all_chunks(spark, tmp_path):
    """45 chunks of 6000 characters, each 5800 after the one before."""
    spark.createDataFrame([(1, "a" * (44 * 5800 + 6000))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(catalog.text_chunks(spark, str(tmp_path)).collect())
    assert [(r["chunk_no"], r["n_chunks"], r["start"], r["length"]) for r in got] == [(k + 1, 45, 5800 * k, 6000) for k in range(45)]


def test_probe(spark):
    video = '{"format":{"tags":{"AILABEL_id":"x","Comment":"f"},"duration":"8.0"},"streams":[{"index":0,"codec_type":"video","width":64,"height":64,"disposition":{"attached_pic":1}},{"index":1,"codec_type":"video","width":1920,"height":1080,"side_data_list":[{"rotation":-90}],"tags":{"comment":"s"}},{"codec_type":"audio","codec_name":"aac"}]}'
    r = spark.createDataFrame([(video,), ("no json",)], "p string").select(pv.probe_tags(F.col("p")).alias("t"), pv.probe_video(F.col("p")).alias("v")).collect()
    assert (r[0]["t"]["id"], r[0]["t"]["comment"], r[0]["t"]["verify"]) == ("x", "f", None)
    assert (r[0]["v"]["width"], r[0]["v"]["height"], r[0]["v"]["index"], r[0]["v"]["audio_codecs"], r[0]["v"]["duration"]) == (1080, 1920, 1, ["aac"], 8.0)
    assert r[1]["v"] is None and r[1]["t"]["id"] is None


def test_names_beside_a_file(spark):
    paths = [("a/film.MOV", False, "a/film.ailabel.MOV"), ("a/film.MOV", True, "a/film.ailabel.MOV"), ("a.b/film.avi", True, "a.b/film.ailabel.mp4"), ("a.b/film.avi", False, "a.b/film.ailabel.avi"), ("a.b/film", True, "a.b/film.mp4"), ("a.b/film", False, "a.b/film.ailabel"), ("a/.film", False, "a/.film.ailabel")]
    rows = spark.createDataFrame(paths, "p string, b boolean, want string").withColumn("got", pv.output_path(F.col("p"), F.col("b"))).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    labels = spark.createDataFrame([(False, False, None), (True, False, "en"), (True, True, "nl"), (False, True, "en")], "m boolean, d boolean, l string").select(pv.short_label(F.col("m"), F.col("d"), F.col("l")).alias("s")).collect()
    assert [r["s"] for r in labels] == ["AI-gegenereerd", "AI-manipulated", "Deep fake · AI-bewerkt", "Deep fake · AI-generated"]
    side = spark.range(1).select(pv.sidecar(F.lit("a/film.mp4"), F.struct(F.lit("x").alias("id"))).alias("s")).first()["s"]
    assert side["path"] == "a/film.mp4.manifest.json" and json.loads(side["content"]) == {"id": "x"}
    listing = spark.createDataFrame([('{"data":[{"id":"a"},{"name":"b"},{"id":""}]}',), ('{"models":[{"name":"c"}]}',), ("geen json",)], "l string").select(ai.model_names(F.col("l")).alias("n")).collect()
    assert [r["n"] for r in listing] == [["a", "b"], ["c"], []]


def test_badge_sizes(spark):
    rows = spark.createDataFrame([(1920, 1080, 68), (1280, 720, 45), (3840, 2160, 135)], "w int, h int, want int")
    b = pv.badge(F.col("w"), F.col("h"), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("rechtsboven"))
    assert all(r["b"]["height"] == r["want"] for r in rows.withColumn("b", b).collect())
    names = [("LB", "linksboven"), ("rechts boven", "rechtsboven"), ("bottom-left", "linksonder"), ("midden", None)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(names, "n string, want string").withColumn("got", pv.position(F.col("n"))).collect())


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "BSN 206451374"), (2, "niets")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = scan_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = running_counts(stream).writeStream.format("memory").queryName("verdicts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["verdict"]: r["files"] for r in spark.sql("select * from verdicts").collect()} == {"hoog": 1, "geen": 1}
    seen = []
    each_batch(stream, lambda rows, n: seen.append((n, rows.count())), str(tmp_path / "cp2")).awaitTermination(120)
    assert seen == [(0, 2)]


def test_counts_of_documents_in_a_stream(spark, tmp_path):
    """A document that comes again counts once, one that changes moves, old versions and tried batches change nothing."""
    schema = "doc_id long, verdict string, version long"
    arrivals = [[(1, "hoog", 1), (2, "geen", 1), (3, "laag", 1), (3, "geen", 2)], [(1, "hoog", 2), (2, "hoog", 2)], [(2, "geen", 1), (1, "geen", 3), (4, "laag", 1), (4, "laag", 1)]]
    wanted = [{"hoog": 1, "geen": 2}, {"hoog": 2, "geen": 1}, {"hoog": 1, "geen": 2, "laag": 1}]
    counts = str(tmp_path / "counts")
    for rows, want in zip(arrivals, wanted, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep_counts(stream, counts, str(tmp_path / "cp"), version_col="version").awaitTermination(180)
        assert {r["verdict"]: r["files"] for r in document_counts(spark, counts).collect()} == want
    again = spark.createDataFrame([("hoog", 1), ("hoog", 1), ("geen", 1), ("geen", 1), ("laag", 1), ("laag", -1)], "verdict string, change long")
    first = {r["verdict"]: r["files"] for r in document_counts(spark, str(tmp_path / "log")).collect()} if (tmp_path / "log").exists() else {}
    for _ in range(2):
        write_changes(again, str(tmp_path / "log"), 0)
        assert not first and {r["verdict"]: r["files"] for r in document_counts(spark, str(tmp_path / "log")).collect()} == {"hoog": 2, "geen": 2}


def test_registry_grows(spark, tmp_path):
    """Batches that are tried again, facts that come again, streams; what lacks a label or a fingerprint is no fact."""
    schema = "label_id string, sha256 string, marked_sha256 string"
    spark.createDataFrame([("a", "1", "1m"), ("a", "1", None), ("b", "2", None), (None, "3", None), ("c", None, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    registry = Registry(spark, str(tmp_path / "registry"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    registry.follow(stream, str(tmp_path / "cp")).awaitTermination(120)
    facts = {("a", "1", "original", None, 0), ("a", "1m", "marked", None, 0), ("b", "2", "original", None, 0)}
    assert {tuple(r) for r in registry.table().collect()} == facts
    more = spark.createDataFrame([("b", "2", "original", True), ("d", "1", "original", False)], "label_id string, sha256 string, kind string, signature_valid boolean")
    for _ in range(2):
        registry.add(more, 1)
    assert {tuple(r) for r in registry.table().collect()} == facts | {("d", "1", "original", False, 1)} and registry.table().count() == 4
    assert {tuple(r)[:4] for r in registry.compact(str(tmp_path / "compact")).table().collect()} == {f[:4] for f in facts} | {("d", "1", "original", False)}
    got = pv.check_registry(spark.createDataFrame([("1", None), ("2", "t"), ("9", "t"), ("8", None)], "sha256 string, tag_id string"), registry.table()).collect()
    assert {r["sha256"]: (r["state"], r["label_id"]) for r in got} == {"1": ("labelled, signature unknown", "a"), "2": ("labelled, signature unknown", "b"), "9": ("possibly edited", "t"), "8": ("not labelled", None)}


def test_pdf_strings():
    """Parentheses nest, odd hexadecimal digits get a 0, an escaped line end is none; what is not shown is left out."""
    assert shown_strings(b"BT (a(b)c\\\n d\\101) Tj (weg) Tw [(x) -20 <414> (y)] TJ (z) ' ET") == ["a(b)c dA", "xA@y", "z"]
    assert shown_strings(b"(open \\") == [] and shown_strings(b"<41 Tj") == []


def test_pdf_fonts():
    """A subset font's codes are read by its map: of one byte and two, in ranges and lists, inherited, in object streams."""
    stream = lambda n, head, body: b"%d 0 obj <<%s /Length %d>> stream\n%s\nendstream endobj\n" % (n, head, len(body), zlib.compress(body))
    one = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0042> <02> <00530020> endbfchar 1 beginbfrange <03> <05> <0061> endbfrange"
    two = b"1 beginbfrange <0010> <0012> [<20AC> <D83DDE00> <00E9>] endbfrange"
    inner = [(10, b"<</Type /Font /ToUnicode 21 0 R>>"), (11, b"<</F1 10 0 R /F2 12 0 R>>"), (12, b"<</Type /Font /ToUnicode 22 0 R>>")]
    places, body = [], b""
    for n, x in inner:
        places.append(b"%d %d" % (n, len(body)))
        body += x + b" "
    head = b" ".join(places) + b" "
    pdf = b"%PDF-1.5\n1 0 obj <</Type /Pages /Kids [2 0 R] /Resources <</Font 11 0 R>>>> endobj\n2 0 obj <</Type /Page /Parent 1 0 R /Contents [3 0 R]>> endobj\n"
    pdf += stream(3, b"", b"BT /F1 9 Tf (\\001\\002) Tj <030405> Tj /F2 9 Tf <001000110012> Tj /F9 9 Tf (gewoon) Tj ET")
    pdf += stream(21, b"", one) + stream(22, b"", two) + stream(30, b"/Type /ObjStm /N 3 /First %d" % len(head), head + body)
    assert pdf_text(pdf) == "BS abc €😀é gewoon"
    assert code_map(one).text == {1: "B", 2: "S ", 3: "a", 4: "b", 5: "c"} and code_map(two).size == 2 and code_map(b"").text == {}
    assert CodeMap(2, {1: "x"}).shown("\0\1\0") == "x" and shown_strings(b"/F 1 Tf <0041> Tj") == ["A"]
    assert pdf_text(b"no pdf") == pdf_text(b"") == ""


def test_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_klas.csv").write_text("naam;bsn\nLeerling Piet Bakker;206451374\n")
    (tmp_path / "in" / "leeg.txt").write_text("")
    asked = lambda texts: ['{"bevindingen":[{"type":"adres","fragment":"Piet Bakker","ernst":"laag"}],"samenvatting":"klas"}' for _ in texts]
    results, summary = run(spark, str(tmp_path / "in"), Options(threshold="hoog"), asked)
    rows = {r["name"]: r for r in results.collect()}
    assert rows["_klas.csv"]["verdict"] == "hoog" and rows["_klas.csv"]["ai_summary"] == "klas" and rows["leeg.txt"]["verdict"] == "geen"
    assert write_run(results, summary, str(tmp_path / "out"), Options(threshold="hoog"), redact=True) == 2
    (copy,) = (tmp_path / "out" / "redacted").rglob("*.csv")
    assert copy.name == "_klas.geschoond.csv" and "206451374" not in copy.read_text() and "[GEREDIGEERD:bsn]" in copy.read_text()
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert [f["naam"] for f in report["bestanden"]] == ["_klas.csv", "leeg.txt"] and report["disclaimer"]["en"].startswith("This tool") and report["samenvatting"]["telling"]["hoog"] == 1
    assert {f["type"] for f in report["bestanden"][0]["bevindingen"]} >= {"bsn", "adres"} and "206451374" not in json.dumps(report)
    page = (tmp_path / "out" / "report.html").read_text()
    assert page.startswith("<!doctype html>") and page.endswith("</html>") and page.count("<section>") == 2 and "206451374" not in page and "This tool" in page
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["redacted", "report.html", "report.json"]
    envelope = json.loads(report_envelope(results, "hoog").first()["report"])
    assert envelope["samenvatting"]["telling"]["hoog"] == 1 and envelope["samenvatting"]["bestanden"] == 2
    with pytest.raises(ValueError):
        Options(threshold="veel")


def test_joined_documents(spark, tmp_path):
    """Rows of many partitions in order, none at all, a task that fails: the file is whole or as it was."""
    rows = spark.range(0, 1000, 1, 7).select(F.to_json(F.struct("id", F.lit("é")).alias("x")).alias("value"))
    path = str(tmp_path / "sub" / "all.json")
    write_joined(rows, path, '{"rows":[', ",", "]}")
    with open(path) as f:
        assert [r["id"] for r in json.load(f)["rows"]] == list(range(1000))
    broken = rows.select(F.when(F.col("value").contains('"id":900,'), F.raise_error(F.lit("weg"))).otherwise(F.col("value")).cast("string").alias("value"))
    with pytest.raises(Exception, match="weg"):
        write_joined(broken, path, "[", ",", "]")
    with open(path) as f:
        assert len(json.load(f)["rows"]) == 1000
    write_joined(rows.limit(0), path, "[", ",", "]")
    with open(path) as f:
        assert f.read() == "[]"
    assert [p.name for p in (tmp_path / "sub").iterdir()] == ["all.json"]


def test_badge_places(spark):
    """Worked by hand from the rules: height 68, rim 2 and pad 3, margin 34; stored pixels twice as wide as shown."""
    rows = spark.createDataFrame([(1920, 1080, 1.0, "rechtsonder"), (960, 1080, 2.0, "linksboven")], "w int, h int, sar double, p string")
    b = pv.badge(F.col("w"), F.col("h"), F.col("sar"), F.lit(1.0), F.lit(1.0), F.col("p"))
    got = [r["b"].asDict() for r in rows.select(b.alias("b")).collect()]
    assert got[0] == {"height": 68, "margin": 34, "width": 68, "x": 1815, "y": 975, "image_width": 74, "image_height": 74, "scaled_width": 74}
    assert (got[1]["x"], got[1]["y"], got[1]["scaled_width"]) == (16, 31, 37)
    text = spark.range(1).select(pv.overlay_filter(F.lit(0), F.struct(F.lit(37).alias("scaled_width"), F.lit(74).alias("image_height"), F.lit(16).alias("x"), F.lit(31).alias("y")), F.lit("bt709"), F.lit("pc"), F.lit(5)).alias("f"),
                                 pv.text_width(F.array(F.lit(False), F.lit(True)), F.array(F.lit(5.0), F.lit(20.0))).alias("w"), pv.bit_rate(F.lit(None).cast("double")).alias("r")).first()
    assert text["f"] == "[1:v]scale=w=37:h=74:out_color_matrix=bt709:out_range=pc,format=yuva420p[lg];[0:0][lg]overlay=x=16:y=31:enable='lte(t,5)'[v]" and abs(text["w"] - (1.28 + 4.2 + 0.4)) < 1e-9 and text["r"] == 4_000_000
