"""The scan on short texts: what is found, how it is shown, merged, weighed, redacted and reported."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from graysift.functions import checks, text as tx
from graysift.functions.rules import RULES, SPECIAL
from graysift.operators.detect import FINDINGS, matches, rule_hits, special_hits, spellings, with_findings
from graysift.operators.redact import redact, redacted_texts, swept
from graysift.operators.score import exit_code, merge_findings, summarise
from graysift.plans.report import report_json
from graysift.plans.samples import DRAWN, citizen_number
from graysift.plans.scan import scan

OWN = citizen_number(random.Random(77))
CASES = {
    "topics": "In de klas: vingerafdruk nemen, later een irisscan. Ook ramadan en moskee kwamen ter sprake, en weer RAMADAN.",
    "topics and person": f"In de klas: vingerafdruk nemen. Het loket schreef {OWN} op.",
    "accents": "Zeg 😀 eens\nzij is BOEDDHISTISCH of atheïst\npost: a.b@vijver.eu",
    "crowd": "\n".join(f"gast{k}@vijver{k % 7}.eu" for k in range(61)),
    "secret in capitals": "API-KEY = Zomerhoed/8 en daarna ghp_" + "q" * 24,
    "number with a word for another": f"medewerkernummer en burgernummer {OWN}",
    "empty": "",
    "null": None,
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(k, "plan.txt", t) for k, t in CASES.items()] + [(f"drawn {k}", "plan.txt", x.text) for k, x in enumerate(DRAWN)] + [("named", f"brief_{OWN}_jan.txt", "niets")]
    rows += [(f"border {k}", "plan.txt", t.replace("#", OWN)) for k, (t, _) in enumerate(BORDERS)]
    df = scan(spark.createDataFrame(rows, "doc_id string, name string, text string"))
    df = df.withColumn("r", redact(F.col("text"), F.col("findings"))).withColumn("report", report_json(df))
    return {r["doc_id"]: r for r in df.collect()}


#: Where a number may and may not stand to be one.
BORDERS = [
    ("#", True), ("ja #!", True), ("<#>", True), ("a:#;b", True), ("#\n#", True), ("x #\ty", True), ("é#é", True), ("1#", False), ("#0", False), ("8.#", False), ("8-# jaar", False), ("#.5", False), ("# 4", False), ("#-7", False),
]


def types(row):
    return {f["type"] for f in row["findings"]}


def test_drawn_texts(results):
    """What the generator put into a text is found with its value and line, what only looks like it is not."""
    for k, sample in enumerate(DRAWN):
        found = {(f["type"], f["value"]): f for f in results[f"drawn {k}"]["findings"]}
        assert set(sample.wanted) <= set(found), sample
        assert not {v for _, v in found} & set(sample.unwanted), sample
        for kind, value in sample.wanted:
            assert sample.text.split("\n")[found[kind, value]["line"] - 1].count(value), sample
    assert len({kind for s in DRAWN for kind, _ in s.wanted}) >= 13 and sum(bool(s.unwanted) for s in DRAWN) > 8


def test_borders(results):
    assert [(t, "bsn" in types(results[f"border {k}"])) for k, (t, _) in enumerate(BORDERS)] == BORDERS


def test_names_of_files_count(results):
    (f,) = results["named"]["findings"]
    assert (f["type"], f["value"], f["in_filename"], f["line"]) == ("bsn", OWN, True, 0)


def test_plain_numbers_give_way(results):
    assert types(results["number with a word for another"]) == {"bsn"}


def test_topics(results):
    found = {f["type"]: f for f in results["topics"]["findings"]}
    assert found["biometrie"]["terms"] == ["vingerafdruk", "irisscan"] and found["religie"]["terms"] == ["ramadan", "moskee"]
    assert results["topics"]["verdict"] == "laag" and all(f["label"].endswith("(onderwerp)") and f["masked"] == f["value"] for f in found.values())
    assert results["topics and person"]["verdict"] == "hoog" and types(results["topics and person"]) == {"biometrie", "bsn"}
    found = {f["type"]: f for f in results["accents"]["findings"]}
    assert found["religie"]["terms"] == ["boeddhistisch", "atheïst"] and found["email"]["line"] == 3


def test_secrets_and_caps(results):
    secrets = [f for f in results["secret in capitals"]["findings"] if f["type"] == "geheim"]
    assert len(secrets) == 2 and all(f["severity"] == "hoog" and "•" in f["masked"] for f in secrets)
    assert len(results["crowd"]["findings"]) == 25 and "nog 36 andere" in results["crowd"]["warnings"][0]


def test_empty(results):
    for k in ("empty", "null"):
        assert results[k]["verdict"] == "geen" and results[k]["findings"] == [] and results[k]["warnings"] == [] and results[k]["r"]["text"] == ""


def test_redaction(results):
    """Of every drawn text the listed values go, labels stand in their places, words of topics stay."""
    for k in range(len(DRAWN)):
        row = results[f"drawn {k}"]
        values = [f["value"] for f in row["findings"] if f["category"] != "bijzonder"]
        assert not any(v in row["r"]["text"] for v in values) and (row["r"]["n"] > 0) == bool(values)
        assert row["r"]["text"].count("[GEREDIGEERD:") == row["r"]["n"]
    assert "vingerafdruk" in results["topics and person"]["r"]["text"] and OWN not in results["topics and person"]["r"]["text"]


def test_sweep_is_one_value_after_another():
    """The sweep gives what replacing one value after another gives: values within values, overlaps, values like labels."""
    rnd = random.Random(9)
    for _ in range(400):
        letters = rnd.choice(("ab", "abc", "nam[e]"))
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 120)))
        pairs = sorted({("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 7))), rnd.choice(("naam", "bsn"))) for _ in range(rnd.randrange(1, 7))}, key=lambda p: (-len(p[0]), p))
        want, n = text, 0
        for value, kind in pairs:
            n += want.count(value)
            want = want.replace(value, f"[GEREDIGEERD:{kind}]")
        assert swept(text, pairs) == (want, n)


def test_sweep_of_results(spark, results):
    rows = [(k, x.text) for k, x in enumerate(DRAWN)] + [(900, None), (901, "")]
    docs = scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("replaced", F.lit("clash")), every=True)
    want = {r["doc_id"]: (r["r"]["text"], r["r"]["n"]) for r in docs.select("doc_id", redact(F.col("text"), F.col("findings")).alias("r")).collect()}
    assert {r["doc_id"]: (r["text"], r["replaced"]) for r in redacted_texts(docs).collect()} == want


def test_report_hides_values(results):
    for k, sample in enumerate(DRAWN):
        shown = json.dumps(json.loads(results[f"drawn {k}"]["report"])["bevindingen"])
        assert not any(f'"{value}"' in shown for _, value in sample.wanted)


def test_summary(spark):
    rows = spark.createDataFrame([("a.txt", "geen"), ("b.txt", "hoog"), ("scan.pdf", "onbekend")], "name string, verdict string")
    s = summarise(rows, names=True).first()
    assert (s["highest"], s["blocked"], s["unreadable"], s["files"]) == ("hoog", ["b.txt"], ["scan.pdf"], 3) and "niet lezen" in s["advice"]
    assert summarise(rows.filter("name = 'x'")).first()["highest"] == "geen"
    assert exit_code("hoog") == 2 and exit_code("laag") == 0


def test_checksums(spark):
    cases = [("bsn", "206451374", True), ("bsn", "206451386", True), ("bsn", "206451399", False), ("bsn", "000000000", False), ("bsn", "11122233", False), ("iban", "NL20INGB0001234567", True),
             ("iban", "NL20 INGB 0001 2345 67", True), ("iban", "GB82WEST12345698765432", True), ("iban", "NL20INGB0001234568", False), ("luhn", "5500005555555559", True), ("luhn", "5500005555555558", False), ("luhn", "1" * 16, False)]
    rnd = random.Random(5)
    for _ in range(50):  # a valid number stays valid, and no longer once a digit changes
        d = [rnd.randint(0, 9) for _ in range(15)]
        total = sum(2 * x - 9 * (x > 4) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
        number = "".join(map(str, d)) + str(-total % 10)
        at = rnd.randrange(16)
        cases += [("luhn", number, True), ("luhn", number[:at] + str((int(number[at]) + 1) % 10) + number[at + 1 :], False)]
    df = spark.createDataFrame(cases, "rule string, value string, valid boolean")
    v = F.col("value")
    got = F.when(F.col("rule") == "bsn", checks.valid_bsn(v)).when(F.col("rule") == "iban", checks.valid_iban(v)).otherwise(checks.valid_luhn(v))
    assert [r for r in df.withColumn("got", got).collect() if r["got"] != r["valid"]] == []


def test_checksums_of_large_keys(spark, tmp_path):
    """Keys whose products pass 64 bits; DuckDB takes the same SQL where the keys are 128 bits wide."""
    import duckdb

    from graysift.plans import catalog

    keys = [0, 1, 88_068, 88_069, 149_999, 8_999_999, 10**12 + 7, 2**63 - 1, None, *range(7_000_000, 7_000_600)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT o_orderkey::HUGEINT AS o_orderkey FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(catalog.SQL["checksums"]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in catalog.checksums(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == len(keys) and all(any(r[k] for r in got.values()) for k in range(2))


def test_text_functions(spark):
    masks = [("206451374", "20•••••74"), ("abc", "•••"), ("noor.verh@school.nl", "no•••••••@school.nl"), ("a@b.nl", "a•••@b.nl")]
    assert all(r["m"] == r["want"] for r in spark.createDataFrame(masks, "v string, want string").withColumn("m", tx.mask(F.col("v"))).collect())
    text = "\n".join(f"regel {i}" for i in range(300))
    got = spark.createDataFrame([(text,), ("kort",)], "t string").select(tx.chunks(F.col("t"), 500, 50).alias("c")).collect()
    assert len(got[0]["c"]) > 3 and all(len(c["text"]) <= 500 for c in got[0]["c"]) and len(got[1]["c"]) == 1
    assert got[0]["c"][-1]["end"] == len(text) and all(text[c["start"] : c["end"]] == c["text"] for c in got[0]["c"])
    with pytest.raises(ValueError):
        tx.chunks(F.col("t"), 100, 100)
    urls = [("http://localhost:1234/v1", True), ("http://127.0.0.1:11434/v1", True), ("http://192.168.1.20:1234/v1", True), ("https://api.openai.com/v1", False), ("http://10.evil.example/", False)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(urls, "u string, want boolean").withColumn("got", checks.local_endpoint(F.col("u"))).collect())
    sizes = [(0, "0 B"), (999, "999 B"), (1000, "1.0 kB"), (12_345_678, "12.3 MB"), (123_456_789, "123 MB")]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(sizes, "n long, want string").withColumn("got", tx.human_size(F.col("n"))).collect())


def plain_chunks(text, size, overlap):
    out, at = [], 0
    while True:
        end = min(len(text), at + size)
        newline = text.rfind("\n", at, end)
        if end < len(text) and newline > at + int(size * 0.6):
            end = newline
        out.append((at, end, text[at:end]))
        if end >= len(text):
            return out
        at = end - overlap


def test_chunks_and_lines_of_long_texts(spark):
    """Against a plain loop: blocks, newlines at block borders, characters of four bytes; long texts take little time."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc é😀" + "\n" * k) for _ in range(n)) for n in (1, 500, 1023, 1024, 1025, 5000, 40_000) for k in (0, 1, 3)]
    texts += ["x" * 1023 + "\n" + "y" * 1024 + "\n", "\n" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", tx.chunks(F.col("t"), 500, 50).alias("c"), tx.index(F.col("t")).alias("i"))
    for r in rows.collect():
        assert [tuple(c) for c in r["c"]] == plain_chunks(texts[r["k"]], 500, 50)
        assert r["i"]["newlines"] == [j for j, c in enumerate(texts[r["k"]]) if c == "\n"] and "".join(r["i"]["blocks"]) == texts[r["k"]]
    below = spark.createDataFrame([([], 3), ([1, 4, 4, 9], 4), ([1, 4], 9), ([5], 5), ([5], 6)], "p array<int>, x int").select(tx.count_below(F.col("p"), F.col("x")).alias("n"))
    assert [r["n"] for r in below.collect()] == [0, 1, 2, 0, 1]
    keys = spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "k array<string>").select(tx.first_places(F.col("k")).alias("i")).first()["i"]
    assert keys == [0, 1, 3]
    began = time.time()
    long = spark.range(1).select(F.repeat(F.lit("een regel met wat woorden erin\n"), 1_000_000).alias("t"))
    assert long.select(F.size(tx.chunks(F.col("t"))).alias("n")).first()["n"] > 5000 and time.time() - began < 40


def test_all_of_many_values(spark):
    """Twenty thousand values of one text, all listed with their lines and all redacted, in little time."""
    text = "\n".join(f"gast{k}@vijver{k % 977}.eu" for k in range(20_000))
    began = time.time()
    found = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=True)
    row = redacted_texts(found).join(found.select("doc_id", F.size("findings").alias("n"), F.element_at("findings", -1)["line"].alias("line")), "doc_id").first()
    assert (row["n"], row["line"], row["replaced"]) == (20_000, 20_000, 20_000) and "@" not in row["text"] and time.time() - began < 90


def test_redacts_values_beyond_the_caps(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"mail piet{i}@school.nl" for i in range(40)))], "doc_id long, text string")
    row = scan(docs, every=True).select(redact(F.col("text"), F.col("findings")).alias("r"), "warnings").first()
    assert row["r"]["n"] == 40 and "@" not in row["r"]["text"] and row["warnings"] == []


def test_prefilter_lets_every_match_through(spark):
    """Each spelling of each word list, in odd letter case too, is found as a scan without the prefilter finds it."""
    words = [w for s in SPECIAL for w in spellings(s[2])] + ["K\u0131nker", "KANKER", "\u212aANKER", "ADD\u0130", "ATHE\u00cfST", "kan\u0138er", "d\u0131g\u0131d met wachtwoord", "D\u0130G\u0130D code"]
    words += [f"{w}: abcd" for w in ("API_KEY", "api-key", "pa\u017fsword", "Bearer", "\u212aey")] + ["sk-" + "a" * 16, "A\u212aIA" + "B" * 16, "BSN 111-222-333", "\u0661\u0661\u0661222333 leerlingnummer 1234567"]
    docs = spark.createDataFrame([(k, f"x {w} y") for k, w in enumerate(words)], "doc_id int, text string")
    got = {r["doc_id"]: r["f"] for r in with_findings(docs, F.col("text"), "f", "w").collect()}
    plain = docs.select("doc_id", *[special_hits("text", s[2], k).alias(s[0]) for k, s in enumerate(SPECIAL)], *[rule_hits("text", r, k)["found"].alias(r.type) for k, r in enumerate(RULES)])
    for r in plain.collect():
        want = {t for t, hits in r.asDict().items() if t != "doc_id" and hits}
        assert {f["type"] for f in got[r["doc_id"]]} >= want - {"leerlingnummer", "big", "betaalkaart"} and {f["type"] for f in got[r["doc_id"]]} <= want, words[r["doc_id"]]


def test_many_matches(spark):
    """Places stay right over several chunks of matches, and the work is linear."""
    text = " ".join(f"a{k % 700}@b.nl" for k in range(3000))
    rows = spark.createDataFrame([(text,), ("geen",)], "text string").select(matches("text", r"(?U)\b[a-z0-9]+@b.nl\b").alias("m")).collect()
    assert len(rows[0]["m"]) == 3000 and all(text[m["start"] : m["start"] + len(m["value"])] == m["value"] for m in rows[0]["m"]) and rows[1]["m"] == []
    began = time.time()
    large = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda k: F.concat(k.cast("string"), F.lit("@school.nl"))), " ").alias("text"))
    assert scan(large.withColumn("doc_id", F.lit(1))).select(F.size("findings").alias("n")).first()["n"] == 25 and time.time() - began < 60


def test_merging_duplicates(spark):
    """The same value by name, text and model: counted, the highest severity, the pattern's own row; topics joined."""
    row = lambda type_, value, severity, source, name, terms=None: (type_, f"l-{source}", severity, "c", None, value, f"m-{source}", 1, None, source, len(terms or [1]), name, bool(terms), terms, None, None)
    found = [row("email", "A@b.nl", "laag", "ai", False), row("email", "a@B.nl ", "middel", "patroon", True), row("email", "a@b.nl", "hoog", "ai", False), row("naam", "x", "laag", "ai", False),
             row("religie", "kerk", "hoog", "patroon", True, ["kerk"]), row("religie", "moskee, kerk", "hoog", "patroon", False, ["moskee", "kerk"]), row("email", "\ta@b.nl", "laag", "patroon", False)]
    got = spark.createDataFrame([(found,)], f"f {FINDINGS}").select(merge_findings(F.col("f")).alias("f")).first()["f"]
    shown = [(f["type"], f["value"], f["severity"], f["source"], f["n"], f["in_filename"]) for f in got]
    assert shown == [("email", "a@B.nl ", "hoog", "patroon", 4, True), ("religie", "kerk, moskee", "hoog", "patroon", 2, False), ("naam", "x", "laag", "ai", 1, False)]
