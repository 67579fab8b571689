"""Vectors, URLs, components and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graysift.llm.common import likely_rows
from graysift.llm.components import connected_components
from graysift.llm import embedding_dedup as vectors
from graysift.llm.embedding_dedup import cuts_of, embedding_dedup
from graysift.llm.ngram_join import PartEnum, folded, maybe_similar, sketch
from graysift.llm import url_filter
from graysift.llm.url_filter import url_verdicts
from tests.llm import brute


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.normal(size=(120, 5)))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 5), (1003, [float("nan")] * 5), (1004, [None] * 5), (None, rows[0][1]), (1005, [1e30, 1e30, 0.0, 0.0, 0.0]), (1006, [1.0, 1.0, 0.0, 0.0, 0.0]),
             (1006, [1.0, 1.0, 0.0, 0.0, 0.0]), (1007, [1.0, 2.0]), (1008, [2.0, 4.0]), (5, rows[5][1]), (1009, [float("inf")] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding_dedup(df.withColumn("kept", F.lit(1))).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute.vectors(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    got = embedding_dedup(df, few=1).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute.vectors(rows)
    assert embedding_dedup(df.filter("vec_id < 0")).collect() == [] and len(embedding_dedup(df.filter("vec_id = 3")).collect()) == 1


def test_vectors_in_clusters(spark):
    """Links at just the threshold count; cells that lie apart are not brought together; a third of the rows is one vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 6))
    rows = [(i, [float(x) for x in np.float32(centres[i % 30] + 0.15 * rng.normal(size=6))]) for i in range(600)]
    rows += [(700 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300)] + [(1100, [3.0, 4.0, 0.0, 0.0, 0.0, 0.0]), (1101, [4.0, 3.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for threshold in (0.9, 0.6):
        got = embedding_dedup(df, threshold=threshold).collect()
        assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute.vectors(rows, threshold)
    assert {r[0]: r[1] for r in embedding_dedup(spark.createDataFrame(rows[-2:], df.schema), threshold=0.96).collect()} == {1100: 1, 1101: 1}
    got = embedding_dedup(df, block=6, deep=4).collect()  # both rounds of cuts, two steps down the tree
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute.vectors(rows)
    axis, value = cuts_of(rng.normal(size=(64, 3)) * [1, 5, 1], 3)
    assert axis[0] == 1 and len(value) == 7 and np.isfinite(value).all()


def test_vectors_go_to_blocks_in_reach_only(spark):
    """Twice the clusters make twice the blocks, and not more copies of a vector."""
    rng, copies = np.random.default_rng(8), []
    for n in (30, 120):
        centres = rng.normal(size=(n, 8))
        unit = np.repeat(centres, 50, axis=0) + rng.normal(size=(n * 50, 8)) * 0.02
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        nodes = spark.createDataFrame([(i, 1, u, u) for i, u in enumerate(unit.tolist())], "node long, copies long, vector array<double>, unit array<double>")
        copies.append(vectors._blocks(nodes, len(unit), np.eye(8), 0.2, 50, 4).count() / len(unit))
    assert 1 <= copies[1] < 2 * copies[0]



def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 200]} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_likely_rows_loses_none(spark):
    needed = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    got = likely_rows(spark.range(5000).withColumnRenamed("id", "k"), "k", needed)
    assert got.join(needed, "k").count() == needed.count() and got.count() < 2500
    assert likely_rows(spark.range(50).withColumnRenamed("id", "k"), "k", needed, most_bits=64).join(needed, "k").count() == 8


def test_urls(spark):
    urls = [
        ("https://sub.Example.ORG/es/x", "sub.example.org", "/es/x", "example.org/es/", "block"), ("http://a.org", "a.org", "", None, None), ("http://a.org/x", "a.org", "/x", "org/", "allow"),
        ("http://example.org/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"), ("ftp://x.com/de/#a", "x.com", "/de/", "com/de/", "block"), ("https://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ]
    df = spark.createDataFrame([(k, u[0], "clash") for k, u in enumerate(urls * 3)], "page_id long, url string, verdict string")
    got = url_verdicts(df).collect()
    assert len(got) == len(df.collect())
    for r in got:
        _, host, path, rule, verdict = urls[r["page_id"] % len(urls)]
        assert (r["host"], r["path"]) == (host, path) and r["verdict"] in ("allow", "block")
        if rule:
            assert (r["rule"], r["verdict"]) == (rule, verdict)
    assert url_verdicts(df.filter("page_id < 0")).collect() == []


def test_a_hot_url_does_not_fill_the_sample(spark):
    urls = [f"http://h{k}.{end}" for k in range(8) for end in ("org/x", "com/de/x")]
    order = [r["u"] for r in spark.createDataFrame([(u,) for u in urls], "u string").orderBy(F.xxhash64("u"), "u").collect()]
    rows = [*enumerate([*[order[0]] * 40, *urls, "http://h1.net/de/x"])]
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), max_labelled=16).collect()
    assert len(got) == len(rows) and len({r["block_score"] for r in got}) > 1


def test_trees_are_trusted_only_where_they_hold(spark):
    """Verdicts that follow the form of urls carry over to suffixes that were held out, verdicts that follow the domain do not."""
    scored = spark.createDataFrame([(1.0, 0.9), (1.0, 0.4), (0.0, 0.4), (0.0, 0.1)], "label double, block_score double")
    assert url_filter.auc(scored) == pytest.approx(0.875) and url_filter.auc(scored.filter("label = 1")) is None
    rng = np.random.default_rng(8)
    form, domain = [], []
    for k in range(400):
        bad, host = k % 2, f"h{k % 40}.{['com', 'org'][k // 2 % 2]}"
        form.append(f"http://{host}/{'de' if bad else 'fr'}/" + ("9" * int(rng.integers(5, 20)) if bad else "wort"))
        domain.append(f"http://{host}/x{rng.integers(0, 9)}")
    rules = (("block", "com/de/"), ("allow", "com/fr/"), ("block", "org/de/"), ("allow", "org/fr/"))
    extra = [f"http://h{k}.net/{'9' * 15 if k % 2 else 'wort'}" for k in range(20)]
    df = spark.createDataFrame([*enumerate(form + extra)], "page_id long, url string")
    got = {r["url"]: r for r in url_verdicts(df, rules).collect()}
    assert {got[u]["verdict_by"] for u in extra} == {"model"} and {got[u]["verdict"] for u in extra} == {"allow", "block"}
    rules = (("block", "com/"), ("allow", "org/"))
    df = spark.createDataFrame([*enumerate(domain + extra)], "page_id long, url string")
    got = {r["url"]: r for r in url_verdicts(df, rules).collect()}
    assert {got[u]["verdict"] for u in extra} == {"allow"} and {got[u]["verdict_by"] for u in extra} == {"default"}


def test_url_features_and_scores(spark):
    """Features against a plain loop; scores against a walk down each tree; suffixes that were held out still part."""
    rng = np.random.default_rng(4)
    words = ["shop", "news", "a-b", "x1", "9", "index.html", "de", "fr", "es"]
    urls = [f"http{'s' * int(rng.integers(2))}://{w}{k % 7}.{d}/{p}/{rng.choice(words)}{'?a=1&b=' + str(k) if k % 3 else ''}{'#f' * (k % 5 == 0)}"
            for k in range(300) for w, d, p in [(rng.choice(words), rng.choice(["com", "org", "net"]), rng.choice(["de", "fr", "en"]))]]
    urls += ["", "x" * 20_000, "http://A.com/de/" + "9" * 500]
    rows = url_filter.featured(spark.createDataFrame([*enumerate([*urls, None])], "page_id long, url string"))
    got = {r["page_id"]: r for r in rows.collect()}
    suffix = {}
    for k, r in got.items():
        suffix.setdefault(r["host_suffix"], []).append(r)
    for k, r in got.items():
        url = [*urls, None][k] or ""
        share = [url.count(c) / len(url) for c in set(url)]
        rest = url.partition("://")[2] if "://" in url else ""
        host = rest.replace("?", "/").replace("#", "/").partition("/")[0].lower()
        path = rest[len(host) :].partition("?")[0].partition("#")[0]
        same = suffix[r["host_suffix"]]
        query = url.partition("?")[2].partition("#")[0] if "?" in url.partition("#")[0] else ""
        want = {"url_length": len(url), "host_length": len(host), "path_length": len(path), "host_labels": len(host.split(".")), "depth": len([p for p in path.split("/")[1:] if p]), "digits": sum(c.isdigit() for c in url) / max(1, len(url)),
                "entropy": -sum(p * np.log2(p) for p in share), "parameters": len([q for q in query.split("&") if q]), "hyphens": url.count("-"), "fragment": float("#" in url), "secure": float(url.startswith("https://")),
                "longest_part": max(map(len, host.split("."))), "suffix_pages": np.log1p(len(same)), **{f"suffix_{c}": np.mean([x[c] for x in same]) for c in ("depth", "digits", "parameters")}}
        assert {f: r[f] for f in want} == {f: pytest.approx(x, abs=1e-9) for f, x in want.items()} and list(want) == list(url_filter.FEATURES)
        assert list(r["features"]) == [r[f] for f in want]
    model = url_filter.train(rows)
    for r in model.transform(rows).limit(40).collect():
        raw = sum(w * t.predict(r["features"]) for w, t in zip(model.treeWeights, model.trees))
        assert r["probability"][1] == pytest.approx(1 / (1 + np.exp(-2 * raw)))
    scored = url_filter.held_out(rows, folds=3).collect()
    assert len(scored) == sum(r["rule_verdict"] is not None for r in got.values())
    blocked, allowed = ([r["block_score"] for r in scored if r["label"] == x] for x in (1.0, 0.0))
    assert np.mean([b > a for b in blocked for a in allowed]) > 0.5
    same = url_verdicts(spark.createDataFrame([(1, "http://a.com/de/", 3.0, "f", "s")], "page_id long, url string, depth double, features string, host_suffix string")).first()
    assert (same["depth"], same["features"], same["host_suffix"], same["verdict"]) == (3.0, "f", "s", "block")


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps what its brute-force version keeps."""
    words = [f"w{k}" for k in range(60)]
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(good + good[:5])]
    rows += [(100 + i, good[10 + i] + " extra", "en", "s1") for i in range(5)] + [(200 + i, "BUY!! NOW!! ### $$$ " * 12 + str(i), "en", "s2") for i in range(20)]
    rows += [(300, None, "en", None), (301, "", None, "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(30), *range(200, 220)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    quality, exact, near, mixing, _ = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, held, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(range(200, 220)) and set(range(35)) | set(range(100, 105)) <= ids
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    after = exact(spark, kept, str(tmp_path))
    left = sorted(r[0] for r in brute.exact(texts) if r[3])
    assert sorted(r["doc_id"] for r in after.collect()) == left
    texts = [x for x in texts if x[0] in left]
    near_kept = near(spark, after, str(tmp_path))
    left = sorted(r[0] for r in brute.jaccard(texts, 5, 80, 100) if r[0] == r[2])
    assert sorted(r["doc_id"] for r in near_kept.collect()) == left
    mixed = mixing(spark, near_kept, str(tmp_path))
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= set(left) and max(times.values()) <= 3 and mixed.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(times) and len(packed) == sum(times.values())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, clashing names, very long texts and empty tables, stage by stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, selected string, group_size int, keep_id string"
    words = [f"w{k}" for k in range(50)]
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(words, n))
    a, b, c = text(40), text(50), text(60_000)
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, c), (4, text(30)), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, 0, "k", "s", 7, "q") for i, t in rows], schema)
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, none, str(tmp_path)).collect() == []
    assert corpus_pipeline.packing_stage(spark, none, str(tmp_path)).collect() == []
    exact = corpus_pipeline.exact_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in exact), key=repr) == sorted([(2, a), (None, b), (3, c), (3, c), (4, rows[7][1]), (6, "")], key=repr)
    assert {(r["kept"], r["selected"], r["group_size"], r["keep_id"]) for r in exact} == {("k", "s", 7, "q")}
    near = corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in near), key=repr) == sorted([1, None, None, None, 3, 3, 4, 5, 6], key=repr)
    mixed = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()
    assert all(r["text"] for r in mixed) and {r["doc_id"] for r in mixed} <= {1, 2, 3, 4, None}


def test_near_stage_links_at_four_fifths(spark):
    """Pairs with a similarity of 0.80 to 0.85, one of just 0.8, are linked; one below is not."""
    words = lambda k, n: [f"{k}x{i}" for i in range(n)]
    changed = lambda w, at: [f"new{i}" if i in at else x for i, x in enumerate(w)]
    a, b, c = words("a", 204), words("b", 94), words("c", 204)
    rows = [(1, a), (2, changed(a, {20, 60, 100, 140})), (3, b), (4, changed(b, {20, 60})), (5, c), (6, changed(c, {20, 60, 100, 140, 180})), (7, words("d", 94)), (8, words("d", 94)[:-10] + words("e", 10))]
    texts = [(i, " ".join(w)) for i, w in rows]
    want = brute.jaccard(texts, 5, 80, 100)
    assert [r[2] for r in want] != [r[2] for r in brute.jaccard(texts, 5, 85, 100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in want if r[0] == r[2])


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    sets, num, den = [], 80, 100
    for n in (3, 9, 40, 250, 3000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0, 0.03, 0.1, 0.11, 0.12, 0.2, 0.5):
            cut = int(n * share)
            sets += [np.unique(np.concatenate([base[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)])), np.unique(base[cut:])]
    sets = [s for s in sets if len(s)]
    bits = np.frombuffer(b"".join(sketch(s, 1024) for s in sets), np.uint64).reshape(len(sets), -1)
    assert all(folded(sketch(s, 1024), n) == sketch(s, n) for s in sets for n in (64, 512, 1024))
    every = slice(0, len(sets))
    got = set(zip(*(x.tolist() for x in maybe_similar(bits, np.array([len(s) for s in sets]), every, every, num, den)), strict=True))
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    similar = {(i, j) for (i, j), n in both.items() if n * den >= (len(sets[i]) + len(sets[j]) - n) * num}
    assert similar <= got and len(got) < len(both) / 2


def test_similar_sets_share_a_signature():
    """Pairs that are just similar enough, the difference on either side or on both, of all sizes."""
    rng = np.random.default_rng(6)
    for num in (80, 90):
        enum = PartEnum(num, 100)
        for size in [*range(2, 60), 97, 250, 777, 3000]:
            a = rng.integers(0, 2**64 - 1, size, dtype=np.uint64)
            less, both = size * (100 - num) // 100, size * (100 - num) // (100 + num)
            new = rng.integers(0, 2**64 - 1, max(both, 1), dtype=np.uint64)
            for b in (a[less:], np.concatenate([a[both:], new[:both]])):
                x, y = (enum.signatures(np.unique(e)) for e in (a, b))
                one, other = set(x[0].tolist()) & set(y[0].tolist()), set(x[1].tolist()) & set(y[1].tolist())
                assert one or other or len(np.setxor1d(a, b)) == 0, (num, size)


def test_signatures_of_unlike_sets_differ():
    """All bits of a signature are kept: among unlike sets none agree, and of 2^64 values 10^7 sets of 1000 shingles would
    have under a thousandth false edge each."""
    rng, enum = np.random.default_rng(9), PartEnum(80, 100)
    found = np.concatenate([enum.signatures(np.unique(rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64)))[0] for _ in range(300)])
    assert len(np.unique(found)) == len(found) and np.unique(found >> np.uint64(63)).tolist() == [0, 1]
    each = len(found) / 300
    assert 10_000_000 * each * each / 2.0**64 < 1e-3
