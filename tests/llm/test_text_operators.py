"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graysift.llm import repeats
from graysift.llm.exact_dedup import exact_dedup
from graysift.llm.mixing import mix
from graysift.llm.ngram_join import near_duplicates
from graysift.llm.packing import best_fit, dominance_reduction, pack_documents, plan, sequences, token_pieces, pack
from graysift.llm.quality import features, fit, grade, train
from graysift.llm.token_counts import LONG_CHARS, dealt, frequent_pretokens, row_tokens, token_counts
from graysift.llm.token_files import WaveletMatrix, build, code_lengths, token_file_index
from graysift.llm.tokens import BYTE_BPE, Encoder, vocabulary_path
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def near_texts():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for b in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 12, 30, 80, 200]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[3][1]), (7, rows[7][1]), (503, rows[9][1].upper()), (504, "één twee"), (505, "ÉÉN twee"), (506, "one"), (507, "ONE"), (508, "a " * 30000)]
    return rows


ROWS = near_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact(docs, empty):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(exact_dedup(docs).select(columns)) == brute.exact(ROWS)
    clash = docs.withColumn("kept", F.lit("x")).withColumn("group_size", F.lit(1)).withColumn("lang", F.lit("nl"))
    got = exact_dedup(clash)
    assert rows_of(got.select(columns)) == brute.exact(ROWS) and "lang" in got.columns
    assert exact_dedup(empty).collect() == []


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (1, 85)])
def test_jaccard(docs, width, num):
    assert rows_of(near_duplicates(docs, width=width, num=num)) == brute.jaccard(ROWS, width, num, 100)


def test_jaccard_of_nothing(empty):
    assert near_duplicates(empty).collect() == []


def passage_texts():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    base = [[rnd.choice(words) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rnd.randint(0, 4)):
            b, a = rnd.choice(base), rnd.randint(0, 30)
            text += b[a : rnd.randint(a, 60)] + [rnd.choice(words) for _ in range(rnd.randint(0, 10))] * (rnd.random() < 0.5)
        rows.append((i, " ".join(text)))
    return rows + [(500, None), (501, ""), (None, rows[3][1]), (7, rows[7][1]), (600, "a " * 300), (601, "A\ta " * 200), (602, "b " * 100), (602, "b " * 100)]


@pytest.mark.parametrize("size,together", [(20, 2000), (12, 5)])
def test_passages(spark, monkeypatch, size, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = passage_texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(repeats.repeated_passages(df, min_words=size)) == sorted(brute.passages(rows, size), key=repr)


def test_passages_of_nothing_and_cutting(spark, empty):
    assert repeats.repeated_passages(empty).collect() == []
    docs = spark.createDataFrame([(1, " a b  c d\n"), (2, "x y"), (3, None)], SCHEMA)
    spans = spark.createDataFrame([(1, 1, 2)], "doc_id long, start_word long, n_words long")
    assert rows_of(repeats.cut_passages(docs, spans)) == [(1, " a d\n"), (2, "x y"), (3, None)]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "'s", "'", "ll", "1", "23", "!", "...", "<|endoftext|>", "<|", " ", "　", "漢", "👍", "\x1c", "\r\n", "_", "Ġ", "ñ", "​", "\x85", "'re", "०", "ª", "²", "word", "Word,"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(5000)] + [None, "", "x" * 5000]
    library = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert Encoder(vocabulary_path(BYTE_BPE), keep=50).encode(texts) == want
    assert Encoder(vocabulary_path(BYTE_BPE)).encode(texts) == want


def test_encoder_asks_each_word_once(monkeypatch):
    """Words are learned once, whatever marks follow them and however many there are; forgotten ones are learned again."""
    learn, asked = Encoder._learn, []
    monkeypatch.setattr(Encoder, "_learn", lambda self, words: asked.append(len(words)) or learn(self, words))
    letters = [chr(97 + k) for k in range(26)]
    words = ["".join(letters[n // 26**p % 26] for p in range(4)) for n in range(150_000)]
    texts = [" ".join(["x", *(w + mark for w in words[k : k + 1000] for mark in ("", ",", "!!"))]) for k in range(0, len(words), 1000)]
    encoder = Encoder(vocabulary_path(BYTE_BPE))
    first = encoder.encode(texts)
    assert sum(asked) == len(words) and encoder.encode(texts) == first and sum(asked) == len(words)
    assert [b for k in range(0, 9, 3) for b in Encoder(vocabulary_path(BYTE_BPE), keep=500).encode(texts[k : k + 3])] == first[:9]
    assert encoder.library.encode(texts[-1], add_special_tokens=False).ids == np.frombuffer(first[-1], "<u4").tolist()


def test_encoder_with_other_rules(tmp_path):
    """A file that puts a space before each text is used text by text."""
    import json

    from tokenizers import Tokenizer

    rules = json.loads(open(vocabulary_path(BYTE_BPE), encoding="utf-8").read())
    rules["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(rules), encoding="utf-8")
    library, texts = Tokenizer.from_file(str(tmp_path / "v.json")), ["a b<|endoftext|>c d", "", None, "x  y"]
    assert Encoder(str(tmp_path / "v.json")).encode(texts) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def ids_of(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(vocabulary_path(BYTE_BPE)).encode(text or "", add_special_tokens=False).ids, end]


def test_packing(spark, docs, empty):
    packed = pack_documents(docs, capacity=64)
    rows = packed.collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"]), []).append(r)
    for i, t in [r for r in ROWS if r[0] in (0, 3, 500, 508)]:
        ids = ids_of(t, 0)
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist() and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])) for r in pieces)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)]])[:-1].tolist() and sum(n for _, n in places) <= 64
    total = sum(r["length"] for r in rows)
    assert len(held) <= -(-total // 64) * 1.05 + 1
    assert pack_documents(empty).collect() == []
    whole = sequences(pack(token_pieces(docs, capacity=64, keep_ids=True), 64)).agg(F.sum("n_tokens"), F.max(F.length("ids"))).first()
    assert whole[0] == total and whole[1] <= 256


def test_plans_are_right_and_reduction_is_safe():
    def best(items, capacity):  # the fewest sequences, by trying all
        items, found = sorted(items, reverse=True), [len(items)]

        def place(k, rooms):
            if len(rooms) >= found[0]:
                return
            if k == len(items):
                found[0] = len(rooms)
                return
            for r in sorted(set(x for x in rooms if x >= items[k])):
                left = list(rooms)
                left[left.index(r)] -= items[k]
                place(k + 1, left)
            place(k + 1, [*rooms, capacity - items[k]])

        place(0, [])
        return found[0]

    rnd = random.Random(8)
    for _ in range(300):
        items = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 8))]
        counts = {s: items.count(s) for s in set(items)}
        runs = plan(counts, 20)
        assert sorted(s for lengths, k in runs for s in lengths * k) == sorted(items) and all(sum(x) <= 20 for x, _ in runs)
        fixed, left = dominance_reduction(counts, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(k for _, k in fixed) + best(rest, 20) == best(items, 20)
    assert best_fit({}) == []


def test_token_files(docs, empty, spark):
    got = [tuple(r) for r in token_file_index(docs, shard_tokens=3000).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(t, 2)
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    assert token_file_index(empty).collect() == []


def test_wavelet_matrix():
    rnd = np.random.default_rng(4)
    many = np.minimum(rnd.geometric(0.001, 150_001) ** 2, 99_999).astype(np.uint32)
    doubling = np.repeat(np.arange(40, dtype=np.uint32), [min(2**k, 9000) for k in range(40)])
    for ids in (rnd.choice(np.array([0, 2, 5, 70000, 9], np.uint32), 200_001, p=[0.7, 0.1, 0.1, 0.05, 0.05]), many, doubling, np.full(3000, 7, np.uint32), np.array([5, 4], np.uint32)):
        m = WaveletMatrix(build(ids, [1, None], np.array([len(ids) - 1, 1])))
        assert (m.decode() == ids).all() and m.documents()[0] == [1, None] and m.documents()[1].tolist() == [len(ids) - 1, 1]
        for at in {0, 1, len(ids) // 3, len(ids) - 1, *(k for k in (1023, 1024, 65535, 65536, 131_073) if k < len(ids))}:
            assert m.access(at) == ids[at]
        for token in {int(ids[0]), int(ids[-1]), int(ids[len(ids) // 2]), int(ids.min()), int(ids.max())}:
            places = np.flatnonzero(ids == token)
            low, high = len(ids) // 5, len(ids) * 2 // 3
            assert m.count(token) == len(places) and m.count(token, low, high) == (ids[low:high] == token).sum()
            for k in {0, len(places) // 2, len(places) - 1}:
                assert m.select(token, k) == places[k]
        assert m.count(123_456) == 0 and m.count(int(ids[0]), 5, 5) == 0
        with pytest.raises(IndexError):
            m.access(len(ids))
        with pytest.raises(IndexError):
            m.select(int(ids[0]), m.count(int(ids[0])))
    empty = WaveletMatrix(build(np.zeros(0, np.uint32), [], np.zeros(0, np.int64)))
    assert len(empty.decode()) == 0 and empty.documents()[0] == [] and empty.count(3) == 0


def test_wavelet_codes_and_pages():
    counts = np.array([2**k for k in range(45)])  # more doublings than the longest code has bits
    size = code_lengths(counts)
    assert size.max() <= 30 and sum(2.0**-k for k in size.tolist()) <= 1
    assert code_lengths(np.array([5])).tolist() == [0] and code_lengths(np.array([1, 1, 2])).tolist() == [2, 2, 1]
    ids = np.random.default_rng(5).integers(0, 500, 400_000).astype(np.uint32)
    data = bytearray(build(ids, [1], np.array([len(ids)])))
    whole = WaveletMatrix(bytes(data))
    assert whole.access(200_000) == ids[200_000] and whole.seen.mean() < 0.5  # a lookup does not read the whole file
    assert len(data) * 8 / len(ids) < 9.6  # entropy is 8.97
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        WaveletMatrix(bytes(data)).decode()
    with pytest.raises(ValueError):
        WaveletMatrix(b"WMX1" + bytes(data)[4:])


def test_token_counts(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in ROWS), key=repr)
    assert rows_of(token_counts(docs)) == want and rows_of(token_counts(docs, head=3)) == want
    assert token_counts(empty).collect() == []


def test_mixing(spark, empty):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(0, 9)), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(700, None, "a"), (701, "", None), (None, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert rows_of(mix(df)) == sorted((tuple(r) for r in got), key=repr) and len(got) == len(rows)
    total, sizes = sum(r["size"] for r in got), {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    order = sorted(s for s in sizes if s) + [None]
    weight, capped = dict(zip(order, (5, 2, 1, 5), strict=True)), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        target = 3 * sizes[s] if s in capped else level * weight[s]
        assert all(abs(r["target"] - target) < 1e-6 * target for r in got if r["source"] == s)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 0.05 * target + 20
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_operators_do_not_read_other_columns(spark):
    """Columns named as their own change nothing, nor does one very long text."""
    rows = [(i, f"w{i % 7} " * (3 + i % 5), "ab"[i % 2]) for i in range(30)] + [(99, "lang " * 200_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("size", "taken", "mark", "range", "target", "row", "n", "part", "tokens", "length", "offset", "piece", "ids", "node", "key", "sig", "word")
    clash = df.withColumns({n: F.lit("clash") for n in names})
    for operator in (mix, token_counts, near_duplicates, repeats.repeated_passages, pack_documents):
        drop = [c for c in ("sequence_id", "offset") if operator is pack_documents]
        assert rows_of(operator(clash).drop(*drop)) == rows_of(operator(df).drop(*drop))
    assert {r["doc_id"]: r["size"] for r in mix(clash).collect()}[99] == 200_000


def test_quality(spark):
    rnd = random.Random(6)
    good, mid, bad = (["good", "fine", "clear"], ["plain", "so"], ["SPAM!!", "BUY!!", "###"])
    rows, labels = [], []
    for i in range(400):
        g = i % 3
        rows.append((i, " ".join(rnd.choice([*(bad, mid, good)[g], "the", "of", "and"]) for _ in range(30))))
        if i < 300:
            labels.append((i, g))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("selected", F.lit("clash"))
    model = train(docs, spark.createDataFrame(labels, "doc_id long, grade int"), 3)
    got = {r["doc_id"]: r for r in grade(docs, model).collect()}
    assert len(got) == len(rows)
    held_out = [round(got[i]["expected_grade"]) == i % 3 for i in range(300, 400)]
    assert sum(held_out) >= 95 and all(got[i]["selected"] == (i % 3 > 0) for i in range(300, 400))
    assert all(r["tail_1"] >= r["tail_2"] for r in got.values())
    assert grade(docs.filter("doc_id < 0"), model).collect() == [] and len(fit([], 3).thresholds) == 2


def test_exact_with_colliding_digests_and_a_hot_text(spark):
    """A digest that many texts share still tells them apart; half of the rows are one text."""
    rows = [(i, f"Text {i % 40}" if i % 2 else "the same") for i in range(4000)] + [(7, None), (None, "THE SAME"), (None, "alone"), (8, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = brute.exact(rows)
    assert rows_of(exact_dedup(docs).select(columns)) == want
    assert rows_of(exact_dedup(docs, digest=lambda t: F.substring(t, 1, 6)).select(columns)) == want
    assert rows_of(exact_dedup(docs, digest=lambda t: F.lit("x")).select(columns)) == want


def test_token_counts_with_a_long_banner(spark):
    """A long pre-token that every document holds is counted with the frequent ones, one over the bound by the join."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    rows = [(i, f"word{i} {'=-' * 60} tail {'ab' * 9000 if i % 3 else ''}") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "part": F.lit("x"), "n_tokens": F.lit(2)})
    assert rows_of(token_counts(docs, head=5).select("doc_id", "n_tokens")) == sorted(((i, len(model.encode(t))) for i, t in rows), key=repr)
    assert "=-" * 60 in {r["part"] for r in frequent_pretokens(docs, 5).collect()}


def test_token_counts_shuffle_a_part_once(spark, monkeypatch):
    """Rare pre-tokens cross the network once: less is shuffled than two passes of their letters would take."""
    rnd = random.Random(4)
    rows = [(i, " ".join(f"{rnd.getrandbits(200):050x}" for _ in range(200))) for i in range(300)]
    docs, context = spark.createDataFrame(rows, SCHEMA), spark.sparkContext._jsc.sc()
    few = spark.createDataFrame([("tail",)], "part string")
    monkeypatch.setattr("graysift.llm.token_counts.frequent_pretokens", lambda *_: few)

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(r := found.apply(k)).stageId(): r.shuffleWriteBytes() for k in range(found.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are no longer small
    try:
        before = shuffled()
        assert len(token_counts(docs).collect()) == len(rows)
        written = sum(n for k, n in shuffled().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < written < 1.5 * sum(len(t) for _, t in rows), written


def test_rare_parts_are_dealt_and_counted(spark):
    """Equal parts meet in one task, copies of one over the bound in several; each row gets its own sum, over many batches."""
    import sentencepiece

    path = vocabulary_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(5)
    rows = [(k, rnd.choice(["zebra", "\u0133sje", "x" * 70, "a\u2581b c", "", f"w{k}", "ab" * LONG_CHARS]), rnd.randint(1, 9)) for k in range(400)]
    found, places = dealt(spark.createDataFrame(rows, "row long, part string, n long").repartition(3)), {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the few rows are put in one task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for r in found.withColumn("task", F.spark_partition_id()).collect():
            places.setdefault(r["part"], set()).add(r["task"])
        got = rows_of(row_tokens(found, path))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {p for p, tasks in places.items() if len(tasks) > 1} == {"ab" * LONG_CHARS}
    assert got == sorted(((k, n * (len(model.encode(p)) if p else 1)) for k, p, n in rows), key=repr)


def test_quality_against_plain_loops(spark):
    """The fit reaches the likelihood of a plain gradient ascent; grades are those of a loop over each document."""
    rnd, dim = random.Random(9), 6
    x = np.array([[rnd.random() for _ in range(dim)] for _ in range(200)])
    y = np.digitize(x @ np.array([3.0, -2, 1, 0, 0, 1]) + np.array([rnd.gauss(0, 0.5) for _ in range(200)]), [0.8, 1.8])
    rows = [(int(g), np.arange(dim, dtype=np.int32), v.astype(np.float32)) for g, v in zip(y, x)]

    def likelihood(w, theta):
        tails = np.hstack([np.ones((200, 1)), 1 / (1 + np.exp(theta[None, :] - (x @ w)[:, None])), np.zeros((200, 1))])
        return np.log(tails[np.arange(200), y] - tails[np.arange(200), y + 1]).sum()

    p = np.array([0.0] * dim + [-0.5, 0.5])
    for _ in range(3000):  # plain ascent on numerical slopes
        base = likelihood(p[:dim], p[dim:])
        slope = np.array([(likelihood(*np.split(p + 1e-5 * e, [dim])) - base) / 1e-5 for e in np.eye(dim + 2)])
        p = p + 0.02 * slope / (1 + np.abs(slope).max() / 10)
    model = fit(rows, 3, steps=3000, rate=0.05, ridge=0.0)
    assert likelihood(model.weights[:dim].astype(float), model.thresholds) >= likelihood(*np.split(p, [dim])) - 0.5

    texts = [(1, "One two two  THREE 44"), (2, ""), (3, None), (4, "a " * 30_000), (4, "a " * 30_000), (5, "\u00e9\u00e9n !!!!! x_y")]
    model = fit([(g, *features(t)) for g, t in ((0, "one one"), (1, "two two 44"), (2, "three \u00e9\u00e9n"))], 3)
    got = grade(spark.createDataFrame(texts, SCHEMA), model).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in texts)
    for r in got:
        slots, values = features(dict(texts)[r["doc_id"]] or "")
        score = float(sum(model.weights[s] * v for s, v in zip(slots, values)))
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert [r["tail_1"], r["tail_2"], r["expected_grade"]] == [pytest.approx(v, rel=1e-4) for v in (*tails, sum(tails))] and r["selected"] == (tails[0] >= 0.5)
