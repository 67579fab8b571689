"""Conversation repair, importance resampling and byte-level BPE against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graysift.llm import conversations, queries
from graysift.llm.byte_bpe import ByteBPE, PairTable, byte_bpe, decode_documents, encode_documents
from graysift.llm.conversations import damaged, repair_conversations
from graysift.llm.resampling import TournamentTree, bucket_gains, merged, resample
from graysift.llm.tokens import vocabulary_path


# conversations


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def least_edits(own):
    """(cost, letters, turns) by trying all edits of each suffix, least cost and then least letters."""
    best = {len(own): {q: min(x for x in [(0, "", ()) if q in "0a" else None, (5, "I", (("assistant", ""),)) if q == "u" else None, (10, "II", (("user", ""), ("assistant", ""))) if q == "s" else None] if x) for q in "0sua"}}
    after = {"0": "su", "s": "u", "u": "a", "a": "u"}
    for k in range(len(own) - 1, -1, -1):
        role, text, fault = own[k]

        def by_row(q):
            found = []
            c, l, t = best[k + 1][q]
            found.append((c + 2, "D" + l, t))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] and role[0] in after[q]:
                    c, l, t = best[k + 1][role[0]]
                    found.append((c + extra, "K" + l, ((role, text), *t)))
                for new in ("user", "assistant"):
                    if new[0] in after[q]:
                        c, l, t = best[k + 1][new[0]]
                        found.append((c + 1 + extra, "R" + l, ((new, text), *t)))
            return min(found)

        plain = {q: by_row(q) for q in "0sua"}
        with_one = {}
        for q in "0sua":
            found = [plain[q]]
            path, state = (), q
            for n in range(1, 4):  # inserted before the row, one after another
                state = "a" if state == "u" else "u"
                path += (("user" if state == "u" else "assistant", ""),)
                c, l, t = plain[state]
                found.append((c + 5 * n, "I" * n + l, (*path, *t)))
            with_one[q] = min(found)
        best[k] = with_one
    return best[0]["0"]


def repaired(rows):
    """All conversations of rows (before damage), by plain loops."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        turns, seen, judged, counts = {r[1] for r in own} - {None}, set(), [], Counter()
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = least_edits(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def conversation_rows():
    rnd = random.Random(5)
    rows = []
    for conv in range(150):
        turn = rnd.choice([0, 0, 3])
        for _ in range(rnd.choice([1, 2, 3, 5, 9, 14])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "User"])
            text = rnd.choice(["Hi.", "Hi", "What?  ", "yes! ", "  ", "", None, "é…", "a\nb.", f"t{rnd.randrange(4)}.", "long " * 5000 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn, None]), role, text))
            turn += rnd.choice([1, 1, 1, 2, 0])
    rows += [(None, k, "user" if k % 2 else "assistant", f"n{k}.") for k in range(9)] + [(None, None, "user", "same.")] * 6
    rows += [(900, k, ("user", "assistant")[k % 2], ("ok.", "fine.", "what", "no!")[k % 4] if k % 7 else f"x{k}.") for k in range(60)]
    dropped = next(k for k in range(1000, 9999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")]


@pytest.mark.parametrize("long_rows,bits", [(4096, 16), (4, 2), (0, 0)])
def test_conversations(spark, monkeypatch, long_rows, bits):
    monkeypatch.setattr(conversations, "FRAGMENT_BITS", bits)
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).withColumn("audit", F.lit(1)).repartition(3)
    got = repair_conversations(damaged(df), long_rows=long_rows)
    assert got.columns == conversations.FACTS
    want = repaired(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert want[-1][7] is not None and any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in want)


@pytest.mark.parametrize("long_rows", [4096, 3])
def test_repaired_turns(spark, long_rows):
    """The turns that the digest is of are given, follow the pattern and cost what the letters say."""
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    facts, turns = {}, {}
    for r in repair_conversations(damaged(df), turns=True, long_rows=long_rows).collect():
        if r["place"] is None:
            facts[r["conv_id"]] = r
        else:
            turns.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    assert len(facts) == len({r[0] for r in rows})
    for conv, r in facts.items():
        own = sorted(turns.get(conv, []))
        assert [t[0] for t in own] == list(range(len(own))) and re.fullmatch("(s?(ua)+)?", "".join(t[1][0] for t in own))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in own).encode()).hexdigest() == r["repaired_sha256"]
        assert len(own) == len(r["audit"].replace("D", ""))


def test_conversations_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(damaged(df)).collect() == []


# resampling


def resampled(docs, target, percent=10, least=20, buckets=10_000, length=1, seed="2024"):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, length + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out, eligible = [], []
    for k, (i, text) in enumerate(docs):
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(text)) >= least:
            eligible.append(k)
    eligible.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(eligible[: percent * len(eligible) // 100], 1):
        out[k][4] = rank
    return sorted((tuple(r) for r in out), key=repr)


def resampling_rows():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["ÉÉN", "naïve", "日本"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([5, 19, 20, 40, 90])))) for i in range(400)]
    docs += [(1000 + i, docs[4][1]) for i in range(300)] + [(2000, None), (2001, ""), (2002, "!!! ---"), (2003, "W1 w2. " * 9000), (-5, docs[9][1]), (None, docs[3][1] + " w1 " * 30)]
    return docs, [" ".join(rnd.choice(words[:40]) for _ in range(60)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"percent": 100, "least_words": 0}, {"percent": 50, "length": 2, "buckets": 64}])
def test_resampling(spark, options):
    docs, target = resampling_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash")).repartition(7)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    want = resampled(docs, target, **{"least" if k == "least_words" else k: v for k, v in options.items()})
    for sizes in ({}, {"slice_rows": 16, "run_rows": 30}):
        assert sorted((tuple(r) for r in resample(df, t, **options, **sizes).collect()), key=repr) == want


def test_resampling_of_hot_scores(spark):
    """Repeated ids have one score; slices cut it by id, and every rank is given once."""
    rows = [(i % 40, "one two three") for i in range(2000)] + [(None, "one two three")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample(df, df.limit(0), percent=70, least_words=1, slice_rows=20, run_rows=100).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 70 * 2050 // 100 + 1))
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked]
    assert keys == sorted(keys) and keys == sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got)[: len(keys)]


def test_resampling_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert resample(df, df).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in resample(one, df).collect()] == [(1, 2, resampled([(1, "a b")], [])[0][2])]
    assert bucket_gains(*([__import__("numpy").zeros(4, int)] * 2)).tolist() == [0, 0, 0, 0]


def test_tournament():
    rnd = random.Random(2)
    for n in (0, 1, 2, 7, 40):
        runs = [sorted((rnd.randrange(50), rnd.random()) for _ in range(rnd.randrange(1, 30))) for _ in range(n)]
        blocks = sorted((r[k : k + 4] for r in runs for k in range(0, len(r), 4)), key=lambda b: b[0])
        assert list(merged(iter(blocks))) == sorted(x for r in runs for x in r)
    tree = TournamentTree()
    places = [tree.add((k,)) for k in (5, 3, 9)]
    assert tree.least() == (places[1], (3,))
    tree.replace(places[1], None)
    assert tree.least() == (places[0], (5,)) and tree.add((4,)) == places[1] and tree.least()[1] == (4,)


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_texts():
    rnd = random.Random(4)
    texts = [None, "", " ", "a", "<|endoftext|> it's", "a" * 3000, "abc" * 999, " " * 777 + "x", "=-" * 300, "日本語テキスト" * 40, "👩‍👩‍👧 é ü\x00\x01", "\n\n \t x", " \x1c x", "a \x1cb c\x85 d e\xa0 f", "a  b", "end "]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(6000)), "".join(chr(rnd.randrange(0x20, 0x2FFF)) for _ in range(3000))]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(60, 300))) for _ in range(150)]
    return texts + [" ".join("".join(rnd.choice("etaoinshrdluABC'-.0123456789éß") for _ in range(rnd.randrange(1, 60))) for _ in range(200)) for _ in range(60)]


def test_byte_bpe(spark, library):
    texts = bpe_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[4]), (4, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(4)
    got = decode_documents(encode_documents(df)).collect()
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in got), key=repr) == want
    assert decode_documents(encode_documents(df.limit(0))).collect() == []


def test_merge_is_the_plain_rule():
    """Against merging the leftmost pair of least rank one by one, over small vocabularies whose tokens overlap in odd ways."""
    rnd = random.Random(6)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(rnd.randrange(3, 40)):
            ranks.setdefault(bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 6))), len(ranks))
        own = ByteBPE(ranks, r"\S+")
        pieces = [bytes(rnd.choice(b"abc") for _ in range(n)) for n in (1, 2, 5, 17, 40, 70, 200)]
        for piece, ids in zip(pieces, own.merge(pieces), strict=True):
            parts = [bytes([b]) for b in piece]
            while True:
                pairs = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
                if not pairs:
                    break
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert list(memoryview(ids).cast("i")) == [ranks[p] for p in parts]


def test_pair_table_and_memory(library):
    pairs = {a << 32 | b: a * b + 1 for a in range(40) for b in range(40)}
    np = __import__("numpy")
    left, right = np.meshgrid(np.arange(-1, 45, dtype=np.int32), np.arange(-1, 45, dtype=np.int32))
    got = PairTable(pairs).ranks(left, right)
    none = 2**31 - 1
    assert all(got[i, j] == (a * b + 1 if 0 <= a < 40 and 0 <= b < 40 else none) for (i, j), a in np.ndenumerate(left) for b in [right[i, j]])
    coder = byte_bpe(vocabulary_path("byte_bpe_50k.tiktoken"))
    few = ByteBPE(coder.ranks, public_tokenizers.PATTERN, keep=8)
    texts = [t for t in bpe_texts() if t and len(t) < 9000]
    assert [x.tolist() for t in texts for x in few.encode([t])] == [library.encode_ordinary(t) for t in texts]


def test_queries_of_new_operators(spark, library, tmp_path):
    """The registered queries over a small folder, their columns and digests."""
    docs, target = resampling_rows()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = conversation_rows()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_byte_bpe(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "string", "string"]
    want = []
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((tuple(r) for r in queries.op12_importance_resampling(spark, str(tmp_path)).collect()), key=repr) == resampled(docs, target)
    assert sorted((tuple(r) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()), key=repr) == repaired(rows)
