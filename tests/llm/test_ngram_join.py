"""The n-gram join's steps before signatures: what they may leave out, and what long common passages cost."""

import numpy as np
import pyarrow as pa

from graysift.llm import components, ngram_join
from graysift.llm.ngram_join import near_duplicates
from tests.llm import brute


def just_similar_sets(rng, num):
    """Sets in pairs that are just similar enough, the difference on either side or on both; half of each is one passage."""
    passage, sets, pairs = rng.integers(0, 2**64 - 1, 400, dtype=np.uint64), [], []
    for size in [1, 2, 3, *range(4, 60, 5), 97, 250, 777]:
        a = np.concatenate([passage[: size // 2], rng.integers(0, 2**64 - 1, size - size // 2, dtype=np.uint64)])[rng.permutation(size)]
        less, both = size * (100 - num) // 100, size * (100 - num) // (100 + num)
        for b in (a[less:], np.concatenate([a[both:], rng.integers(0, 2**64 - 1, both, dtype=np.uint64)])):
            if less:
                pairs.append((len(sets), len(sets) + 1))
                sets += [np.unique(a), np.unique(b)]
    sets += [np.unique(np.concatenate([passage[:50], rng.integers(0, 2**64 - 1, 50, dtype=np.uint64)])) for _ in range(40)]
    return sets, pairs


def batches(columns, names, size):
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
    return iter([whole.slice(k, size) for k in range(0, whole.num_rows, size)])


def test_look_ups_leave_out_no_similar_set():
    rng = np.random.default_rng(4)
    for num in (80, 90):
        sets, pairs = just_similar_sets(rng, num)
        some = [ngram_join.looked_up(s) for s in sets]
        key, node = np.concatenate(some).view(np.int64), np.repeat(np.arange(len(sets)), [len(s) for s in some])
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        for size in (7, 100_000):
            rows = [ngram_join._looked_up_rows(ngram_join.ELEMENT, key, pa.array(node)).slice(k, size) for k in range(0, len(key), size)]
            shared = np.zeros(len(sets), np.int64)
            for batch in ngram_join._met(iter(rows)):
                np.add.at(shared, batch["node"].to_numpy(), batch["shared"].to_numpy())
            every = np.concatenate(some)
            assert shared.tolist() == [sum(int((every == e).sum() > 1) for e in s) for s in some]
            open_ = [n >= ngram_join.least_shared(len(s), len(x), num, 100) for n, s, x in zip(shared, sets, some, strict=True)]
            assert all(open_[k] for pair in pairs for k in pair) and sum(open_[-40:]) < 20


def test_similar_sets_share_an_element_of_their_prefixes(monkeypatch):
    rng = np.random.default_rng(8)
    for num in (80, 90):
        sets, pairs = just_similar_sets(rng, num)
        size = np.array([len(s) for s in sets])
        element, node = np.concatenate(sets).view(np.int64), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(element, kind="stable")
        columns = [c[order] for c in (element, node, size[node])]
        for frequent, cut in ((1000, 100_000), (5, 3), (5, 64)):
            monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
            told = pa.Table.from_batches(ngram_join._counted(batches(columns, ["element", "node", "size"], cut)))
            assert told["times"].to_numpy().max() <= frequent
            told = told.sort_by([("node", "ascending"), ("times", "ascending"), ("element", "ascending")])
            found = {}
            for batch in ngram_join._prefixes(num, 100)(iter(told.to_batches(cut))):
                for e, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found.setdefault(n, set()).add(e)
            assert all(found[a] & found[b] for a, b in pairs)
            assert not found.keys() & set(range(len(sets) - 40, len(sets)))


def test_passages_of_many_texts_chain_none(spark, monkeypatch):
    """Half of each text is one passage. No sketches of such texts are compared, only those of near copies."""
    rng, passage = np.random.default_rng(2), " ".join(f"p{k}" for k in range(80))
    own = [[f"w{x}" for x in rng.integers(0, 10**9, 80)] for _ in range(300)]
    rows = [(k, f"{' '.join(w)} {passage}") for k, w in enumerate(own)]
    rows += [(1000 + k, f"{' '.join(own[k][:-5])} new {passage}") for k in range(5)]
    sizes, write = {}, ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, num=80).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard(rows, 5, 80, 100))
    assert sum(r["n_links"] for r in got) == 10
    assert sizes["sketches"] <= 20 and sizes["edges"] <= 45
