import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, none, rows_of, shingles
from quire.llm import neardup as N

SCHEMA = "doc_id long, text string"


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def variants(seed, groups=6, size=40):
    """Groups of copies with 0 to 6 words changed: chains, near misses and exact copies."""
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"w{g}_{rng.randrange(400)}" for _ in range(rng.choice((4, 12, 90, 150)))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = f"c{rng.randrange(60)}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_equal_brute_force(spark):
    docs = variants(5)
    assert rows_of(N.near_duplicates(spark.createDataFrame(docs, SCHEMA))) == sorted(brute(docs), key=str)


def test_large_buckets_split_into_blocks(spark, monkeypatch):
    docs = variants(8, groups=2, size=90)
    monkeypatch.setattr(N, "BLOCK", 16)
    assert rows_of(N.near_duplicates(spark.createDataFrame(docs, SCHEMA))) == sorted(brute(docs), key=str)


def row_brute(docs):
    """As `brute`, with rows as nodes: rows of one id but different texts are different documents."""
    got = brute([(k, t) for k, (_, t) in enumerate(docs)])
    least = {}
    for k, _, comp, _ in got:
        least[comp] = min(least.get(comp, docs[k][0]), docs[k][0])
    return sorted(((docs[k][0], n, least[comp], least[comp] == docs[k][0]) for k, n, comp, _ in got), key=str)


@pytest.mark.parametrize("outside", [0, 1 << 14])
def test_buckets_of_many_different_documents(spark, monkeypatch, outside):
    """Documents around one shared passage, some of them near copies: with few rows a block, both ways equal brute force."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(120)]
    docs = []
    for _ in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        for _ in range(rng.choice((1, 1, 2, 3))):
            w = list(own)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(50)] = f"c{rng.randrange(10**6)}"
            docs.append(" ".join(w[:25] + passage + w[25:]))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "OUTSIDE", outside)
    monkeypatch.setattr(N, "NEAR_BITS", 30)  # fewer links by leaders, so that more is left to the crossings
    called = []
    by_shingle = N._by_shingle
    monkeypatch.setattr(N, "_by_shingle", lambda *a: called.append(1) or by_shingle(*a))
    assert rows_of(N.near_duplicates(spark.createDataFrame(docs, SCHEMA))) == sorted(brute(docs), key=str)
    assert bool(called) == (outside == 0)


def test_groups_by_shingle_hold_every_similar_pair():
    docs = [t for _, t in variants(11, 4, 20)]
    col = pa.array(docs)
    sets = list(N.shingle_sets(col))
    every = np.concatenate(sets)
    names, n = np.unique(every, return_counts=True)
    frequent = names[n > 12]
    batch = next(N._heads(frequent)([pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), col], ["rep", "text"])]))
    held = {}
    for rep, key in zip(*[x.to_pylist() for x in batch.columns]):
        held.setdefault(rep, set()).add(key)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                assert held[i] & held[j]


def test_one_id_with_two_texts(spark):
    rng = random.Random(2)
    text = lambda: [f"w{rng.randrange(9999)}" for _ in range(60)]
    a, q, z = text(), text(), text()
    near = lambda w: " ".join([*w, "tail"])
    docs = [(1, " ".join(a)), (1, " ".join(q)), (2, near(a)), (3, near(q)), (5, " ".join(z)), (5, " ".join(z)), (6, near(z)), (6, " ".join(text()))]
    df = spark.createDataFrame(docs, SCHEMA)
    for n in (1, 5):
        assert rows_of(N.near_duplicates(df.repartition(n))) == row_brute(docs)
    kept = sorted(map(tuple, N.keep_one(df).collect()))
    assert kept == sorted([docs[0], docs[1], docs[4], docs[7]])


def test_threshold_is_inclusive(spark):
    a = [f"w{i}" for i in range(9)]  # five shingles; one changed word at the end leaves four of six
    docs = [(1, " ".join(a)), (2, " ".join([*a, "x"])), (3, " ".join([*a, "x", "y"]))]
    assert rows_of(N.near_duplicates(spark.createDataFrame(docs, SCHEMA))) == sorted(brute(docs), key=str)


def test_awkward_rows(spark):
    got = {(r.doc_id, r.n_shingles): r for r in N.near_duplicates(awkward(spark)).collect()}
    assert N.near_duplicates(awkward(spark)).count() == awkward(spark).count()
    assert got[22, 0].component_id == 22 and got[22, 0].kept
    assert got[28, 1].component_id == 27 and not got[28, 1].kept
    assert all(r.component_id is None and r.kept for r in got.values() if r.doc_id is None)
    assert N.near_duplicates(none(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = N.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 28 not in ids and 27 in ids and ids.count(21) + ids.count(1) == 1 and ids.count(None) == 2


def test_whole_sketch_is_a_lower_bound():
    docs = [t for _, t in variants(3, 2, 30)]
    col = pa.array(docs)
    sets = list(N.shingle_sets(col))
    maps = [np.frombuffer(x, np.uint64) for b in N._whole_sketches([pa.RecordBatch.from_arrays([pa.array(range(len(docs))), col], ["rep", "text"])]) for x in b.column(1).to_pylist()]
    for i in range(len(docs)):
        for j in range(i):
            assert np.bitwise_count(maps[i] ^ maps[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_odd_sketch_tracks_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    mins = []
    for keep in (400, 370, 343, 280, 200):  # of the base; the rest is new
        mins.append(N.minhash(np.concatenate([base[:keep], rng.integers(0, 1 << 63, 400 - keep, dtype=np.uint64)])))
    sk = N.odd_sketches(np.array(mins)).view(np.uint64)
    bits = [int(np.bitwise_count(sk[0] ^ s).sum()) for s in sk]
    assert bits[0] == 0 and bits == sorted(bits) and bits[2] <= 100 and bits[4] > N.NEAR_BITS
