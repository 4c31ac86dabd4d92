import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in fps}


def test_fingerprints(make_docs, odd):
    found = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(make_docs(odd)).collect()}
    assert found == {(i, f"{brute_fingerprint(t):016x}") for i, t in odd}


def planted(n, seed):
    """Random fingerprints with chains of near ones, by few flipped bits."""
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        fp = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            fp ^= 1 << b
        fps.append(fp)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize("leaf,sample", [(16, 100_000), (16, 64), (1024, 100_000)])
def test_trees_lose_no_link(spark, monkeypatch, leaf, sample):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "TREE_SAMPLE", sample)
    fps = dict(enumerate(planted(700, leaf)))
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in fps.items()}
    df = spark.createDataFrame([(k, v) for k, v in signed.items()], "doc_id long, fp long")
    named = simhash.rooted(df)
    by = named.groupBy("root").agg(F.min("least").alias("c"))
    found = {r.least: r.c for r in named.join(by, "root").collect()}
    assert found == brute_components(fps)


def test_guests_reach_every_leaf_they_must():
    rng = np.random.default_rng(1)
    halves = rng.integers(0, 1 << 32, 4000, dtype=np.uint64).astype(np.uint32)
    near = halves ^ (np.uint32(1) << rng.integers(0, 32, len(halves)).astype(np.uint32))
    tree = simhash.VantageTree(halves[:500], 6, 3)
    a, b = ({(r, l) for r, l in zip(*map(np.ndarray.tolist, tree.route(x)))} for x in (halves, near))
    assert {r for r, _ in a & b} == set(range(len(halves)))


@pytest.mark.parametrize("depth", [0, 3])
def test_large_leaves_are_split_where_they_are(spark, monkeypatch, depth):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "MAX_DEPTH", depth)
    fps = dict(enumerate(planted(500, depth)))
    df = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in fps.items()], "doc_id long, fp long")
    named = simhash.rooted(df)
    found = {r.least: r.c for r in named.join(named.groupBy("root").agg(F.min("least").alias("c")), "root").collect()}
    assert found == brute_components(fps)


def test_dense_groups_do_not_multiply():
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    dense = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}
    fps = np.array(sorted(dense | {rng.getrandbits(64) for _ in range(4000)}), np.uint64)
    halves = (fps >> np.uint64(32)).astype(np.uint32)
    row, _ = simhash.VantageTree(halves, 6, 1).route(halves)
    assert len(row) < 8 * len(fps)
    a, b = simhash.tree_stars(fps, 32)
    joined = {int(x) for x in a[b == b[np.flatnonzero(a == np.uint64(centre))[0]]]} if (a == np.uint64(centre)).any() else {int(x) for x in a}
    assert len(joined & dense) >= len(dense) - 1


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate(make_docs):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t) for i, t in enumerate(base)] + [(20, base[0].upper()), (1, base[1]), (None, base[2]), (30, None), (31, "")]
    kept = simhash.deduplicate(make_docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 30]
    assert kept.columns == make_docs([]).columns
    assert simhash.deduplicate(make_docs([])).count() == 0


def test_groups_that_no_vantage_point_divides(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    for flips in (4, 6, 9):
        fps = []
        for _ in range(400):
            fp = centre
            for b in rng.sample(range(64), flips):
                fp ^= 1 << b
            fps.append(fp)
        fps = sorted(set(fps))
        a, b = simhash.dense_stars(np.array(fps, np.uint64), np.arange(64))
        expected = brute_components({f: f for f in fps})
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = sorted((find(x), find(y)))
            parent[y] = x
        assert {f: find(f) for f in fps} == expected


def test_one_row_of_rows_alike_is_the_same_one(spark):
    rows = [(1, "a b c d", n) for n in (3, 1, 2)] + [(2, "other words here", 9)]
    kept = [sorted(tuple(r) for r in simhash.deduplicate(spark.createDataFrame(rows[::step], "doc_id long, text string, more int")).collect()) for step in (1, -1)]
    assert kept[0] == kept[1] and len(kept[0]) == 2
