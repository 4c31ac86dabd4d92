import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate as d
from tidemark.llm.fmindex import FMIndex, WaveletTree

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        x = words(item)
        size = min(10, len(x))
        wanted = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                names.add(name)
    text = ",".join(sorted(str(n) for n in names if n is not None))
    return len(w), len(hit), len(names), hashlib.sha256(text.encode()).hexdigest(), bool(hit)


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 37, 500)
    tree = WaveletTree(seq, 6)
    symbols, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert tree.rank(symbols, at).tolist() == [int((seq[:b] == a).sum()) for a, b in zip(symbols, at, strict=True)]


@pytest.mark.parametrize("sigma", [3, 20])
def test_index_finds_all_occurrences(sigma):
    rng = np.random.default_rng(sigma)
    for _ in range(20):
        seq = np.append(rng.integers(0, sigma, 300), 0).astype(np.int32)
        seq[100:140] = seq[10:50]  # a copy
        index = FMIndex(seq, sigma)
        lengths = rng.integers(1, 6, 40)
        patterns = rng.integers(1, sigma, (40, 5))
        low, high = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, low, high, strict=True):
            expected = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected




@pytest.mark.parametrize("seed,shard,block", [(1, 1 << 19, 2_000_000), (2, 100, 2_000_000), (3, 100, 60)])
def test_equals_brute_force(spark, make_docs, odd, monkeypatch, seed, shard, block):
    monkeypatch.setattr(d, "SHARD_WORDS", shard)
    monkeypatch.setattr(d, "BLOCK_ITEMS_WORDS", block)
    rng = random.Random(seed)
    vocabulary = ["the", "of", "É", "ab1", "x", "Zeta", "q9", "no"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(3)] + [(90, "ab1 of X"), (91, "ab1 of X"), (92, None), (93, text(40)), (94, text(12)), (90, "q9 no q9"), (None, text(11)), (None, "Zeta x É"), (0, text(30))]
    docs = [(100 + i, text(rng.randrange(0, 60)) + (rng.choice(items)[1] or "") + " " + text(5)) for i in range(50)]
    rows = odd + docs
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(d.removal_spans(make_docs(rows), benchmark)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    assert got == sorted((str(i), *brute(t, items)) for i, t in rows)
    kept = d.drop_contaminated(make_docs(rows), benchmark)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not brute(t, items)[4])
    assert kept.columns == make_docs([]).columns


def test_spans_merge():
    assert d.spans(np.array([5, 0, 2, 20]), np.array([3, 3, 3, 1])) == [(0, 8), (20, 21)]
    assert d.spans(np.array([]), np.array([])) == []


def test_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr(d, "_CHUNK", 64)
    text = " ".join(["alpha", "Beta", "x" * 200, "gamma"] * 50)
    known = {b"alpha": 1, b"beta": 2, b"x" * 200: 3}
    assert d.word_ids(text, known).tolist() == [1, 2, 3, 0] * 50


def test_items_of_several_blocks_count_once(spark, make_docs, monkeypatch):
    benchmark = spark.createDataFrame([(1, "one two"), (None, "three four"), (1, "five six"), (None, "seven eight"), (2, "nine ten")], "item_id long, text string").coalesce(1)
    docs = make_docs([(1, "one two three four five six seven eight"), (2, "five six nine ten"), (3, "none")])
    whole, blocks = [], []
    for size, out in ((500_000, whole), (8, blocks)):
        monkeypatch.setattr(d, "BLOCK_ITEMS_WORDS", size)
        out += sorted(tuple(r) for r in d.contamination(d.removal_spans(docs, benchmark)).collect())
    assert whole == blocks
    assert [r[3] for r in blocks] == [2, 2, 0]


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.removal_spans(make_docs([]), none).count() == 0
    assert not d.contamination(d.removal_spans(make_docs([(1, "a b")]), none)).first().contaminated
