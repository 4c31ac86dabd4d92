import random
from collections import Counter

import pytest

from tidemark.llm import mixing


def brute_targets(sizes):
    """``sizes``: words by source, in order; the excess is shared again until none is left."""
    total, weight = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    while True:
        room = total - sum(3 * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        for i in open_:
            target[i] = room * weight[i] / sum(weight[j] for j in open_)
        over = {i for i in open_ if target[i] > 3 * sizes[i]}
        if not over:
            return target
        for i in over:
            target[i] = 3.0 * sizes[i]
        full |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 100, 3000]) for _ in range(9)]
    names = sorted(f"s{i}" for i in range(8)) + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert [found[n] for n in names] == pytest.approx(brute_targets(sizes))


def documents(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        source = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 7, 90, 400]))), "en", source))
    return rows + [(5, "w w w", "en", "a"), (5, "w w w", "en", "a"), (None, "w " * 50, "en", "b"), (400, None, "en", "tiny"), (401, "w", "en", "tiny")]


def test_mix(make_docs):
    rows = documents()
    found = mixing.mix(make_docs(rows), block_words=16).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len((t or "").split())) for i, t, _, _ in rows)
    by = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        by[r.target, r.source_size] = by.get((r.target, r.source_size), 0) + r.taken
    for (target, size), taken in by.items():
        assert taken == int(target)
        assert target <= 3 * size + 1e-6
    again = mixing.mix(make_docs(rows[::-1]).repartition(5), block_words=16).collect()
    assert Counter(found) == Counter(again)


def test_schedule_is_spread_evenly(spark):
    targets = spark.createDataFrame([(1, 64_000, 16_000.0), (2, 64_000, 32_000.0), (3, 64_000, 48_000.0)], "k int, source_size long, target double")
    slots = mixing.schedule(targets, 64).orderBy("slot").collect()
    assert len(slots) == 1500 and [s.slot for s in slots] == sorted({s.slot for s in slots})
    seen = Counter()
    for n, s in enumerate(slots, 1):
        assert s.rank == seen[s.k]
        seen[s.k] += 1
        if n <= 1490:
            assert all(abs(seen[k] - n * k / 6) < 4 for k in (1, 2, 3)), n


def test_ranks_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 50)
    targets = spark.createDataFrame([(1, 1000, 900.0), (2, 1000, 2000.0)], "k int, source_size long, target double")
    ranks = {}
    for s in mixing.schedule(targets, 4).orderBy("slot").collect():
        ranks.setdefault(s.k, []).append(s.rank)
    assert ranks == {1: list(range(225)), 2: list(range(500))}


def test_resample(make_docs):
    rows = documents(1)
    df = make_docs(rows)
    played = mixing.resample(df, block_words=16)
    assert played.columns == df.columns
    n = Counter(r.doc_id for r in played.select("doc_id").collect())
    expected = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(df, block_words=16).collect() if r.size and r.doc_id not in (5, None)}
    assert {k: v for k, v in n.items() if k not in (5, None)} == {k: v for k, v in expected.items() if v}


def test_empty(make_docs, odd):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.resample(make_docs([])).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(make_docs([(1, None), (2, "")])).collect())
    assert mixing.mix(make_docs(odd)).count() == len(odd)


def test_no_python_in_the_plan(make_docs):
    plan = mixing.mix(make_docs([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "BroadcastNestedLoop"))


def test_reruns_agree_on_rows_of_one_id(make_docs):
    rows = [(7, f"text number {i} " + "w " * (i % 3), "en", "a") for i in range(40)] + [(7, "x y", "en", "a")] * 30 + [(None, "x y", "en", "b")] * 5 + [(8, "only one", "en", "c")]
    first, second = (Counter(r.text for r in mixing.resample(make_docs(rows[::step]).repartition(n), block_words=4).select("text").collect()) for step, n in ((1, 3), (-1, 7)))
    assert first == second
    whole = [Counter(tuple(r) for r in mixing.mix(make_docs(rows[::step]).repartition(n), block_words=4).collect()) for step, n in ((1, 3), (-1, 7))]
    assert whole[0] == whole[1] and sum(whole[0].values()) == len(rows)


def test_slots(make_docs, spark):
    rows = documents(3)
    found = mixing.mix(make_docs(rows), block_words=16).collect()
    assert all((r.first_slot is None) == (r.taken == 0) for r in found)
    # every slot's words are somebody's
    sizes = make_docs(rows).select("source", mixing.word_count("text").alias("size"))
    slots = mixing.schedule(mixing.source_targets(sizes), 16).collect()
    assert sum(s.words for s in slots) == sum(r.taken for r in found)
    assert {r.first_slot for r in found if r.taken} <= {s.slot for s in slots}


@pytest.mark.parametrize("part_slots", [1 << 15, 50])
def test_output_is_in_the_order_of_the_schedule(make_docs, monkeypatch, part_slots):
    monkeypatch.setattr(mixing, "PART_SLOTS", part_slots)
    rows = [r for r in documents(4) if r[0] not in (5, None)]
    slot = {r.doc_id: r.first_slot for r in mixing.mix(make_docs(rows), block_words=16).collect()}
    seen, firsts = set(), []
    for r in mixing.resample(make_docs(rows), block_words=16).select("doc_id").collect():
        if r.doc_id not in seen:
            seen.add(r.doc_id)
            firsts.append(slot[r.doc_id])
    assert firsts == sorted(firsts)


def test_totals_over_many_sources(spark):
    rng = random.Random(1)
    rows = [(f"s{i:04d}", rng.randrange(1, 50)) for i in range(500)] + [(None, 3)]
    df = spark.createDataFrame(rows, "source string, size long").repartition(6)
    found = {r.source: r for r in mixing.source_targets(df).collect()}
    assert [found[n].k for n, _ in rows] == list(range(1, 502))
    assert [found[n].target for n, _ in rows] == pytest.approx(brute_targets([s for _, s in rows]))
