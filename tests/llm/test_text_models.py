import random

import numpy as np
import pytest

from tidemark.llm import langid, toxicity


def brute_segments(s):
    """All maximal segments, by taking the best one and searching both sides."""
    best = None
    for a in range(len(s)):
        total = 0.0
        for b in range(a, len(s)):
            total += s[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    return brute_segments(s[:a]) + [best] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_maximal_segments():
    rng = random.Random(0)
    for _ in range(200):
        # distinct sums, so that the best segment is unique
        s = [rng.choice([-1, 1]) * rng.random() for _ in range(rng.randrange(14))]
        got = toxicity.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(s)]
        assert [z for _, _, z in got] == pytest.approx([sum(s[a:b]) for a, b, _ in got])


def test_compressed_scan_equals_whole_scan():
    rng = random.Random(1)
    model = toxicity.Model({}, scale=3.0)
    scorer = toxicity.Scorer(model)
    for _ in range(50):
        s = np.array([rng.choice([-0.1] * 8 + [2.5, 1.0]) + rng.random() * 1e-3 for _ in range(60)])
        whole = [(a, b, model.bits(z, len(s))) for a, b, z in toxicity.maximal_segments(s.tolist())]
        got = scorer.significant(s)
        assert [x[:2] for x in got] == [x[:2] for x in whole if x[2] > 0]


BAD = ["grubby", "vile", "nasty"]


def toxic_corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if toxic else 0))
    return rows, labels


def test_toxicity_learns(spark, make_docs, odd):
    rows, labels = toxic_corpus(600)
    docs, marks = make_docs(rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.trained(spark, docs, marks)
    found = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.id_bucket("doc_id", 4) == 2).where("held").collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in found) and len(found) > 100
    for r in found:
        words = dict(rows)[r.doc_id].split()
        assert all(any(w in BAD for w in words[p.start : p.end]) for p in r.passages)
    rest = toxicity.drop_toxic(docs, model)
    assert rest.columns == docs.columns and rest.count() == 480
    plain = toxicity.score_toxicity(make_docs(odd), model).collect()
    assert len(plain) == len(odd) and all(r.predicted == 0 and 0 <= r.score <= 1 for r in plain)


def test_toxicity_without_labels(spark, make_docs):
    docs = make_docs([(1, "a b c")])
    for rows in ([], [(1, 1)]):
        model = toxicity.trained(spark, docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert toxicity.score_toxicity(docs, model).first().score == pytest.approx(0, abs=1e-9)
    assert toxicity.score_toxicity(make_docs([]), model).count() == 0


def test_copies_lend_no_weight(spark, make_docs):
    rows, labels = toxic_corpus(300)
    copy = " ".join(f"zz{i}" for i in range(40)) + " vile"
    rows += [(1000 + i, copy) for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    model = toxicity.train(make_docs(rows).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.word(b"vile") > 0 and model.word(b"zz7") == toxicity.DRIFT


def brute_viterbi(e, penalty):
    from itertools import product

    score = lambda path: sum(e[t][k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))
    return max(score(p) for p in product(range(e.shape[1]), repeat=len(e))), score


def test_viterbi():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 1, 7, 7, 3])
    e = rng.normal(size=(sizes.sum(), 3)).astype(np.float32) * 3
    label = langid.viterbi(e, sizes, 2.0)
    at = 0
    for n in sizes:
        if n:
            best, score = brute_viterbi(e[at : at + n].astype(float), 2.0)
            assert score(label[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
        at += n


WORDS = {"en": ["the", "thing", "which", "with", "should"], "de": ["über", "nicht", "zwischen", "schön", "für"], "ru": ["привет", "мир", "слово", "это"]}


def language_rows(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(1, 40))), k) for i in range(n) for k in [rng.choice(list(WORDS))]]


def test_languages_and_spans(make_docs, odd):
    rows = language_rows(300)
    docs = make_docs(rows)
    model = langid.train(docs.select("doc_id", "text", "lang").where(langid.id_bucket("doc_id", 5) != 0))
    assert model.langs == ["de", "en", "ru"]
    found = langid.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.id_bucket("doc_id", 5) == 0).collect()
    assert found and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in found)
    mixed = " ".join(WORDS["en"] * 4 + WORDS["de"] * 3 + WORDS["ru"] * 2)
    r = langid.identify_languages(make_docs([(1, mixed)]), model).first()
    assert [(s.start, s.end, s.lang) for s in r.spans] == [(0, 20, "en"), (20, 35, "de"), (35, 43, "ru")]
    plain = {r.doc_id: r for r in langid.identify_languages(make_docs(odd), model).collect() if r.doc_id != 7}
    assert {k for k, v in plain.items() if v.lang_pred == "und"} == {1, 2, 3, 9}
    assert all(v.score == 0 for v in plain.values() if v.lang_pred == "und")


def test_blocks_do_not_change_languages(make_docs, monkeypatch):
    rows = language_rows(80, 3)
    model = langid.train(make_docs(rows).select("doc_id", "text", "lang"))
    texts = [r[1] for r in rows]
    whole = langid.identify(texts, model)
    monkeypatch.setattr(langid, "BLOCK_CHARS", 50)
    assert langid.identify(texts, model) == whole
    assert [langid.identify([t], model)[0] for t in texts] == whole


def test_languages_of_nothing(make_docs):
    none = langid.train(make_docs([]).select("doc_id", "text", "lang"))
    assert langid.identify_languages(make_docs([(1, "a")]), none).first().lang_pred == "und"
    assert langid.identify_languages(make_docs([]), none).count() == 0


def test_many_languages(make_docs):
    # more labels than fit a byte; each language has a word of its own
    langs = [f"l{i:03d}" for i in range(300)]
    rng = random.Random(5)
    word = {k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for k in langs}
    e = np.full((300, 300), -20, np.float32)
    e[np.arange(300), np.arange(300)] = 0
    assert langid.viterbi(e, np.ones(300, np.int64)).tolist() == list(range(300))
    assert langid.viterbi(np.tile(e[299:], (5, 1)), np.array([5])).tolist() == [299] * 5
    rows = [(i, " ".join([word[k]] * 5), k) for i, k in enumerate(langs)] + [(900, "the only one", "l299")]
    model = langid.train(make_docs(rows).select("doc_id", "text", "lang"))
    assert len(model.langs) == langid.MAX_LANGS and "l299" in model.langs and "l298" not in model.langs


def plain_language(rows, text):
    """Language and spans by dictionaries and lists, word by word."""
    import math
    import unicodedata
    from collections import Counter

    letter = lambda c: unicodedata.category(c)[0] in "LM"

    def words(text):
        out, at = [], None
        padded = "\n" + text.lower() + "\n"
        for i, c in enumerate(padded):
            if letter(c) and at is None:
                at = i
            if not letter(c) and at is not None:
                out.append([tuple(ord(padded[j]) if letter(padded[j]) else 32 for j in (k - 1, k, k + 1)) for k in range(at, i)])
                at = None
        return out

    mask, size = (1 << 32) - 1, 1 << langid.BUCKET_BITS
    mix = lambda x: (x * 2654435761 & mask) >> 32 - langid.BUCKET_BITS
    gram = lambda b, h, a: mix((b * 31 + h) * 1009 + a & mask)
    pair = lambda b, h, a: mix(b * 8191 + h + 77 & mask)
    script = lambda w: next((s for s, lo, hi in langid.SCRIPTS if lo <= w[0][1] <= hi), "other")
    langs = sorted({k for _, _, k in rows})
    seen = {k: (Counter(), Counter(), Counter()) for k in langs}
    for _, t, k in rows:
        for w in words(t):
            for c in w:
                seen[k][0][gram(*c)] += 1
                seen[k][1][pair(*c)] += 1
                seen[k][2][script(w)] += 1
    log = lambda counts, x: math.log((counts[x] + 0.5) / (sum(counts.values()) + 0.5 * size))
    fits = lambda k, s: seen[k][2][s] >= langid.SCRIPT_SHARE * max(1, sum(seen[k][2].values()))
    path, back = [0.0] * len(langs), []
    found = words(text)
    for w in found:
        own = [sum(log(seen[k][0], gram(*c)) + log(seen[k][1], pair(*c)) for c in w) - (0 if fits(k, script(w)) or not any(fits(j, script(w)) for j in langs) else 1e4) for k in langs]
        best = max(path) - langid.SWITCH_PENALTY
        back.append([j if path[j] >= best else path.index(max(path)) for j in range(len(langs))])
        path = [max(path[j], best) + own[j] for j in range(len(langs))]
    label, at = [], path.index(max(path))
    for b in reversed(back):
        label.append(at)
        at = b[at]
    label.reverse()
    share = Counter()
    for w, k in zip(found, label, strict=True):
        share[langs[k]] += len(w)
    best = max(langs, key=lambda k: (share[k], -langs.index(k)))
    spans = []
    for i, k in enumerate(label):
        if spans and spans[-1][2] == langs[k]:
            spans[-1] = (spans[-1][0], i + 1, langs[k])
        else:
            spans.append((i, i + 1, langs[k]))
    return best, share[best] / sum(share.values()), spans


def test_languages_equal_brute_force(make_docs):
    rows = language_rows(40, 8)
    model = langid.train(make_docs(rows).select("doc_id", "text", "lang"))
    rng = random.Random(2)
    texts = [r[1] for r in language_rows(25, 9)] + [" ".join(rng.choice(WORDS[k]) for k in ("en", "de", "ru") for _ in range(rng.randrange(1, 9))) for _ in range(10)]
    for text, guess in zip(texts, langid.identify(texts, model), strict=True):
        lang, score, spans = plain_language(rows, text)
        assert (guess.lang, guess.spans) == (lang, spans) and guess.score == pytest.approx(score)


def plain_toxicity(rows):
    """Training and scoring by dictionaries; ``rows``: text, label, fold."""
    import math
    import re
    from collections import Counter

    t = toxicity
    words = lambda text: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())

    def names(word):
        raw = word.encode()
        return [raw + b" ", *[raw[:k] for k in t.BEGINNINGS if len(raw) >= k]]

    contexts = [set(), set()]
    for text, label, fold in rows:
        if fold:
            w = words(text)
            contexts[label] |= set(zip(w, ["", *w]))
    counts = [Counter(w for w, _ in c) for c in contexts]
    total = [sum(c.values()) for c in counts]
    weight, left = {}, counts[0].keys() | counts[1].keys()
    mass = t.PRIOR_SHARE * sum(total)
    for level in range(1 + len(t.BEGINNINGS)):
        size = (None, *t.BEGINNINGS)[level]
        token = {w: w.encode() + b" " if size is None else w.encode()[:size] for w in left if size is None or len(w.encode()) >= size}
        toxic, clean = (Counter() for _ in range(2))
        for w, k in token.items():
            toxic[k] += counts[1][w]
            clean[k] += counts[0][w]
        for k in set(token.values()):
            prior = t.PRIOR_SHARE * (toxic[k] + clean[k])
            a, b = toxic[k] + prior, clean[k] + prior
            odds = math.log(a / (total[1] + mass - a)) - math.log(b / (total[0] + mass - b))
            spread = math.sqrt(1 / a + 1 / b)
            shy = odds - math.copysign(t.SHRINK * spread, odds)
            if abs(odds) >= t.MIN_Z * spread and math.copysign(1, odds) * shy >= t.MIN_WEIGHT:
                weight[k] = shy
        left = {w for w in left if token.get(w) not in weight}
    score = lambda text: [next((weight[n] for n in names(w) if n in weight), t.DRIFT) for w in words(text)]
    clean = [score(text) for text, label, fold in rows if not fold and not label]
    seen = Counter(round(s, 2) for x in clean for s in x)
    for w in weight.values():
        if w > 0:
            seen[round(w, 2)] += 1 / len(weight)
    n = sum(seen.values())
    f = lambda x: sum(c / n * math.exp(x * s) for s, c in seen.items()) - 1
    low, high = 0.0, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    best = [(len(s), max([z for _, _, z in brute_segments(s)] or [0.0])) for s in clean if s]
    floor = min(w for w in weight.values() if w > 0)
    there = 1 + sum(z > 0 for _, z in best)
    low = min(low, there / (sum(max(0, z - floor) for _, z in best) + 1 / low))
    k = there / sum(n * math.exp(-low * max(0, z - floor)) for n, z in best) * math.exp(low * floor)

    def evidence(text):
        s = score(text)
        bits = [low * z - math.log(max(1.0, k * len(s))) for _, _, z in brute_segments(s)]
        return sum(b for b in bits if b > 0)

    held = [(evidence(text), label) for text, label, fold in rows if not fold]
    a, b = toxicity._logistic(np.array([x for x, _ in held]), np.array([float(y) for _, y in held]))
    return low, k, lambda text: 1 / (1 + math.exp(-(a + b * evidence(text))))


def test_toxicity_equals_brute_force(spark, make_docs):
    rows, labels = toxic_corpus(260, 11)
    rows = [(i, " ".join(t.split()[:25]) + (" vile" if i % 5 == 0 else "")) for i, t in rows]
    marks = spark.createDataFrame([*labels, (3, 1 - dict(labels)[3])], "doc_id long, toxic int")
    model = toxicity.train(make_docs(rows).select("doc_id", "text"), marks)
    fold = {r.doc_id: r.fold for r in spark.sql(f"SELECT id AS doc_id, pmod(xxhash64(id, 12), {toxicity.FOLDS}) AS fold FROM range(260)").collect()}
    scale, k, score = plain_toxicity([(t, dict(labels)[i], fold[i]) for i, t in rows if i != 3])
    assert (model.scale, model.k) == pytest.approx((scale, k), rel=1e-6)
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(make_docs(rows[:60]), model).collect()}
    assert [found[i] for i, _ in rows[:60]] == pytest.approx([score(t) for _, t in rows[:60]], rel=1e-5)


def test_a_labelled_id_in_many_rows_teaches_once(spark, make_docs):
    rows, labels = toxic_corpus(100, 12)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = make_docs(rows + [(5, f"text {i}") for i in range(400)])
    assert toxicity.labelled_sample(docs.select("doc_id", "text"), marks).count() == 100
    assert toxicity.labelled_sample(docs.select("doc_id", "text"), marks, rows=40).count() < 80
    small = toxicity.labelled_sample(docs.select("doc_id", "text"), marks, chars=4000)
    assert 0 < small.count() < 60
