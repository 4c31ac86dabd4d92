import random
import re
from collections import Counter

from tidemark.llm import quality
from tidemark.llm.common import bounded_sample, columns

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_counts_equal_brute_force(make_docs, odd):
    rng = random.Random(3)
    rows = odd + [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "é ", "# ", "a b c d e f "]) for _ in range(rng.randrange(60)))) for i in range(60)]
    found = quality.quality_filter(make_docs(rows)).collect()
    expected = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == expected
    assert not any(r.kept for r in found if r.base_failed)


def test_long_texts_take_the_other_path():
    words = [b"%d" % (i % 3001) for i in range(5600)]
    assert quality.repeated_words(words) == quality.repeated_words([b"x" + w for w in words]) == len(brute(" ".join(w.decode() for w in words))) * 0 + brute(" ".join(w.decode() for w in words))[4]


def test_order_is_greedy():
    # rule a rejects nearly all, b all that a leaves, c only what a rejects
    masks = [(0b101, 80), (0b010, 10), (0b000, 10)]
    assert quality.order_rules(masks, [1.0, 1.0, 1.0], ["a", "b", "c"]) == ["a", "b", "c"]
    assert quality.order_rules(masks, [100.0, 1.0, 1.0], ["a", "b", "c"])[0] == "c"


def test_verdict_does_not_depend_on_the_order(make_docs):
    rows = [(1, "WORD! " * 3 + "some plain words that make a fine sentence for all of us here"), (2, "# " * 30 + "alpha beta"), (3, "one two three four five six seven eight nine ten eleven")]
    names = [r.name for r in quality.RULES]
    a, b = ({r.doc_id: r.kept for r in quality.quality_filter(make_docs(rows), order=o).collect()} for o in (names, names[::-1]))
    assert a == b and a[3] and not a[2]


def test_sample_of_files_and_of_anything_else(spark, make_docs, tmp_path):
    make_docs([(i, f"text {i}") for i in range(400)], clash=False).repartition(16).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    some = bounded_sample(columns(docs, "text"), 1000)
    assert 0 < some.count() < 400 and some.columns == ["text"]
    other = docs.selectExpr("upper(text) AS text")
    assert bounded_sample(other, 1000).count() == 400 and bounded_sample(other, 1000).first().text.startswith("TEXT")


def test_empty(make_docs):
    assert quality.quality_filter(make_docs([])).count() == 0


def test_only_texts_that_enter_the_cascade_are_measured(make_docs, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "order_rules", lambda masks, seconds, names: seen.update(n=sum(n for _, n in masks)) or names)
    rows = [(i, "too short") for i in range(5)] + [(9, "one two three four five six seven eight nine ten eleven")]
    quality.plan_cascade(make_docs(rows))
    assert seen["n"] == 1


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("x", "a b"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in quality.quality_filter(docs).collect()} == {"x", None}
