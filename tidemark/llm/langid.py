"""Operator 7: language of texts, and spans of languages inside a text.

Each word's script narrows its candidate languages; hashed character trigrams
and bigrams score the word for each candidate; Viterbi with a penalty for each
switch labels all words of a text.  A text's language is the one with most
letters.  All steps are vectorised: character tables and sums over a whole
block of texts, and the Viterbi recursion over all texts of the block at once.

Training uses a bounded number of rows for each language; scores, spans and
predictions cover every word of every text.

Defined results: a null text, or one without any letter, is ``und`` with score
0; so is everything if there is nothing to learn from; ties go to the language
first in code point order; languages beyond ``MAX_LANGS``, by labelled rows, are
not learned; a row with a null id is never held out; a very long text is
labelled whole, in blocks of characters and one Viterbi; repeated rows are judged
one by one; empty tables give an empty result; other columns are never read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, id_bucket, rows_of, small_batches, table

UNKNOWN = "und"
#: Rows to learn from for each language, in expectation.
TRAIN_ROWS = 3000
#: Languages to learn: those with most labelled rows.  A language is half a
#: megabyte of the model.
MAX_LANGS = 256
#: Log-odds a switch between two neighbouring words must earn.
SWITCH_PENALTY = 12.0
#: A language's candidates are the scripts of at least this share of its letters.
SCRIPT_SHARE = 0.01
BUCKET_BITS = 16
#: Words, and characters, that are worked on at a time.
BLOCK_WORDS = 1 << 20
BLOCK_CHARS = 1 << 19

#: Scripts by ranges of code points, from the Unicode blocks.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x20000, 0x3134F),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to a word, and its script."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        letter[c] = unicodedata.category(chr(c))[0] in "LM"
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return letter, script


class Words(NamedTuple):
    """Words of a few texts: per letter its two buckets, per word its first
    letter, its text, its script."""

    grams: np.ndarray
    pairs: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def find_words(texts: list[str]) -> Words:
    letter, script = character_tables()
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered])
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letter[codes]
    plain = np.where(inside, codes, np.uint32(32))
    at = np.flatnonzero(inside)
    before, here, after = plain[at - 1], plain[at], plain[at + 1]
    mix = lambda x: (x * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)  # noqa: E731  Knuth's multiplicative hash
    grams = mix((before * np.uint32(31) + here) * np.uint32(1009) + after)
    pairs = mix(before * np.uint32(8191) + here + np.uint32(77))
    starts = np.flatnonzero(~inside[at - 1])
    first = at[starts]
    text = np.searchsorted(np.cumsum(sizes), first, side="right") if len(texts) > 1 else np.zeros(len(first), np.int64)
    text = np.minimum(text, len(texts) - 1)
    return Words(grams, pairs, starts, text, script[codes[first]], np.diff(np.append(starts, len(at))))


class Model(NamedTuple):
    langs: list[str]
    grams: np.ndarray  # language, bucket
    pairs: np.ndarray
    allowed: np.ndarray  # script, language

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of words for each language, the best one 0."""
        out = np.empty((len(w.starts), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.grams[k][w.grams] + self.pairs[k][w.pairs], w.starts)
        out[~self.allowed[w.script]] -= 1e4
        return out - out.max(axis=1, keepdims=True)


def viterbi(emissions: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of each word; texts lie one after another, ``sizes`` words each.

    All texts advance together, longest first, so a step is one array operation.
    """
    n_lang = emissions.shape[1]
    kind = np.min_scalar_type(max(0, n_lang - 1))
    order = np.argsort(-sizes, kind="stable")
    offsets = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    came = np.empty(emissions.shape, kind)
    label = np.empty(len(emissions), kind)
    own = np.arange(n_lang, dtype=kind)
    state = np.zeros((len(order), n_lang), np.float32)
    for t, n in enumerate(active.tolist()):
        s = state[:n]
        best = s.max(axis=1)
        switch = best - np.float32(penalty)
        at = offsets[:n] + t
        came[at] = np.where(s >= switch[:, None], own, s.argmax(axis=1).astype(kind)[:, None])
        np.maximum(s, switch[:, None], out=s)
        s -= best[:, None]
        s += emissions[at]
    last = state.argmax(axis=1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        label[at] = last[:n]
        last[:n] = came[at, last[:n]]
    return label


class Guess(NamedTuple):
    lang: str
    score: float
    spans: list[tuple[int, int, str]]


def identify(texts: list[str | None], model: Model, with_spans: bool = True) -> list[Guess]:
    """Language, its share of letters, and spans of words, of each text."""
    unknown = Guess(UNKNOWN, 0.0, [])
    if not model.langs:
        return [unknown] * len(texts)
    emissions, letters, sizes = [], [], np.zeros(len(texts), np.int64)
    has_letter = np.zeros(len(texts), bool)
    group: list[int] = []
    chars = 0

    def close() -> None:
        w = find_words([texts[i] or "" for i in group])
        if len(w.starts):
            emissions.append(model.emissions(w))
            letters.append(w.letters)
            sizes[group] = np.bincount(w.text, minlength=len(group))

    for i, text in enumerate(texts):
        group.append(i)
        chars += len(text or "")
        has_letter[i] = bool(text) and any(map(str.isalpha, text))
        if chars > BLOCK_CHARS:
            close()
            group, chars = [], 0
    if group:
        close()
    if not emissions:
        return [unknown] * len(texts)
    label = viterbi(np.concatenate(emissions), sizes)
    weight = np.concatenate(letters)
    n = len(model.langs)
    share = np.bincount(np.repeat(np.arange(len(texts)), sizes) * n + label.astype(np.int64), weights=weight, minlength=len(texts) * n).reshape(-1, n)
    best, total = share.argmax(axis=1), share.sum(axis=1)
    ends = np.cumsum(sizes)
    out = []
    for i in range(len(texts)):
        if not has_letter[i] or not sizes[i]:
            out.append(unknown)
            continue
        spans = []
        if with_spans:
            own = label[ends[i] - sizes[i] : ends[i]]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            spans = [(a, b, model.langs[own[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        out.append(Guess(model.langs[best[i]], float(share[i, best[i]] / total[i]), spans))
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (``doc_id, text, lang``), at most about ``rows``
    rows a language, of ``MAX_LANGS`` languages.  The driver gets the counts of
    each language's buckets, ``2 << BUCKET_BITS`` at most, and of its scripts."""
    small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    often = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGS)
    sizes = {r["lang"]: r["count"] for r in often.collect()}
    if not sizes:
        return Model([], np.empty((0, 0)), np.empty((0, 0)), np.empty((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, rows / v))])
    dice = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1_000_000)) / 1_000_000
    sample = known.where(F.coalesce(dice, F.lit(0.0)) < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("text", "lang")
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        held: dict[str, list[str]] = {}

        def add(lang: str) -> None:
            w = find_words(held.pop(lang))
            own = seen.setdefault(lang, np.zeros(2 * size + len(SCRIPT_NAMES), np.int64))
            own[:size] += np.bincount(w.grams, minlength=size)
            own[size : 2 * size] += np.bincount(w.pairs, minlength=size)
            own[2 * size :] += np.bincount(w.script, w.letters, len(SCRIPT_NAMES)).astype(np.int64)

        for batch in batches:
            for text, lang in rows_of(batch):
                held.setdefault(lang, []).append(text)
                if sum(map(len, held[lang])) > BLOCK_CHARS:
                    add(lang)
        for lang in list(held):
            add(lang)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    table_ = np.zeros((len(langs), 2 * size + len(SCRIPT_NAMES)))
    row = np.searchsorted(np.array(langs), np.array(counted.column("lang").to_pylist())) if langs else []
    table_[row, counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()

    def logs(part: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (part.sum(axis=1, keepdims=True) + 0.5 * size)).astype(np.float32)

    scripts = table_[:, 2 * size :]
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    allowed[~allowed.any(axis=1)] = True  # a script that nobody was seen to use narrows nothing
    return Model(langs, logs(table_[:, :size]), logs(table_[:, size : 2 * size]), allowed)


def identify_languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row: one pass, no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[doc_id]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            found = identify(texts, shared.value, with_spans)
            spans = [[{"start": a, "end": b, "lang": k} for a, b, k in g.spans] for g in found]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array([g.lang for g in found]), pa.array([g.score for g in found]), pa.array(spans, span)], ["doc_id", "lang_pred", "score", "spans"])

        for batch in batches:
            own = batch.column(1).to_pylist()
            keys.append(batch.column(0))
            texts += own
            size += sum(len(t or "") for t in own) // 5  # about as many words
            if size >= BLOCK_WORDS:
                yield close()
                keys, texts, size = [], [], 0
        if texts:
            yield close()

    return columns(docs, doc_id, text).toDF("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(columns(docs, "doc_id", "text", "lang").where(id_bucket("doc_id", 5) != 0))
    found = identify_languages(docs, model)
    return found.select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
