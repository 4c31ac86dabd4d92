"""Operator 2: toxic passages as maximum-scoring segments of token log-odds.

Training, on a bounded sample of labelled rows, one text for each id.  Four
folds of five give counts of the contexts of words in toxic and in clean texts;
log-odds ratios with an informative Dirichlet prior (the background frequency of
the token) are kept, positive or negative, where they are ``MIN_Z`` standard
deviations from zero and, drawn towards zero by ``SHRINK`` of them, still
``MIN_WEIGHT``.  Words come first, then their beginnings, longest first, each
counted over words that nothing longer explains.  A word without an entry takes
that of its longest beginning with one, else the neutral drift, which is negative.

The fifth fold, which these log-odds did not see, calibrates the extreme-value
law of Karlin and Altschul on its clean texts.  The root of
``E exp(lambda s) = 1`` over their word scores counts as one observation of
lambda; with the excess of their best segments over the least positive score it
gives the likeliest lambda and K (texts without a segment are censored there).
A segment's score becomes bits above what a clean text of that length
shows by chance; the sum over significant segments goes through a logistic curve
fitted on the same fold.  The model that was calibrated is the one that scores.

Scoring, over every whole text: one linear scan (Ruzzo and Tompa) finds all
maximal scoring segments.

Defined results: null, empty and word-less texts have no segment and get the
score of any text without one; rows without label, with a null label or with
both labels teach nothing; of several texts with one labelled id the one with
the least hash teaches; without rows of both classes every score is 0; a row
with a null id is never held out; a very long text is scored whole; repeated
rows are scored one by one; empty tables give an empty result; other columns are
never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, cut, id_bucket, map_rows, rows_of, small_batches, table

#: Labelled rows to learn from, of both classes together, and characters of their
#: texts, in expectation.  They bound the model: a token enters it only with
#: several contexts in the sample.
SAMPLE_ROWS = 20_000
SAMPLE_CHARS = 100_000_000
#: Folds of the sample; the first one calibrates.
FOLDS = 5
# Chosen by cross-validation over rows that may be learned from.
MIN_Z = 3.0
MIN_WEIGHT = 1.0
#: Standard deviations by which log-odds are drawn towards zero.
SHRINK = 2.0
#: The prior's weight against the data.
PRIOR_SHARE = 0.1
#: Score of a word of which nothing is known.
DRIFT = -0.3
#: Beginnings of words, in bytes, longest first.
BEGINNINGS = (7, 6, 5, 4)
THRESHOLD = 0.3

_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def tokens_of(word: bytes) -> list[bytes]:
    """The word, marked as whole, then its beginnings, longest first."""
    return [word + b" ", *[word[:k] for k in BEGINNINGS if len(word) >= k]]


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in linear time."""
    found: list[list[float]] = []  # start, end, sum before it, sum through it, nearest earlier one with a lower sum before
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s, -1]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(int(a), int(b), high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    """What scoring needs; a few megabytes at most."""

    weights: dict[bytes, float]
    scale: float = 1.0  # lambda
    k: float = 0.1
    curve: tuple[float, float] = (-50.0, 0.0)

    def word(self, word: bytes) -> float:
        for t in tokens_of(word):
            w = self.weights.get(t)
            if w is not None:
                return w
        return DRIFT

    def bits(self, segment_score: float, n: int) -> float:
        return self.scale * segment_score - math.log(max(1.0, self.k * n))

    def evidence(self, passages: list[tuple[int, int, float]]) -> float:
        return float(sum(b for _, _, b in passages))

    def score(self, passages: list[tuple[int, int, float]]) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * self.evidence(passages)))))


class Scorer(dict):
    """Word scores of a model, remembered up to a bound."""

    MEMO = 100_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.MEMO:
            self.clear()
        self[word] = s = self.model.word(word)
        return s

    def scores(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant segments: first word, word after the last, bits."""
        return self.significant(self.scores(text))

    def significant(self, s: np.ndarray) -> list[tuple[int, int, float]]:
        bits = [(a, b, self.model.bits(score, len(s))) for a, b, score in segments(s)]
        return [x for x in bits if x[2] > 0]


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """``maximal_segments`` of an array of scores, few of which are positive."""
    high = np.flatnonzero(s > 0)
    if not len(high):
        return []
    # what lies between two positive words is one negative step for the scan
    sums = np.concatenate([[0.0], np.cumsum(s)])
    steps, at = [float(s[high[0]])], [int(high[0])]
    for a, b in zip(high[:-1].tolist(), high[1:].tolist(), strict=True):
        if b > a + 1:
            steps.append(float(sums[b] - sums[a + 1]))
            at.append(a + 1)
        steps.append(float(s[b]))
        at.append(b)
    return [(at[a], at[b - 1] + 1, score) for a, b, score in maximal_segments(steps)]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``text, toxic, fold`` of about ``rows`` labelled ids, at most half of
    them of one class if the other has enough.  ``labels``: ``doc_id, toxic``."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = {}
    for kind in (0, 1):
        room = max(rows // 2, rows - sizes.get(1 - kind, 0))
        share[kind] = min(1.0, room / max(1, sizes.get(kind, 0)))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    chosen = known.where(dice < F.when(F.col("toxic") == 1, share[1] * 1_000_000).otherwise(share[0] * 1_000_000))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)).cast("int")
    # some ten thousand pairs of numbers: bounded by `rows`, whatever the tables hold
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    sample = cut(texts.select(F.col("x.text").alias("text"), F.col("toxic").cast("int").alias("toxic"), fold.alias("fold"), F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)).alias("dice")))
    total = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    return (sample if total <= chars else sample.where(F.col("dice") < int(1_000_000 * chars / total))).drop("dice")


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, t, c``: contexts of the word in toxic and in clean texts of
    ``text, toxic``.

    A context is the word before it: copies of one text, however many and
    however slightly edited, repeat the contexts of their words and so count
    about once, while words used in many texts have many contexts.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, bytes], int] = {}

        def flush() -> pa.RecordBatch:
            bits = np.fromiter(seen.values(), np.int64, len(seen))
            cols = [pa.array([w for w, _ in seen], pa.binary()), pa.array([crc32(p) for _, p in seen], pa.int64()), pa.array(bits >> 1), pa.array(bits & 1)]
            seen.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "before", "t", "c"])

        for batch in batches:
            for text, toxic in rows_of(batch):
                words = words_of(text)
                for pair in set(zip(words, [b"", *words], strict=False)):
                    seen[pair] = seen.get(pair, 0) | 1 + toxic
                if len(seen) > 150_000:
                    yield flush()
        if seen:
            yield flush()

    pairs = texts.select("text", "toxic").mapInArrow(run, "word binary, before long, t long, c long").groupBy("word", "before").agg(F.max("t").alias("t"), F.max("c").alias("c"))
    return pairs.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def log_odds(counts: DataFrame, nt: float, nc: float) -> DataFrame:
    """``token, weight, z``: log-odds ratios with the informative prior, of
    ``counts`` that add up to ``nt`` and ``nc``."""
    prior = PRIOR_SHARE * (F.col("t") + F.col("c"))
    mass = PRIOR_SHARE * (nt + nc)
    t, c = F.col("t") + prior, F.col("c") + prior
    weight = F.log(t / (nt + mass - t)) - F.log(c / (nc + mass - c))
    spread = F.sqrt(1 / t + 1 / c)
    shy = weight - F.signum(weight) * SHRINK * spread
    return counts.select("token", shy.alias("weight"), (weight / spread).alias("z")).where((F.abs("z") >= MIN_Z) & (F.col("weight") * F.signum("z") >= MIN_WEIGHT))


def token_weights(words: DataFrame, nt: float, nc: float) -> dict[bytes, float]:
    """Log-odds of words and, over words that have none, of ever shorter beginnings."""
    out: dict[bytes, float] = {}
    left = words
    for size in (None, *BEGINNINGS):
        token = F.concat("word", F.lit(b" ")) if size is None else F.when(F.length("word") >= size, F.substring("word", 1, size))
        named = left.withColumn("token", token)
        counts = named.where("token IS NOT NULL").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        kept = log_odds(counts, nt, nc).select("token", "weight").collect()
        out |= {bytes(r["token"]): r["weight"] for r in kept}
        if kept:
            known = words.sparkSession.createDataFrame([(bytes(r["token"]),) for r in kept], "token binary")
            left = named.join(known, "token", "left_anti").drop("token")
    return out


def _karlin_lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of ``sum p(s) exp(lambda s) = 1``."""
    p = counts / counts.sum()
    if float(p @ values) >= 0 or not (values > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float(p @ np.exp(np.minimum(x * values, 700.0))) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])
    m = np.column_stack([np.ones_like(x), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = m.T @ (m * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, m.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``).

    The driver gets the log-odds of the sample's distinctive tokens, a histogram
    of word scores, and three numbers for each row of a fifth of the sample.
    """
    sample = cut(labelled_sample(docs, labels, rows))
    counts = cut(word_counts(sample.where("fold <> 0")))
    nt, nc = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not (nt and nc):
        return Model({})
    model = Model(token_weights(counts, nt, nc))
    floor = min((w for w in model.weights.values() if w > 0), default=0.0)
    if not floor:
        return Model({})
    held = sample.where("fold = 0").select("text", "toxic")
    shared = sample.sparkSession.sparkContext.broadcast(model.weights)

    def histogram():
        scorer = Scorer(Model(shared.value))

        def count(row):
            values, n = np.unique(np.round(scorer.scores(row[0]), 2), return_counts=True)
            return list(zip(values.tolist(), n.tolist(), strict=True))

        return count

    bins = map_rows(held.where("toxic = 0"), "s double, n long", histogram).groupBy("s").agg(F.sum("n").alias("n")).collect()
    seen = {r["s"]: float(r["n"]) for r in bins}
    for w in model.weights.values():
        if w > 0:  # one more positive score in all: none is impossible
            seen[round(w, 2)] = seen.get(round(w, 2), 0.0) + 1 / len(model.weights)
    root = _karlin_lambda(np.array(list(seen)), np.array(list(seen.values())))

    def best():
        scorer = Scorer(Model(shared.value))

        def measure(row):
            s = scorer.scores(row[0])
            return [(len(s), max((x for _, _, x in segments(s)), default=0.0))]

        return measure

    top = [(r["n"], r["best"]) for r in map_rows(held.where("toxic = 0"), "n long, best double", best).where("n > 0").collect()]
    n, x = np.array(top, float).reshape(-1, 2).T
    # P(best < x) = exp(-K n exp(-lambda x)) from the least positive score on
    excess, there = np.maximum(x - floor, 0.0), 1 + int((x > 0).sum())
    model.scale = min(root, there / (excess.sum() + 1 / root))
    model.k = there / max(1.0, float((n * np.exp(-model.scale * excess)).sum())) * math.exp(model.scale * floor)
    fitted = sample.sparkSession.sparkContext.broadcast(model)

    def evidence():
        scorer = Scorer(fitted.value)
        return lambda row: [(scorer.model.evidence(scorer.passages(row[0])), row[1])]

    points = map_rows(held, "x double, y int", evidence).collect()
    if points:
        # the sample holds more toxic rows than the corpus; its balance is kept: misses cost more than checks
        model.curve = _logistic(np.array([r["x"] for r in points]), np.array([float(r["y"]) for r in points]))
    return model


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, passages`` of every row: one pass, no shuffle.

    ``passages`` lists the significant segments by word number and bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def judge(row):
            found = scorer.passages(row[1])
            score = scorer.model.score(found)
            return [(row[0], score, int(score >= threshold), [{"start": a, "end": b, "bits": s} for a, b, s in found])]

        return judge

    kind = dict(docs.dtypes)[doc_id]
    return map_rows(columns(docs, doc_id, text).toDF("doc_id", "text"), f"doc_id {kind}, score double, predicted int, passages array<struct<start:long,end:long,bits:double>>", make)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` scored below ``threshold``, all columns: one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array([scorer.model.score(scorer.passages(texts[i].as_py())) < threshold for i in range(batch.num_rows)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels whose rows may be learned from."""
    usable = columns(labels, "doc_id", "toxic").where(id_bucket("doc_id", 4) != 2)
    return train(columns(docs, "doc_id", "text"), usable)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, trained(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
