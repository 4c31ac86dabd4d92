"""Operator 1: quality rules as a short-circuit cascade.

Every rule rejects or passes a text.  The verdict is the conjunction of all
rules, so their order never changes it; it only changes the cost.  The order
is chosen from a bounded sample: each rule's time and the set of rules that
reject each sampled text are measured, then rules are picked greedily by the
share of still accepted texts they reject per second.

Defined results: a null or empty text has no words and fails the base rule; a
very long text is judged whole, its windows counted by number in place of by
tuple; ids keep their type, null ids included;
repeated rows are judged one by one; an empty table gives an empty result;
columns other than the id and the text are never read.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded_sample, columns, map_rows, table

SYMBOLS = "#*$%&|<>"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_UPPER = re.compile(r"[A-Z]")
_ALPHA = re.compile(r"[A-Za-z]")
_BULLET = re.compile(r"(?:^|\n)[ \t]*[-*•]")


class Text:
    """A text whose views are computed when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._words: list[bytes] | None = None
        self._lines: list[str] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            # bytes.split() separates at exactly \x20 and \x09-\x0D
            self._words = self.text.encode("utf-8", "surrogatepass").split()
        return self._words

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        if self._lines is None:
            self._lines = [x for x in self.text.split("\n") if x.strip(SPACES)]
        return self._lines

    @property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))


def repeated_words(words: Sequence[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur at least twice."""
    n = len(words)
    if n <= size:
        return 0
    if n <= 5000:
        windows = list(zip(*[words[i:] for i in range(size)], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        again = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    else:
        codes: dict[bytes, int] = {}
        base = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
        ids = base
        for k in range(1, size):  # exact: the ids are dense again after each step
            pair = ids[: n - k] * np.int64(len(codes)) + base[k:]
            _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        again = counts[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Integer arithmetic only, so that the same verdicts can be had from SQL.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words),
    Rule("symbols_per_word", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("exclamations_per_word", lambda t: 5 * t.text.count("!") > 2 * t.n_words),
    Rule("ellipses_per_line", lambda t: 10 * t.text.count("...") > 3 * max(1, len(t.lines)) + 10),
    Rule("upper_case", lambda t: 2 * len(_UPPER.findall(t.text)) > len(_ALPHA.findall(t.text))),
    Rule("words_without_letters", lambda t: 10 * sum(1 for w in t.words if _LETTER.search(w)) < 6 * t.n_words),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("bullet_lines", lambda t: 10 * len(_BULLET.findall(t.text)) > 9 * max(1, len(t.lines))),
)


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 4000) -> list[str]:
    """Names of ``rules``, best first, from about ``sample_rows`` rows, of which
    those count that pass the base rule.

    The driver gets one row per set of rules that rejected some sampled text:
    never more than there are sampled rows, and no texts.
    """
    rules = tuple(rules)

    def make():
        def measure(row):
            t, mask, cost = Text(row[0]), 0, []
            if base_failed(t.n_words, repeated_words(t.words)):
                return []  # never enters the cascade
            _ = t.lines  # shared by all rules, paid whatever the order
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                mask |= rule.rejects(t) << k
                cost.append(time.perf_counter() - began)
            return [(mask, *cost)]

        return measure

    fields = ", ".join(f"c{k} double" for k in range(len(rules)))
    measured = map_rows(bounded_sample(columns(docs, text), sample_rows), f"mask long, {fields}", make)
    seen = measured.groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(rules))]).collect()
    return order_rules([(r["mask"], r["n"]) for r in seen], [sum(r[f"c{k}"] for r in seen) for k in range(len(rules))], [r.name for r in rules])


def order_rules(masks: Sequence[tuple[int, int]], seconds: Sequence[float], names: Sequence[str]) -> list[str]:
    """Greedy order: most newly rejected texts per second first."""
    left, order = list(range(len(names))), []
    alive = list(masks)
    while left:
        gain = {k: sum(n for m, n in alive if m >> k & 1) / max(seconds[k], 1e-9) for k in left}
        best = max(left, key=lambda k: (gain[k], -seconds[k], -k))
        order.append(names[best])
        left.remove(best)
        alive = [(m, n) for m, n in alive if not m >> best & 1]
    return order


def quality_filter(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    doc_id: str = "doc_id",
    text: str = "text",
    order: Sequence[str] | None = None,
    sample_rows: int = 4000,
) -> DataFrame:
    """Base counts of every text and the verdict of the cascade.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept``.  A text that fails the base rule never
    enters the cascade; the others leave it at the first rule that rejects
    them.  One pass over the texts, no shuffle.
    """
    order = list(order or plan_cascade(docs, rules, text, sample_rows))
    by_name = {r.name: r for r in rules}
    ordered = tuple(by_name[n] for n in order)

    def make():
        def judge(row):
            t = Text(row[1])
            n, again = t.n_words, repeated_words(t.words)
            failed = base_failed(n, again)
            kept = not failed and not any(rule.rejects(t) for rule in ordered)
            return [(row[0], n, t.word_chars, t.n_symbols, t.n_dup_lines, again, failed, kept)]

        return judge

    return map_rows(
        columns(docs, doc_id, text).toDF("doc_id", "text"),
        f"doc_id {dict(docs.dtypes)[doc_id]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
        make,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), ln AS (
  SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM l GROUP BY r
), p AS (
  SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n FROM p
), c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat FROM g, range(0, 5) t(k) WHERE n > 1 GROUP BY r
), f AS (
  SELECT doc_id, text, w, len(w) AS n, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup, coalesce(n_repeat, 0) AS n_repeat,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS syms
  FROM d LEFT JOIN ln USING (r) LEFT JOIN c USING (r)
), v AS (
  SELECT *, n < 10 OR 100 * n_repeat > 20 * n AS failed FROM f
)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, syms::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines,
       n_repeat::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT failed
       AND chars BETWEEN 2 * n AND 12 * n
       AND 10 * syms <= n
       AND 5 * length(regexp_replace(text, '[^!]', '', 'g')) <= 2 * n
       AND 10 * len(regexp_extract_all(text, '\.\.\.')) <= 3 * greatest(1, n_lines) + 10
       AND 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) <= length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
       AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) >= 6 * n
       AND 2 * n_dup <= n_lines
       AND 10 * len(regexp_extract_all(text, '(?:^|\n)[ \t]*[-*\x{2022}]')) <= 9 * greatest(1, n_lines) AS kept
FROM v
"""
