"""Operator 5: benchmark decontamination with an FM-index per training shard.

A shard is a stretch of consecutive documents of one task, about
``SHARD_WORDS`` words.  Words that occur in no benchmark item can't be part of
a match, so they become separators, and stretches between separators that are
shorter than the shortest phrase are left out; what remains is indexed.  All
phrases (windows of 10 words, or a whole item that is shorter) are searched
backwards at once, occurrences are located from sampled suffix positions and
merged to spans of words for each document.

The benchmark travels to the executors in blocks of at most
``BLOCK_ITEMS_WORDS`` words, a fixed bound.  One block is searched while its
shard's index is in memory.  For more, shards are indexed once, over all words
that any block may hold (a bit map of fixed size knows them), and written as a
table; each block in turn searches that table.  Texts are read once.

Defined results: null, empty or word-less texts and items have no words and
match nothing; a very long text is a shard of its own; items of one id are one
item, also where they lie in several blocks, and so are all items without an id,
which the digest leaves out; repeated rows are judged one by one; empty tables
give no hits or no rows; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import columns, scratch_path, small_batches, table
from .fmindex import FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_ITEMS_WORDS = 500_000
#: Bits of the map of words in a benchmark of several blocks.
KNOWN_BITS = 27

#: A-Z to a-z; every other ASCII character that isn't a letter or digit to a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: Bytes of text that become word objects at a time.
_CHUNK = 1 << 22


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases(NamedTuple):
    """Distinct windows of benchmark items."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]  # item numbers of each window
    names: list[str | None]

    @classmethod
    def build(cls, items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                own = found.setdefault(tuple(ids[i : i + size]), [])
                if not own or own[-1] != k:
                    own.append(k)
        table = np.zeros((len(found), window), np.int64)
        for row, key in enumerate(found):
            table[row, : len(key)] = key
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return cls(vocabulary, table, lengths, list(found.values()), [None if i is None else str(i) for i, _ in items])

    @property
    def sigma(self) -> int:
        return len(self.vocabulary) + 1


def word_ids(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Number of each word in ``vocabulary``, 0 if it isn't there."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    parts, at = [], 0
    while at < len(folded):
        to = len(folded) if len(folded) - at <= _CHUNK else folded.rfind(b" ", at, at + _CHUNK) + 1 or len(folded)
        words = folded[at:to].split()
        parts.append(np.fromiter((vocabulary.get(w, 0) for w in words), np.int32, len(words)))
        at = to
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _candidates(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words of at least ``shortest``, each with a separator
    after it, and the position in ``ids`` of each symbol kept."""
    known = np.concatenate([[False], ids != 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= shortest
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    sizes = ends - starts + 1
    at = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    seq = np.append(ids, np.int32(0))[at]
    seq[np.cumsum(sizes) - 1] = 0
    return seq, at


class Shard(NamedTuple):
    """The index of a shard, and the document and the word that each of its symbols is."""

    index: FMIndex
    doc: np.ndarray
    at: np.ndarray

    @classmethod
    def build(cls, docs: list[np.ndarray], sigma: int, shortest: int) -> Shard | None:
        parts = [_candidates(ids, shortest) for ids in docs]
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(s) for s, _ in parts])
        if not len(doc):
            return None
        return cls(FMIndex(np.concatenate([s for s, _ in parts]), sigma), doc, np.concatenate([a for _, a in parts]))

    def occurrences(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document number, first word and row of ``windows`` of every occurrence."""
        low, high = self.index.search(windows, lengths)
        n = np.maximum(high - low, 0)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        where = self.index.locate(rows)
        return self.doc[where], self.at[where], np.repeat(np.arange(len(n)), n)


def find_occurrences(docs: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first word and phrase number of every occurrence in a shard."""
    none = np.empty(0, np.int64)
    if not len(phrases.lengths):
        return none, none, none
    shard = Shard.build(docs, phrases.sigma, int(phrases.lengths.min()))
    return (none, none, none) if shard is None else shard.occurrences(phrases.windows, phrases.lengths)


def spans(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Union of ``[start, start + length)`` as disjoint spans in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)].tolist(), strict=True))


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for row in columns(benchmark, item_id, text).toLocalIterator():
        n = len(row[1] or "") // 2 + 1  # no text has more words
        if block and size + n > BLOCK_ITEMS_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS = "spans array<struct<start:long,end:long>>, items array<string>, unnamed boolean"


def _found(n_docs: int, occurrences: tuple[np.ndarray, np.ndarray, np.ndarray], p: Phrases) -> list[pa.Array]:
    """Merged spans, names of items, and whether one has no name, of each document."""
    doc, start, phrase = occurrences
    order = np.argsort(doc, kind="stable")
    doc, start, phrase = doc[order], start[order], phrase[order]
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    merged, named, unnamed = [], [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        merged.append([{"start": s, "end": e} for s, e in spans(start[a:b], p.lengths[phrase[a:b]])])
        own = {p.names[i] for x in set(phrase[a:b].tolist()) for i in p.items[x]}
        named.append(sorted(x for x in own if x is not None))
        unnamed.append(None in own)
    return [pa.array(merged, _SPAN), pa.array(named, pa.list_(pa.string())), pa.array(unnamed, pa.bool_())]


def _shards(batches: Iterator[pa.RecordBatch], ids_of) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and words of the documents of each shard; batches are ids and texts."""
    keys, docs, size = [], [], 0
    for batch in batches:
        texts, began = batch.column(1), 0
        for i in range(batch.num_rows):
            docs.append(ids_of(texts[i].as_py()))
            size += len(docs[-1])
            if size >= SHARD_WORDS:
                yield pa.concat_arrays([*keys, batch.column(0).slice(began, i + 1 - began)]), docs
                keys, docs, size, began = [], [], 0, i + 1
        if began < batch.num_rows:
            keys.append(batch.column(0).slice(began))
    if docs:
        yield pa.concat_arrays(keys), docs


def removal_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, spans, items, n_items`` of every row of ``docs``:
    merged spans of words to remove, names of the items found, how many."""
    small_batches(docs.sparkSession)
    rows = columns(docs, doc_id, text).toDF("doc_id", "text")
    blocks = _blocks(benchmark, item_id, item_text)
    first = next(blocks)
    found = _search(rows, Phrases.build(first, window)) if next(blocks, None) is None else _search_blocks(rows, benchmark, item_id, item_text, window)
    return found.select("doc_id", "n_words", "spans", "items", (F.size("items").cast("long") + F.col("unnamed").cast("long")).alias("n_items"))


def _search(rows: DataFrame, phrases: Phrases) -> DataFrame:
    """``doc_id, n_words`` and ``_SPANS`` of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for keys, docs in _shards(batches, lambda t: word_ids(t, p.vocabulary)):
            cols = [keys, pa.array([len(d) for d in docs], pa.int64()), *_found(len(docs), find_occurrences(docs, p), p)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "spans", "items", "unnamed"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, {_SPANS}")


class Known:
    """Words that a benchmark may hold, by a map of hashes, and the shortest of its phrases."""

    def __init__(self, blocks: Iterator[list], window: int):
        self.bits, self.shortest = np.zeros(1 << KNOWN_BITS - 3, np.uint8), window
        for block in blocks:
            for _, text in block:
                words = words_of(text)
                if words:
                    self.shortest = min(self.shortest, len(words))
                    at = self._hashes(words)
                    np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.int64) & ((1 << KNOWN_BITS) - 1)

    def numbers(self, text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
        """Each word's number in ``vocabulary``, which grows, or 0 for a word that isn't known."""
        folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
        parts, at = [], 0
        while at < len(folded):
            to = len(folded) if len(folded) - at <= _CHUNK else folded.rfind(b" ", at, at + _CHUNK) + 1 or len(folded)
            words = folded[at:to].split()
            h = self._hashes(words)
            ids = np.zeros(len(words), np.int32)
            for k in np.flatnonzero(self.bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).tolist():
                ids[k] = vocabulary.setdefault(words[k], len(vocabulary) + 1)
            parts.append(ids)
            at = to
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _index(rows: DataFrame, known: Known, path: str) -> DataFrame:
    """Index all shards and write them: ``part, shard, doc_ids, n_words, data``."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kind = dict(rows.dtypes)["doc_id"]
    arrow = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = {}
        for number, (keys, docs) in enumerate(_shards(batches, lambda t: shared.value.numbers(t, vocabulary))):
            shard = Shard.build(docs, len(vocabulary) + 1, shared.value.shortest)
            data = pickle.dumps((shard, list(vocabulary)))
            vocabulary.clear()
            row = (TaskContext.get().partitionId(), number, keys.to_pylist(), [len(d) for d in docs], data)
            kinds = (pa.int32(), pa.int32(), pa.list_(arrow), pa.list_(pa.int64()), pa.large_binary() if len(data) > 1 << 30 else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "shard", "doc_ids", "n_words", "data"])

    schema = f"part int, shard int, doc_ids array<{kind}>, n_words array<long>, data binary"
    rows.mapInArrow(run, schema).write.option("parquet.enable.dictionary", "false").option("parquet.block.size", str(16 << 20)).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _search_blocks(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """``_search`` for a benchmark of several blocks: one index, a pass over it for each."""
    spark = rows.sparkSession
    path = scratch_path(spark, "shards")
    shards = _index(rows, Known(_blocks(benchmark, item_id, item_text), window), f"{path}/index")
    key = ["part", "shard", "n"]
    for number, block in enumerate(_blocks(benchmark, item_id, item_text)):
        shared = spark.sparkContext.broadcast(Phrases.build(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    shard, words = pickle.loads(batch.column(2)[i].as_py())
                    if shard is None or not len(p.lengths):
                        continue
                    here = {w: k + 1 for k, w in enumerate(words)}
                    number_of = np.array([0, *[here.get(w, -1) for w in p.vocabulary]])
                    windows = number_of[p.windows]
                    there = np.flatnonzero((windows >= 0).all(axis=1))
                    doc, start, phrase = shard.occurrences(windows[there], p.lengths[there])
                    hit, doc = np.unique(doc, return_inverse=True)
                    cols = [pa.array(np.full(len(hit), batch.column(k)[i].as_py(), np.int32)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(hit, pa.int32()), *_found(len(hit), (doc, start, there[phrase]), p)], [*key, "spans", "items", "unnamed"])

        found = shards.select("part", "shard", "data").mapInArrow(run, f"part int, shard int, n int, {_SPANS}")
        found.write.parquet(f"{path}/hits/block={number}")
        shared.destroy()
    hits = spark.read.schema(f"part int, shard int, n int, {_SPANS}").parquet(f"{path}/hits")
    one = hits.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("unnamed").alias("unnamed"))
    joined = F.expr("""aggregate(all, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
        case when size(a) > 0 and element_at(a, -1).end >= x.start
        then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
        else concat(a, array(x)) end)""")
    every = shards.select("part", "shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("n", "d")).select(*key, "d.doc_ids", "d.n_words")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    merged = every.join(one.select(*key, joined.alias("spans"), "items", "unnamed"), key, "left")
    return merged.select(F.col("doc_ids").alias("doc_id"), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("unnamed", F.lit(False)).alias("unnamed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without any phrase of the benchmark, all columns.  One
    pass and no shuffle, a batch being a shard, if the benchmark is one block;
    else rows meet the digests of the contaminated texts."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text)
    blocks = _blocks(benchmark, item_id, item_text)
    first = next(blocks)
    if next(blocks, None) is not None:
        digest = F.md5(F.col(f"`{text}`").cast("binary"))
        found = _search_blocks(docs.select(digest.alias("doc_id"), F.col(f"`{text}`").alias("text")), benchmark, item_id, item_text, window)
        bad = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_key_text")).distinct()
        return docs.join(bad, digest == F.col("_key_text"), "left_anti")
    phrases = spark.sparkContext.broadcast(Phrases.build(first, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found, _, _ = find_occurrences([word_ids(texts[i].as_py(), phrases.value.vocabulary) for i in range(batch.num_rows)], phrases.value)
            keep = np.ones(batch.num_rows, bool)
            keep[found] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def contamination(found: DataFrame) -> DataFrame:
    """The digest of ``removal_spans`` of each document."""
    hits = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    return found.select("doc_id", "n_words", hits.alias("n_hit"), "n_items", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), sizes AS (
  SELECT DISTINCT n FROM b
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT r, n, i, item_id FROM dw JOIN bw USING (n, p)
), s AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM h, range(0, 10) t(k) WHERE k < n GROUP BY r
), m AS (
  SELECT r, count(DISTINCT item_id) + bool_or(item_id IS NULL)::INT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN s USING (r) LEFT JOIN m USING (r)
"""
