"""Operator 10: near duplicates by SimHash, found exactly with vantage-point
trees.

Fingerprints link at ``RADIUS`` (3) or fewer differing bits of 64.  Two such
fingerprints differ in at most one bit of their upper or of their lower 32
bits, so there are two trees, one over each half, searched with radius 1; a
link is accepted by the distance over all 64 bits.  Searching halves prunes
far more: a ball of radius 1 rarely touches both sides of a split.

A split sends a fingerprint to the inner side if its half is within ``mu`` of
the vantage point.  By the triangle inequality, partners of an outer
fingerprint can be inside only if its distance is at most ``mu`` + 1; such
boundary fingerprints also visit the inner side as guests, and guests visit
every side that their ball overlaps.  So each linked pair meets in at least
one leaf, and a leaf is searched by one task.

Only distinct fingerprints enter the search, leaves emit a spanning star of
each of their components in place of all pairs, and components are joined up
by large-star and small-star rounds over the edges.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other; fewer than three words are one shingle; a very
long text is fingerprinted whole, in blocks of shingles; a null
id takes part but can't name a component unless all of its ids are null;
repeated rows share a component; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import columns, cut, small_batches, table

RADIUS = 3
#: Differing bits in one of the two halves of a linked pair.
HALF_RADIUS = RADIUS // 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a leaf aimed at, and those that the driver builds trees from.
LEAF = 1024
TREE_SAMPLE = 100_000
#: Leaves of work that a group may be to be searched pair by pair.
BLOCKED = 4
#: Levels of the trees that are broadcast: 65,535 nodes of six bytes each, at
#: most.  Larger leaves are split further by the task that searches them.
MAX_DEPTH = 16
#: A split that leaves more than this share of the pairs isn't made.
USELESS = 0.9


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text over its word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only
    if not words:
        return 0
    flat = b" ".join(words)
    size = min(SHINGLE, len(words))
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        to = min(n, at + 8192)
        hashes = np.array([xxh64_intdigest(flat[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + size - 1 : to + size - 1], strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte and are vectorised
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """``rows``, whose last column is ``text``, with ``fp``, the fingerprint's
    bits as a signed long, in its place."""
    small_batches(rows.sparkSession)
    schema = StructType([*rows.schema.fields[:-1], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.columns[-1]
            fps = np.array([fingerprint(texts[i].as_py()) for i in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], schema.names)

    return rows.mapInArrow(run, schema)


class VantageTree:
    """A full binary tree over 32-bit halves, nodes in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        n = (1 << depth) - 1
        self.depth = depth
        # where the sample has run out: any point, and the median of Binomial(32, 1/2)
        self.vantage = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        self.mu = np.full(n, 15, np.int16)
        groups = {0: np.asarray(sample, np.uint32)}
        for node in range(n):
            own = groups.pop(node, None)
            if own is None or len(own) < 16:
                continue
            best = None
            for vp in rng.choice(own, 4):
                d = np.bitwise_count(own ^ vp).astype(np.int16)
                mu = int(np.median(d))
                for m in (mu - 1, mu):
                    inner, band = np.count_nonzero(d <= m), np.count_nonzero((d > m) & (d <= m + HALF_RADIUS))
                    cost = (inner + band) ** 2 + (len(own) - inner) ** 2
                    if best is None or cost < best[0]:
                        best = cost, vp, m, d
            cost, self.vantage[node], self.mu[node], d = best
            if cost > USELESS * len(own) ** 2:
                # a dense group: whatever the split, most of it would visit both sides
                self.mu[node] = 40
                groups[2 * node + 1] = own
                continue
            inside = d <= self.mu[node]
            groups[2 * node + 1], groups[2 * node + 2] = own[inside], own[~inside]

    def route(self, halves: np.ndarray, radius: int = HALF_RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the leaves that each row visits, its home included."""
        row = np.arange(len(halves))
        node = np.zeros(len(halves), np.int64)
        home = np.ones(len(halves), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(halves[row] ^ self.vantage[node]).astype(np.int16)
            mu = self.mu[node]
            into = np.where(home, d <= mu, d <= mu + radius)
            out = np.where(home, d > mu, d > mu - radius)
            guest = home & out & (d <= mu + radius)
            row, node, home = (
                np.concatenate([row[into], row[guest], row[out]]),
                np.concatenate([2 * node[into] + 1, 2 * node[guest] + 1, 2 * node[out] + 2]),
                np.concatenate([home[into], np.zeros(np.count_nonzero(guest), bool), home[out]]),
            )
        return row, node - ((1 << self.depth) - 1)


def leaf_stars(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges from members to a representative of each component of two or more.

    Grows one component at a time and takes what it reaches out of the rest,
    so a dense group costs its size times what is left, not its square.
    """
    rest = np.unique(fps)
    members, reps = [], []
    while len(rest):
        seed, rest = rest[0], rest[1:]
        queue = [seed]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found = rest[near]
                members.append(found)
                reps.append(np.full(len(found), seed))
                queue += list(found)
                rest = rest[~near]
    none = np.empty(0, fps.dtype)
    return np.concatenate([none, *members]), np.concatenate([none, *reps])


def tree_stars(fps: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """``leaf_stars`` of a leaf of any size, which is split further over the
    same half (``shift``: its first bit) if it is large."""
    fps = np.unique(fps)
    if len(fps) <= BLOCKED * LEAF:
        return leaf_stars(fps)
    halves = (fps >> np.uint64(shift)).astype(np.uint32)
    depth = math.ceil(math.log2(len(fps) / LEAF))
    sample = np.random.default_rng(shift).choice(halves, min(len(halves), 32 << depth), replace=False)
    row, leaf = VantageTree(sample, depth, len(fps)).route(halves)
    order = np.argsort(leaf, kind="stable")
    row, leaf = row[order], leaf[order]
    found = [dense_stars(fps[part], np.arange(64)) for part in np.split(row, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1)]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def dense_stars(fps: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``leaf_stars`` of a group that no vantage point divides; ``bits`` are
    those in which its members may differ.

    Cut into ``RADIUS + 1`` stretches, one at least is equal in a linked pair, so
    links lie among members equal in a stretch, which may differ in the others
    only.  So many bits as are left bound the distinct members of a group."""
    if len(fps) <= BLOCKED * LEAF:
        return leaf_stars(fps)
    found = []
    for stretch in np.array_split(bits, RADIUS + 1):
        mask = np.bitwise_or.reduce(np.uint64(1) << stretch.astype(np.uint64))
        part = fps & mask
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        rest = np.setdiff1d(bits, stretch)
        found += [dense_stars(fps[own], rest) for own in np.split(order, cuts) if len(own) > 1]
    none = np.empty(0, fps.dtype)
    return np.concatenate([none, *[a for a, _ in found]]), np.concatenate([none, *[b for _, b in found]])


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges ``a, b`` that connect exactly the fingerprints linked, directly or
    through others, at ``RADIUS`` or fewer bits.  ``distinct``: one row each."""
    spark = distinct.sparkSession
    n = distinct.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / LEAF))))
    part = distinct if n <= TREE_SAMPLE else distinct.sample(TREE_SAMPLE / n, seed=5)
    sample = np.array([r[0] for r in part.select(fp).limit(2 * TREE_SAMPLE).collect()], np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([VantageTree((sample >> np.uint64(s)).astype(np.uint32), depth, s) for s in (0, 32)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k, tree in enumerate(trees.value):
                row, leaf = tree.route((fps.view(np.uint64) >> np.uint64(32 * k)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(2 * leaf + k), pa.array(fps[row])], ["leaf", "fp"])

    def search(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        shift = 32 * (group.column("leaf")[0].as_py() & 1)
        a, b = tree_stars(fps.view(np.uint64), shift)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    visits = distinct.select(fp).mapInArrow(route, "leaf long, fp long")
    return visits.groupBy("leaf").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the undirected edges ``a, b``; the root
    is the least node of its component.  Nodes without edges are left out."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
    before = mark(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = cut(small.union(own.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()


def rooted(signed: DataFrame) -> DataFrame:
    """``fp, least, root`` of each distinct fingerprint of ``doc_id, fp``: its
    least id, and the fingerprint that stands for its component."""
    groups = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups))
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``;
    ``component_id`` is the least id reachable over links."""
    signed = cut(fingerprints(columns(docs, doc_id, text).toDF("doc_id", "text")))
    named = rooted(signed)
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(by_root, "root").select("fp", "component_id")
    return signed.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns: the one with the least id (and
    hash of the text, where ids repeat); repeated rows count as one.  The texts
    are shuffled once, to meet the keys of the rows that stay."""
    keyed = docs.withColumns({"_key_id": F.col(f"`{doc_id}`"), "_key_text": F.xxhash64(F.col(f"`{text}`"))})
    signed = cut(fingerprints(keyed.select(F.col("_key_id").alias("doc_id"), "_key_text", F.col(f"`{text}`").alias("text"))))
    rows = signed.groupBy("fp", "doc_id", "_key_text").agg(F.count("*").alias("n"))
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key_text", "n")).alias("best"))
    kept = cut(best.join(rooted(signed).select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("kept_id"), F.col("best._key_text").alias("kept_text"), F.col("best.n").alias("kept_n")))
    same = F.col("_key_id").eqNullSafe(F.col("kept_id")) & (F.col("_key_text") == F.col("kept_text"))
    found = keyed.join(kept, same)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if kept.where("kept_n > 1").isEmpty():
        return found.select(*names)
    # rows equal in id and text: the one whose other columns have the least hash
    alike = found.where("kept_n > 1").groupBy("_key_id", "_key_text").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_row"))
    again = alike.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return found.where("kept_n = 1").select(*names).unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
