"""Operator 4: mixing sources to target weights, with DataFrame functions only.

1. Targets.  Sources in code point order, null last, weigh 1, 2, 3, repeating.
   Together they share all words; no target exceeds ``max_repeats`` times its
   source's words and the excess is shared again by weight.  The fixed point is
   one level of water: targets are ``least(cap, level * weight)``.
2. Blocks.  A source's documents, in an order shuffled by a hash of their ids,
   form one stream of words, cut into blocks of ``block_words``.
3. Schedule.  Slot ``i`` takes the point ``frac(i * golden ratio)``, in exact
   31-bit arithmetic; mapped through the cumulative weights of the targets it
   names a source.  A slot's rank among the slots of its source names the block
   it plays.  Such points spread each source evenly over any stretch of slots.
4. A source leaves the schedule when its target is met, to the word: its last
   block is cut, and what the schedule still owes it is appended.

Positions in a source, ranks of slots and totals over sources are prefix sums in
two levels: over hash buckets, stretches of slots or ranges of sources, and
inside one.  So neither a source that holds a third of all rows nor very many
sources are one task's work.  Rows equal in id, text and source count as one
with a number, for each input partition, until they are dealt their places.

Defined results: null and empty texts have size 0 and are never taken; a null
source is one source, the last; repeated rows are separate rows, each with its
own position; a null id is an id like others; rows of one id are ordered by
their texts' digests, so reruns agree whatever the order of the input; a very
long text spans as many blocks as it needs; without any words all targets are 0;
an empty table gives an empty result; columns other than the three named are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, cut, table

#: 2**31 divided by the golden ratio, made odd: a full-period step.
GOLDEN_STEP = 1327217885
GRID = 1 << 31
#: Stretches of slots that are ranked on their own, and cells of the unit
#: interval in which a point looks for its source.
STRETCH = 1 << 14
CELLS = 1 << 12
BUCKETS = 1 << 12
BLOCK_WORDS = 256
#: Slots of a partition of the resampled table: eight million words.
PART_SLOTS = 1 << 15

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def prefix(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds the totals of ``sums`` over all rows before each one in ``order``, in
    two levels: inside a range of rows, and over one row for each range."""
    cut_ = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    zero, upto = F.lit(0), (Window.unboundedPreceding, -1)
    totals = cut_.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    over = Window.orderBy("_range").rowsBetween(*upto)
    base = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(over), zero).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(*upto)
    local = cut_.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()})
    return local.join(base, "_range").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def source_targets(sizes: DataFrame, max_repeats: int = 3, n_weights: int = 3) -> DataFrame:
    """``source, k, source_size, weight, target`` of each source of ``source, size``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    named = prefix(per, ["last", "source"], {"k": F.lit(1)}).withColumn("k", F.col("k") + 1)
    named = named.withColumn("weight", (F.col("k") - 1) % n_weights + 1).withColumn("fill", F.col("source_size") / F.col("weight"))
    filled = prefix(named, ["fill", "k"], {"full_words": max_repeats * F.col("source_size"), "full_weight": F.col("weight")})
    filled = cut(filled)
    words, weight = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # a source stays below its cap if the level without it and those that fill up after it is low enough
    free = filled.withColumn("level", (F.lit(words) - F.col("full_words")) / (F.lit(weight) - F.col("full_weight")))
    is_free = F.col("level") * F.col("weight") <= max_repeats * F.col("source_size")
    water = free.where(is_free).agg(F.min(F.struct("full_weight", "level")).alias("w")).first()["w"]
    cap = (max_repeats * F.col("source_size")).cast("double")
    target = cap if water is None else F.least(cap, F.lit(water["level"]) * F.col("weight"))
    return free.select("source", "k", "source_size", "weight", target.alias("target"))


def positions(sized: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``start``: words of the source before the row in shuffled order.
    ``sized`` has ``k, doc_id, digest, part, size, n`` (``n`` equal rows) and
    more, rows of size 0 excluded; each of ``n`` becomes a row."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    rows = sized.withColumn("h", F.md5(name.cast("binary"))).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    before = lambda w: F.coalesce(F.sum(w[0]).over(w[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = F.col("size") * F.col("n")
    totals = rows.groupBy("k", "bucket").agg(F.sum(words).alias("t"))
    base = totals.select("k", "bucket", before(("t", Window.partitionBy("k").orderBy("bucket"))).alias("base"))
    local = rows.withColumn("local", before((words, Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "size", "digest", "part"))))
    placed = local.join(base, ["k", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return placed.withColumn("start", F.col("base") + F.col("local") + F.col("copy") * F.col("size")).drop("h", "bucket", "base", "local", "copy", "n", "part")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``slot, k, rank, block, words``: what each slot plays, from ``targets``
    (``k, source_size, target``).  ``rank`` counts from 0 in a source and goes
    round its blocks; ``words`` is the block's length, or less for the last
    block that a source plays.  Blocks still owed at the end have slots after
    all others, one source after the other.
    """
    spark = targets.sparkSession
    n_blocks = F.ceil(F.col("source_size") / block_words)
    laps = F.floor(F.col("goal") / F.col("source_size"))
    t = targets.where("target >= 1").select("k", "source_size", "target", F.floor("target").alias("goal"), n_blocks.alias("blocks"))
    t = cut(t.withColumn("need", laps * F.col("blocks") + F.ceil((F.col("goal") - laps * F.col("source_size")) / block_words)))
    n = t.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    edge = lambda x: F.round(x / max(1, n) * GRID).cast("long")
    upto = prefix(t.select("k", "need"), ["k"], {"before": F.col("need")})
    bounds = upto.select("k", edge(F.col("before") + F.col("need")).alias("hi"), edge(F.col("before")).alias("lo"))
    # intervals are found by the cells that they touch: an equi-join, of a few candidates for each cell
    width = GRID // CELLS
    cells = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))
    touched = bounds.where("hi > lo").select("k", "lo", "hi", F.explode(cells).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") % GRID * GOLDEN_STEP % GRID).alias("point"))
    hit = slots.withColumn("cell", F.floor(F.col("point") / width)).join(touched, "cell").where("point >= lo AND point < hi")
    hit = hit.select("slot", "k", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = hit.groupBy("k", "stretch").agg(F.count("*").alias("c"))
    counts = cut(counts.select("k", "stretch", "c", (F.sum("c").over(Window.partitionBy("k").orderBy("stretch")) - F.col("c")).alias("base")))
    local = F.row_number().over(Window.partitionBy("k", "stretch").orderBy("slot")) - 1
    ranked = hit.withColumn("local", local).join(counts, ["k", "stretch"]).select("slot", "k", (F.col("base") + F.col("local")).alias("rank"))
    had = counts.groupBy("k").agg(F.sum("c").alias("had"))
    owed = t.join(had, "k", "left").select("k", "need", F.coalesce("had", F.lit(0)).alias("had")).where("need > had")
    tail = prefix(owed, ["k"], {"after": F.col("need") - F.col("had")}).select("k", "had", "after", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.lit(n) + F.col("after") + F.col("rank") - F.col("had")).alias("slot"), "k", "rank")
    played = ranked.unionByName(tail).join(t, "k").where("rank < need")
    block = F.col("rank") % F.col("blocks")
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    left = F.col("goal") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") - F.col("block") * block_words
    return played.withColumn("block", block).select("slot", "k", "rank", "block", F.least(length, left).alias("words"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot`` of every row.

    ``taken`` counts the words that the schedule plays of a row, repeats
    included: the sum over the blocks that the row overlaps.  ``first_slot`` is
    the slot that first plays the row, null if none does.
    """
    mixed = _mixed(docs, doc_id, text, source, max_repeats, block_words, seed)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, max_repeats: int, block_words: int, seed: int) -> DataFrame:
    """The columns of ``mix``, ``source, digest``, and ``slots``: those that begin
    to play the row, one for each time."""
    read = columns(docs, doc_id, text, source).toDF("doc_id", "text", "source")
    rows = read.select("doc_id", word_count("text").alias("size"), "source", _digest("text").alias("digest"), F.spark_partition_id().alias("part"))
    sized = cut(rows.groupBy("doc_id", "size", "source", "digest", "part").agg(F.count("*").alias("n")))
    targets = cut(source_targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")), max_repeats))
    named = targets.select("k", F.col("source").alias("named"), "source_size", "target")
    keyed = sized.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")
    row = ["k", "doc_id", "size", "digest", "start"]
    placed = positions(keyed.where("size > 0").drop("source_size", "target"), seed)
    # a block is played once for each lap: at most max_repeats times and a part
    plays = schedule(targets, block_words).groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("plays"))
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    pieces = placed.select(*row, F.explode(blocks).alias("block"))
    from_ = F.greatest(F.col("start"), F.col("block") * block_words)
    to = lambda p: F.least(F.col("start") + F.col("size"), F.col("block") * block_words + p["words"])
    own = F.filter("plays", lambda p: to(p) > from_)
    words = F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + to(p) - from_)
    begins = F.when(F.col("block") == F.floor(F.col("start") / block_words), F.transform(own, lambda p: p["slot"]))
    taken = pieces.join(plays, ["k", "block"], "left").select(*row, words.alias("w"), begins.alias("slots"))
    taken = taken.groupBy(*row).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("taken"), F.max("slots").alias("slots")).drop("start")
    none = keyed.where("size = 0").select("k", "doc_id", "size", "digest", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    none = none.withColumn("taken", F.lit(0).cast("long")).withColumn("slots", F.lit(None).cast("array<long>"))
    return taken.unionByName(none).join(named.withColumnRenamed("named", "source"), "k").drop("k")


def resample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, whole, all columns, in
    the order of the schedule: partitions are stretches of ``PART_SLOTS`` slots,
    which play about as many words each, sorted inside.

    Copies are the words taken over the row's size, rounded; they differ from
    the mix by one document for each source at most.  Rows equal in id, text
    and source share what is taken of them.
    """
    mixed = _mixed(docs, doc_id, text, source, max_repeats, block_words, seed)
    slots = F.array(*[F.min(F.get("slots", F.lit(lap))) for lap in range(max_repeats + 1)])
    per_key = mixed.where("size > 0").groupBy("doc_id", "source", "digest").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies"), slots.alias("slots")).where("copies > 0")
    kept = per_key.select(F.col("doc_id").alias("_kept_id"), F.col("source").alias("_kept_source"), F.col("digest").alias("_kept_text"), F.slice("slots", F.lit(1), F.col("copies")).alias("_slots"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    kept = cut(kept)
    last = kept.agg(F.max(F.array_max("_slots"))).first()[0] or 0
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_kept_id")) & F.col(f"`{source}`").eqNullSafe(F.col("_kept_source")) & (F.md5(body) == F.col("_kept_text"))
    played = docs.join(kept, same).withColumn("_slot", F.explode("_slots"))
    dealt = played.repartitionById(last // PART_SLOTS + 1, F.floor(F.col("_slot") / PART_SLOTS).cast("int"))
    return dealt.sortWithinPartitions("_slot").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
         row_number() OVER (ORDER BY source_size / w, source) AS o
  FROM s
), t AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, (SELECT arg_min(level, o) FROM l WHERE level * w <= 3 * source_size) * w) AS target FROM l
), n AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k, floor(target)::BIGINT AS goal, ceil(source_size / 256)::BIGINT AS blocks FROM t
), g AS (
  SELECT *, (goal // source_size * blocks + ceil((goal % source_size) / 256))::BIGINT AS need FROM n WHERE target >= 1
), e AS (
  SELECT *, round(sum(need) OVER (ORDER BY k) / sum(need) OVER () * 2147483648)::BIGINT AS hi,
         round((sum(need) OVER (ORDER BY k) - need) / sum(need) OVER () * 2147483648)::BIGINT AS lo FROM g
), slots AS (
  SELECT i AS slot, (i % 2147483648 * 1327217885) % 2147483648 AS point FROM range((SELECT coalesce(sum(need), 0)::BIGINT FROM g)) r(i)
), hit AS (
  SELECT slot, k, need, blocks, source_size, goal, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM slots JOIN e ON point >= lo AND point < hi
), had AS (
  SELECT g.k, need, blocks, source_size, goal, count(hit.slot) AS had FROM g LEFT JOIN (SELECT k, slot FROM hit) hit ON hit.k = g.k GROUP BY ALL
), owed AS (
  SELECT *, sum(need - had) OVER (ORDER BY k) - (need - had) AS after FROM had WHERE need > had
), played AS (
  SELECT slot, k, blocks, source_size, goal, rank FROM hit WHERE rank < need
  UNION ALL SELECT (SELECT count(*) FROM slots) + after + rank - had, k, blocks, source_size, goal, rank FROM (SELECT *, unnest(range(had, need)) AS rank FROM owed)
), plays AS (
  SELECT slot, k, rank % blocks AS block,
         least(256, source_size - rank % blocks * 256, goal - rank // blocks * source_size - rank % blocks * 256) AS words FROM played
), p AS (
  SELECT row_number() OVER () AS r, doc_id, size, source_size, target, k,
         coalesce(sum(size) OVER (PARTITION BY k ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), doc_id, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
), w AS (
  SELECT r, x.block, slot, least(a + size, x.block * 256 + words) - greatest(a, x.block * 256) AS w, x.block = a // 256 AS first
  FROM (SELECT *, unnest(range(a // 256, (a + size - 1) // 256 + 1)) AS block FROM p WHERE size > 0) x JOIN plays USING (k, block)
), s2 AS (
  SELECT r, sum(w) AS taken, min(slot) FILTER (WHERE first) AS first_slot FROM w WHERE w > 0 GROUP BY r
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM p LEFT JOIN s2 USING (r)
"""
