"""Operator 3: token ids in binary blocks with Elias-Fano document boundaries.

File format: a Parquet table, one row per block, in ascending order of shard
and block, so that Spark's commit protocol makes each task's output appear
once or not at all.  A block holds the concatenated ids of consecutive
documents as raw little-endian integers, and the boundaries of its documents
as an Elias-Fano sequence: ``low_bits`` low bits of each boundary packed side
by side, the high parts in unary in a bit vector, and the position of every
64th one bit, from which select starts.  That is about ``2 + log2(tokens /
documents)`` bits for each document in place of 64.

Defined results: a null or empty text is the end id alone; rows with equal ids
are ordered by the hash of their texts; null ids come first and ids keep their
type; the string of a special token in a text is that token, as the library has
it; a text longer than a block has a block of its own; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import columns, scratch_path, small_batches, table
from .tokens import worker_encoder

#: Ids of a block before it is closed; a longer document has its own block.
BLOCK_TOKENS = 1 << 19
#: One bits between two entries of the select directory.
SAMPLE = 64

_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class EliasFano:
    """A sorted sequence of integers from 0 to ``last``, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        last = int(v[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits(((v[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        packed = np.frombuffer(self.low, np.uint8)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = packed[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value number ``i``, by the directory and a scan of at most a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        high = np.frombuffer(self.high, np.uint8)
        at = int(np.frombuffer(self.directory, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        here = int(high[byte]) >> (at & 7) << (at & 7)
        while (ones := int(_ONES[here])) <= left:
            left -= ones
            byte += 1
            here = int(high[byte])
        for _ in range(left):
            here &= here - 1
        one = byte * 8 + (here & -here).bit_length() - 1
        return (one - i << self.low_bits) + int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        i = np.arange(self.n)
        return (np.flatnonzero(bits)[: self.n] - i << self.low_bits) + self._low(i)


_FIELDS = (
    ("shard", "int", pa.int32()),
    ("block", "int", pa.int32()),
    ("first_token", "long", pa.int64()),
    ("n_tokens", "long", pa.int64()),
    ("n_docs", "int", pa.int32()),
    ("width", "int", pa.int32()),
    ("ids", "binary", pa.binary()),
    ("low_bits", "int", pa.int32()),
    ("low", "binary", pa.binary()),
    ("high", "binary", pa.binary()),
    ("directory", "binary", pa.binary()),
)  # and doc_ids, an array of the table's type of ids
_BLOCK = pa.schema([(n, t) for n, _, t in _FIELDS])
_DDL = ", ".join(f"{n} {t}" for n, t, _ in _FIELDS)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text of ``docs`` and write blocks in ascending id order.

    One range shuffle of the texts by id; shard ``k`` holds the ``k``-th range.
    The ranges come from Spark's bounded sample of keys; two more keys, the hash
    of the text and the row's place in the input, let rows of one id, and equal
    rows too, spread over several shards.
    """
    small_batches(docs.sparkSession)
    schema = _BLOCK.append(pa.field("doc_ids", pa.list_(to_arrow_type(docs.schema[doc_id].dataType))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = worker_encoder(tokenizer, end_id), TaskContext.get().partitionId()
        block, first, held, ids, size = 0, 0, [], [], [0]

        def close() -> pa.RecordBatch:
            ef = EliasFano.encode(np.array(size))
            row = (shard, block, first, size[-1], len(held), encoder.width, b"".join(ids), ef.low_bits, ef.low, ef.high, ef.directory, held)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, got in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1)), strict=True):
                if held and size[-1] + len(got) // encoder.width > BLOCK_TOKENS:
                    yield close()
                    block, first, held, ids, size = block + 1, first + size[-1], [], [], [0]
                held.append(key)
                ids.append(got)
                size.append(size[-1] + len(got) // encoder.width)
        if held:
            yield close()

    rows = columns(docs, doc_id, text).toDF("doc_id", "text")
    tie = F.xxhash64("text")
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("doc_id", tie, "place").sortWithinPartitions("doc_id", tie, "text")
    blocks = ordered.drop("place").mapInArrow(encode, f"{_DDL}, doc_ids array<{dict(docs.dtypes)[doc_id]}>")
    blocks.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(16 << 20)).parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32`` and, if
    asked for, ``ids``.  ``start`` counts the ids of all documents before it.

    Offsets inside a shard are in the files; only one number per shard, its
    total, goes through a prefix sum and is broadcast.  The writer's range
    shuffle makes at most ``spark.sql.shuffle.partitions`` shards.
    """
    small_batches(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    base = totals.select("shard", (F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("base"))
    kinds = [("shard", pa.int32()), ("doc_id", to_arrow_type(kind)), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int64()))] * with_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {f.name: batch.column(k)[i] for k, f in enumerate(batch.schema)}
                edges = EliasFano(x["n_docs"].as_py() + 1, x["low_bits"].as_py(), x["low"].as_py(), x["high"].as_py(), x["directory"].as_py()).all()
                ids = np.frombuffer(x["ids"].as_buffer(), f"<u{x['width'].as_py()}")
                wide = memoryview(ids.astype("<u4"))
                cuts = edges.tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                n = len(crc)
                cols = [np.full(n, x["shard"].as_py(), np.int32), x["doc_ids"].values.cast(schema.field("doc_id").type), edges[:-1] + x["first_token"].as_py(), np.diff(edges), np.array(crc, np.int64)]
                if with_ids:
                    cols.append([ids[a:b].astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    needed = blocks.select("shard", "first_token", "n_docs", "width", "doc_ids", "ids", "low_bits", "low", "high", "directory")
    rows = needed.mapInArrow(decode, f"shard int, doc_id {kind.simpleString()}, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    extra = ["ids"] if with_ids else []
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
