"""Operator 6: token counts of documents in flat token files without index.

A flat file is a shard's ids, one document after another, each closed by the
end-of-document id, cut into blocks at any place: a Parquet table with the
raw ids of one block in each row.  A scan finds the end ids of a block in one
vectorised comparison; a prefix scan over the blocks of a shard (how many ends
came before, and where the last one was) stitches documents that cross block
edges, over any number of blocks.

Defined results: a document without ids counts 0; ids after the last end of a
shard are a document that is not closed; a null or empty text has no ids; a
null document id stays null, ids keep their type; a very long text crosses as
many blocks as it needs; the string of a special token in a text is ordinary
text, so that no text can hold an end; repeated rows are separate documents; empty tables
give an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import columns, scratch_path, small_batches, table
from .tokens import worker_encoder

END_ID = 50256
BLOCK_TOKENS = 1 << 18
#: Names of documents in one row.
NAMES = 4096

_DDL = "shard int, block int, width int, ids binary, first_doc long"
_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("first_doc", pa.int64())])


def write_flat_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode texts in the order in which they come, a shard for each input
    partition, without a shuffle.  Rows hold either a block of ids or the names
    of the shard's documents in order, which say nothing about where those
    begin."""
    small_batches(docs.sparkSession)
    schema = _SCHEMA.append(pa.field("doc_ids", pa.list_(to_arrow_type(docs.schema[doc_id].dataType))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = worker_encoder(tokenizer, end_id, special_as_text=True), TaskContext.get().partitionId()
        size = block_tokens * encoder.width
        held, block, names, named = bytearray(), 0, [], 0

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, got in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1)), strict=True):
                held += got
                names.append(key)
                while len(held) >= size:
                    yield row(shard, block, encoder.width, bytes(held[:size]), None, None)
                    del held[:size]
                    block += 1
                if len(names) == NAMES:
                    yield row(shard, -1, encoder.width, None, named, names)
                    named, names = named + len(names), []
        if held:
            yield row(shard, block, encoder.width, bytes(held), None, None)
        if names:
            yield row(shard, -1, encoder.width, None, named, names)

    rows = columns(docs, doc_id, text).toDF("doc_id", "text")
    rows.mapInArrow(encode, f"{_DDL}, doc_ids array<{dict(docs.dtypes)[doc_id]}>").write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(16 << 20)).parquet(path)


def read_id_files(spark: SparkSession, path: str, width: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (``shard, block, width, ids``) of raw id files, little-endian ids of
    ``width`` bytes and nothing else; a file is a shard, named by its path.

    A task holds a file at a time, so files should be shards of some hundred
    megabytes; Spark's reader refuses those beyond two gigabytes.  Bytes after
    the last whole id are an error.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_buffer()
                if data.size % width:
                    raise ValueError(f"{batch.column(0)[k].as_py()} has {data.size} bytes, no whole number of ids")
                for n, at in enumerate(range(0, data.size, block_tokens * width)):
                    own = memoryview(data)[at : at + block_tokens * width]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([n], pa.int32()), pa.array([width], pa.int32()), pa.array([own], pa.binary())], ["shard", "block", "width", "ids"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(split, "shard string, block int, width int, ids binary")


def count_tokens(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """``shard, ordinal, start, n_tokens, closed`` of each document in
    ``blocks`` (``shard, block, width, ids``); ``start`` counts ids of the
    shard before it, ends included, and ``n_tokens`` leaves the end out."""
    small_batches(blocks.sparkSession)
    shard_kind = blocks.schema["shard"].dataType
    schema = pa.schema([("shard", to_arrow_type(shard_kind)), ("block", pa.int32()), ("size", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, block, width, data = batch.columns
            ids = [np.frombuffer(data[i].as_buffer(), f"<u{width[i].as_py()}") for i in range(batch.num_rows)]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            yield pa.RecordBatch.from_arrays([shard.cast(schema.field("shard").type), block, pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], schema=schema)

    found = blocks.select("shard", "block", "width", "ids").mapInArrow(scan, f"shard {shard_kind.simpleString()}, block int, size long, ends array<long>")
    order = Window.partitionBy("shard").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = found.withColumn("base", F.coalesce(F.sum("size").over(before), zero)).withColumn("seen", F.coalesce(F.sum(F.size("ends")).over(before), zero))
    last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1) + 1)
    # the scan: where the document that reaches into this block began, and whether anything follows the last end
    carried = placed.withColumn("last", last).withColumn("from", F.coalesce(F.max("last").over(before), zero)).withColumn("final", F.lead("block").over(order).isNull())
    to = F.col("base") + F.col("size")
    ends = F.expr("transform(ends, x -> struct(x + base as at, true as closed))")
    open_ = F.when(F.col("final") & (F.greatest("from", F.coalesce("last", "from")) < to), F.array(F.struct(to.alias("at"), F.lit(False).alias("closed")))).otherwise(F.expr("cast(array() as array<struct<at:bigint,closed:boolean>>)"))
    docs = carried.withColumn("docs", F.concat(ends, open_)).select("shard", "seen", "from", "docs", F.posexplode("docs").alias("k", "d"))
    start = F.when(F.col("k") == 0, F.col("from")).otherwise(F.expr("docs[greatest(k - 1, 0)].at + 1"))
    return docs.select("shard", (F.col("seen") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("d.at") - start).alias("n_tokens"), F.col("d.closed").alias("closed"))


def read_flat_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of ids, and ``shard, ordinal, doc_id`` of the documents in them."""
    rows = spark.read.parquet(path)
    names = rows.where("doc_ids IS NOT NULL").select("shard", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id"))
    return rows.where("ids IS NOT NULL").select("shard", "block", "width", "ids"), names.select("shard", (F.col("first_doc") + F.col("k")).alias("ordinal"), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "flat-files")
    write_flat_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    blocks, names = read_flat_files(spark, path)
    return names.join(count_tokens(blocks), ["shard", "ordinal"]).select("doc_id", "n_tokens")
