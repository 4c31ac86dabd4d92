"""Helpers shared by the corpus operators: shared scratch space, table
reading and Arrow batch plumbing.

Scratch tables live below the checkpoint folder of the session
(``spark.checkpoint.dir``), which every executor and the driver can reach.
Tables that a result reads belong to whoever holds the result; those of the
pipeline's stages are removed when the next stage is written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cut, shared_dir

__all__ = ["BATCH_ROWS", "SPACES", "bounded_sample", "columns", "cut", "id_bucket", "map_rows", "remove", "rows_of", "scratch_path", "shared_dir", "small_batches", "table", "to_batch"]

#: Rows of an Arrow batch sent to Python.  Texts may be long, so the default
#: of ten thousand rows could be gigabytes.
BATCH_ROWS = 500

#: Tables of long texts.
TEXTS = ("documents", "conversations")

#: Separators of words, in the sense of ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the Arrow batches that this session sends to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that has fewer splits than the cluster has cores,
    such as a single file, is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names`` of ``df``: other columns can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def id_bucket(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[tuple], Iterable[tuple]]],
) -> DataFrame:
    """Run a row function in Python over Arrow batches.

    ``make`` is called once per task and returns a function from an input row
    (tuple of Python values) to the output rows.  Output leaves in batches of
    bounded size, so a task holds one input batch and one output batch.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        out: list[tuple] = []
        for batch in batches:
            for row in rows_of(batch):
                out += f(row)
                if len(out) >= 4096:
                    yield to_batch(out, arrow)
                    out = []
        if out:
            yield to_batch(out, arrow)

    return df.mapInArrow(run, kind)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch; values become Python objects a row at a time."""
    cols = [batch.column(i) for i in range(batch.num_columns)]
    for i in range(batch.num_rows):
        yield tuple([c[i].as_py() for c in cols])


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


#: Lines of a plan that only reads columns of Parquet files.
_PLAIN = re.compile(r"[ +-]*(Project \[[\w#, ]*\]|Relation \[[\w#, ]*\] parquet)")


def bounded_sample(df: DataFrame, rows: int, seed: int = 17, files: int = 4) -> DataFrame:
    """About ``rows`` rows of ``df``, at most four times as many in expectation.

    Plain columns of a Parquet table are sampled from ``files`` files spread
    over it, so that planning does not scan a large table twice; anything else
    is sampled as a whole.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed().toString().strip().split("\n")
    plain = all(_PLAIN.fullmatch(line) for line in plan)
    paths = sorted(df.inputFiles()) if plain else []
    if len(paths) > files:
        step = len(paths) / files
        df = spark.read.schema(df.schema).parquet(*[paths[int(i * step)] for i in range(files)])
    n = df.count()
    return df if n <= rows else df.sample(fraction=rows / n, seed=seed)
