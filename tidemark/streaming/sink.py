"""Idempotent tables of a stream: a replayed micro-batch replaces itself.

Each batch writes to its own folder, ``batch_id=<n>``, with overwrite.  Output
rows are unique before they come here (``exact.guarded``).  Ledger rows and dead
letters are keyed by their place in the log and meet only the stored rows of the
same stretch of offsets: the files' statistics leave all others unread.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.columns import format_time
from ..schema import LEDGER_KEY, OUTPUT, Settings

_TABLES = {
    "output": "page_view_id STRING, user_id STRING, event_time TIMESTAMP, url STRING, attributed_campaign_id STRING, attributed_click_id STRING",
    "ledger": "topic STRING, partition_no LONG, offset_no LONG, event_type STRING, event_key STRING, event_time TIMESTAMP, status STRING, processing_status STRING, processed_at TIMESTAMP",
    "dead_letter": "topic STRING, partition_no LONG, offset_no LONG, event_type STRING, event_key STRING, event_time TIMESTAMP, payload STRING, error_type STRING, error_message STRING, attempt_count LONG",
    "ledger_history": "topic STRING, partition_no LONG, offset_no LONG, event_type STRING, event_key STRING, event_time TIMESTAMP, status STRING, processing_status STRING, processed_at TIMESTAMP, archived_at TIMESTAMP",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A sink table as written so far, without its batch numbers."""
    return _all(spark, root, name).drop("batch_id")


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _all(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = StructType.fromDDL(f"{_TABLES[name]}, batch_id LONG")
    fs, path = _folder(spark, f"{root}/{name}")
    return spark.read.schema(schema).parquet(f"{root}/{name}") if fs.exists(path) else spark.createDataFrame([], schema)


def _append(batch: DataFrame, root: str, name: str, batch_id: int) -> None:
    if name != "output":
        key = list(LEDGER_KEY)
        rest = [c for c in batch.columns if c not in key]
        batch = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*").select(*batch.columns)
        low, high = batch.agg(F.min("offset_no"), F.max("offset_no")).first()
        if low is not None:
            # places that moved to the history still count as recorded
            for table in [name, "ledger_history"] if name == "ledger" else [name]:
                stored = _all(batch.sparkSession, root, table).where((F.col("batch_id") != batch_id) & F.col("offset_no").between(low, high))
                batch = batch.join(stored.select(*key), key, "left_anti")
    batch.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def split(records: DataFrame) -> dict[str, DataFrame]:
    """The three tables of tagged records."""
    time_ = F.timestamp_micros("ts").alias("event_time")
    place = ["topic", F.col("p").alias("partition_no"), "offset_no", F.col("topic").alias("event_type"), F.col("id").alias("event_key"), time_]
    kind = F.col("record_kind")
    return {
        "output": records.where(kind == "output").select(F.col("id").alias("page_view_id"), "user_id", time_, "url", F.col("campaign_id").alias("attributed_campaign_id"), F.col("click_id").alias("attributed_click_id")),
        "ledger": records.where(kind == "ledger").select(*place, "status", "processing_status", F.current_timestamp().alias("processed_at")),
        "dead_letter": records.where(kind == "dead_letter").select(*place, "payload", "error_type", "error_message", "attempt_count"),
    }


def json_lines(output: DataFrame) -> DataFrame:
    """Output rows as one column ``value`` of JSON text, nulls written out."""
    fields = [format_time(c).alias(c) if c == "event_time" else F.col(c).cast("string").alias(c) for c in OUTPUT]
    return output.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def start_json_lines(output: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of output rows to text files of JSON lines."""
    return json_lines(output).writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint).start(path)


def batch_writer(root: str, settings: Settings | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a batch's tables; a failed attempt is repeated ``max_retries``
    times, each of which replaces what the last one left."""
    s = settings or Settings()

    def attempt(records: DataFrame, batch_id: int) -> None:
        records.persist()
        try:
            for name, rows in split(records).items():
                _append(rows, root, name, batch_id)
        finally:
            records.unpersist()

    def write(records: DataFrame, batch_id: int) -> None:
        for left in range(s.max_retries, -1, -1):
            try:
                return attempt(records, batch_id)
            except Exception:
                if not left:
                    raise
                time.sleep(s.backoff_seconds)

    return write


def start(records: DataFrame, root: str, checkpoint: str, available_now: bool = False, settings: Settings | None = None) -> StreamingQuery:
    """Run a tagged stream into tables below ``root``.  Offsets are acknowledged
    (in the checkpoint) only after a batch's tables are written."""
    writer = records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch_writer(root, settings))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def archive_ledger(spark: SparkSession, root: str, now: datetime, retention_hours: int = 12) -> int:
    """Moves batches of ledger rows that are all past retention to the history:
    copy, count, delete.  Returns the number of rows moved.  A run that breaks
    off is repeated: copies replace themselves, deletions come last."""
    live = _all(spark, root, "ledger")
    ages = live.groupBy("batch_id").agg(F.max("processed_at").alias("last"), F.count("*").alias("n"))
    moved = 0
    for batch_id, n in ((r["batch_id"], r["n"]) for r in ages.where(F.col("last") < F.lit(now - timedelta(hours=retention_hours))).collect()):
        to = f"{root}/ledger_history/batch_id={batch_id}"
        live.where(F.col("batch_id") == batch_id).drop("batch_id").withColumn("archived_at", F.lit(now)).write.mode("overwrite").parquet(to)
        if (found := spark.read.parquet(to).count()) != n:
            raise RuntimeError(f"{n} ledger rows of batch {batch_id}, but {found} in the history")
        fs, path = _folder(spark, f"{root}/ledger/batch_id={batch_id}")
        fs.delete(path, True)
        moved += n
    return moved
