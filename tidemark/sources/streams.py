"""Streams of log envelopes: Kafka topics, or files of envelopes.

Kafka's connector is a package of its own; without it on the class path,
``from_kafka`` fails when it is called, and the file source does the same work.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLICKS_TOPIC, ENVELOPE, VIEWS_TOPIC


def kafka_options(servers: str, topics: tuple[str, ...] = (CLICKS_TOPIC, VIEWS_TOPIC), max_per_trigger: int | None = None, min_partitions: int | None = None) -> dict[str, str]:
    """Earliest offsets, committed records only; offsets are kept in the
    query's checkpoint, never committed to the brokers."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "kafka.isolation.level": "read_committed", "failOnDataLoss": "true"}
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return options


def from_kafka(spark: SparkSession, servers: str, extra: Mapping[str, str] | None = None, **more) -> DataFrame:
    """Envelopes of both topics; arrival order inside a partition is that of
    log append times, then topic and offset, the only order that a replay
    of two topics can repeat."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, **more), **(extra or {})).load()
    return raw.select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        (F.unix_millis("timestamp") * 2 + (F.col("topic") == VIEWS_TOPIC).cast("long")).alias("arrival_seq"),
    )


def from_files(spark: SparkSession, path: str, max_files: int | None = 1) -> DataFrame:
    """Envelopes from JSON files, oldest first, ``max_files`` for each trigger."""
    reader = spark.readStream.schema(ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)
