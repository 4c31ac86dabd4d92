"""From log envelopes to events, ledger rows and dead letters.

Every check is a column: a bad record becomes a row with a reason, never a
failed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import event_type, is_blank, parse_time
from ..schema import AD_CLICK, CLICKS_TOPIC, INVALID_RECORD, PAGE_VIEW, VIEWS_TOPIC

_METADATA = ("partition", "offset")


def _text_fields(topic: str) -> tuple[str, ...]:
    return tuple(f.name for f in (AD_CLICK if topic == CLICKS_TOPIC else PAGE_VIEW).fields if f.name != "event_time")


def parse(records: DataFrame, strict_fields: bool = False) -> DataFrame:
    """Adds ``event_type, event_key, event_time``, the payload's fields and
    ``reason``, null for a valid record.  A record without a value is blank;
    records of other topics are left out.

    An unparsable payload has no key and no time; one that only lacks a
    required field keeps what could be read.  With ``strict_fields``, unknown
    fields make a record invalid; ``partition`` and ``offset`` are tolerated.
    """
    known = records.where(F.col("topic").isin(CLICKS_TOPIC, VIEWS_TOPIC))
    click = F.col("topic") == CLICKS_TOPIC
    names = sorted({*_text_fields(CLICKS_TOPIC), *_text_fields(VIEWS_TOPIC)})
    shape = StructType([StructField(n, StringType()) for n in (*names, "event_time", "_corrupt")])
    read = F.from_json("value", shape, {"columnNameOfCorruptRecord": "_corrupt"})
    # parsed once; the struct is null for a JSON null, and not an object's for anything but "{...}"
    opened = known.withColumn("_read", F.when(F.col("value").rlike("^\\s*\\{"), read))
    is_object = F.col("_read").isNotNull() & F.col("_read._corrupt").isNull()
    fields = opened.select("*", is_object.alias("is_object"), *[F.when(is_object, F.col(f"_read.{n}")).alias(n) for n in names], F.when(is_object, F.col("_read.event_time")).alias("_time"))
    timed = fields.drop("_read").withColumn("event_time", parse_time("_time"))

    def reasons(topic: str) -> Column:
        out = F.when(is_blank("value"), "blank record").when(~F.col("is_object"), "not a JSON object")
        out = out.when(F.col("_time").isNotNull() & F.col("event_time").isNull(), "event_time is not a time")
        for n in _text_fields(topic):
            out = out.when(is_blank(n), f"{n} is missing")
        out = out.when(F.col("event_time").isNull(), "event_time is missing")
        if strict_fields:
            allowed = F.array(*[F.lit(x) for x in (*_text_fields(topic), "event_time", *_METADATA)])
            out = out.when(F.size(F.array_except(F.json_object_keys("value"), allowed)) > 0, "unknown field")
        return out

    checked = timed.withColumn("reason", F.when(click, reasons(CLICKS_TOPIC)).otherwise(reasons(VIEWS_TOPIC)))
    readable = F.col("reason").isNull() | F.col("reason").endswith("is missing")
    return (
        checked.withColumn("event_type", event_type("topic"))
        .withColumn("event_key", F.when(readable, F.when(click, F.col("click_id")).otherwise(F.col("event_id"))))
        .withColumn("event_time", F.when(readable, F.col("event_time")))
        .drop("is_object", "_time")
    )


def invalid_dead_letters(parsed: DataFrame) -> DataFrame:
    """Dead letters of invalid records; they have no ledger row."""
    return parsed.where("reason IS NOT NULL").select(
        "topic",
        F.col("partition").alias("partition_no"),
        F.col("offset").alias("offset_no"),
        "event_type",
        "event_key",
        "event_time",
        F.col("value").alias("payload"),
        F.lit(INVALID_RECORD).alias("error_type"),
        F.col("reason").alias("error_message"),
        F.lit(1).alias("attempt_count"),
    )


def events(parsed: DataFrame) -> DataFrame:
    """Valid records in the shape of the batch operators."""
    click = F.col("topic") == CLICKS_TOPIC
    return parsed.where("reason IS NULL").select(
        F.when(click, "click").otherwise(F.lit("view")).alias("kind"),
        F.when(click, F.col("click_id")).otherwise(F.col("event_id")).alias("id"),
        "user_id",
        F.col("event_time").alias("ts"),
        "campaign_id",
        "url",
        "topic",
        F.col("partition").alias("p"),
        F.col("offset").alias("offset_no"),
        F.col("arrival_seq").alias("arrival"),
        F.col("value").alias("payload"),
    )


def records(parsed: DataFrame) -> DataFrame:
    """All records of a stream in the shape of ``events``, broken ones with their ``reason``."""
    click = F.col("topic") == CLICKS_TOPIC
    return parsed.select(
        F.when(click, "click").otherwise(F.lit("view")).alias("kind"),
        F.col("event_key").alias("id"),
        "user_id",
        F.col("event_time").alias("ts"),
        "campaign_id",
        "url",
        "topic",
        F.col("partition").alias("p"),
        F.col("offset").alias("offset_no"),
        F.col("arrival_seq").alias("arrival"),
        F.col("value").alias("payload"),
        "reason",
    )
