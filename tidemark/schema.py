"""Event schemas, status values and settings of the attribution engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: A record as a message log delivers it.  ``arrival_seq`` is a total order
#: inside a partition; lateness depends on it and on nothing else.
ENVELOPE = StructType(
    [
        StructField("topic", StringType()),
        StructField("partition", IntegerType()),
        StructField("offset", LongType()),
        StructField("key", StringType()),
        StructField("value", StringType()),
        StructField("arrival_seq", LongType()),
    ]
)

PAGE_VIEW = StructType([StructField("user_id", StringType()), StructField("event_time", TimestampType()), StructField("url", StringType()), StructField("event_id", StringType())])
AD_CLICK = StructType([StructField("user_id", StringType()), StructField("event_time", TimestampType()), StructField("campaign_id", StringType()), StructField("click_id", StringType())])

#: Output columns; both attribution columns are null or neither is.
OUTPUT = ("page_view_id", "user_id", "event_time", "url", "attributed_campaign_id", "attributed_click_id")
LEDGER_KEY = ("topic", "partition_no", "offset_no")

# Topics, statuses, error types and messages, time format
VIEWS_TOPIC, CLICKS_TOPIC = "page_views", "ad_clicks"

# classes of a click whose id is known
INSERTED, REPLAY, DUPLICATE, CONFLICT = "INSERTED", "REPLAY", "DUPLICATE", "CONFLICT"
# ledger
PROCESSED, DROPPED_LATE, DEAD_LETTER = "PROCESSED", "DROPPED_LATE", "DEAD_LETTER"
# click state, pending views
ACTIVE, EVICTED, PENDING, EMITTED = "ACTIVE", "EVICTED", "PENDING", "EMITTED"
# dead letters
INVALID_RECORD, CLICK_CONFLICT, VIEW_CONFLICT = "INVALID_KAFKA_RECORD", "CLICK_ID_CONFLICT", "PAGE_VIEW_ID_CONFLICT"
RETRY_EXHAUSTED = "PROCESSING_RETRY_EXHAUSTED"
CLICK_CONFLICT_MESSAGE = "The same click_id already exists with different content"
VIEW_CONFLICT_MESSAGE = "The same event_id already exists with different content"

#: Text format of event times: whole seconds, offset optional, UTC without one.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[XXX]"


@dataclass(frozen=True)
class Settings:
    """``allowed_lateness_minutes`` is a whole number from 0 to 15.

    A second view of an id is processed without effect; with ``view_conflicts``
    it is judged as clicks are: the first one wins, another content is a dead
    letter.  ``max_retries`` and ``backoff_seconds`` are of a batch's tables.
    """

    allowed_lateness_minutes: int = 2
    attribution_window_minutes: int = 30
    strict_fields: bool = False
    view_conflicts: bool = False
    max_retries: int = 3
    backoff_seconds: float = 1.0

    def __post_init__(self) -> None:
        lateness = self.allowed_lateness_minutes
        if not isinstance(lateness, int) or isinstance(lateness, bool) or not 0 <= lateness <= 15:
            raise ValueError(f"allowed_lateness_minutes must be a whole number from 0 to 15, not {lateness!r}")
        if self.attribution_window_minutes <= 0:
            raise ValueError("attribution_window_minutes must be positive")
        if self.max_retries < 0 or self.backoff_seconds < 0:
            raise ValueError("max_retries and backoff_seconds must not be negative")
