"""The input ledger and dead letters of a batch of events.

Each event is judged by what was decided before it.  A click whose id is stored
is a replay or a duplicate, processed without effect, or a conflict, which is a
dead letter; else it is dropped if late, and stored if not.  A view is dropped
if late, whatever its id; a second view of an id is processed without effect.
With ``view_conflicts`` views are judged as clicks are.

A conflict doesn't move the watermark, so lateness depends on earlier verdicts
and those on lateness.  All verdicts are found at once from an assumed set of
events that move watermarks, and again until that set stays: each round is right
about one event more at least, in order of arrival, and the first assumption
(no event that differs from the first of its id) is nearly always right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut
from ..schema import CLICK_CONFLICT, CLICK_CONFLICT_MESSAGE, CLICKS_TOPIC, CONFLICT, DEAD_LETTER, DROPPED_LATE, DUPLICATE, INSERTED, PROCESSED, REPLAY, RETRY_EXHAUSTED, VIEW_CONFLICT, VIEW_CONFLICT_MESSAGE, VIEWS_TOPIC
from .watermark import is_late, with_watermarks

ORDER = ("arrival", "id", "offset_no")


def _click() -> Column:
    return F.col("kind") == "click"


def _content() -> Column:
    return F.struct("user_id", "ts", F.when(_click(), F.col("campaign_id")).otherwise(F.col("url")).alias("detail"))


def _against_first(rows: DataFrame, eligible: Column) -> DataFrame:
    """Adds ``_same, _place, _before, _own``: how a row compares with the first
    eligible one of its id; all are null if there is none."""
    key, place = F.struct("arrival", "offset_no", "p"), F.struct("p", "offset_no")
    first = rows.where(eligible).groupBy("kind", "id").agg(F.min(F.struct(key.alias("key"), place.alias("place"), _content().alias("content"))).alias("_f"))
    joined = rows.join(first, ["kind", "id"], "left")
    known = lambda x: F.when(F.col("_f").isNotNull(), x)
    return joined.withColumns(
        {
            "_same": known(_content().eqNullSafe(F.col("_f.content"))),
            "_place": known(place == F.col("_f.place")),
            "_before": known(key < F.col("_f.key")),
            "_own": known(key == F.col("_f.key")),
        }
    ).drop("_f")


def _judge(rows: DataFrame, lateness: int, view_conflicts: bool) -> DataFrame:
    """Adds ``status, processing_status``, and ``_moves`` as they have it."""
    timed = _against_first(with_watermarks(rows, lateness, F.col("_moves"), ORDER).withColumn("_late", is_late()), ~F.col("_late"))
    like_clicks = F.lit(True) if view_conflicts else _click()
    status = F.when(F.coalesce("_own", F.lit(True)) | F.col("_before"), INSERTED)
    status = status.when(~F.col("_same") & like_clicks, CONFLICT).when(F.col("_place") & F.col("_same"), REPLAY).otherwise(DUPLICATE)
    # an id that isn't stored yet: the row is stored or late
    late = F.when(like_clicks, F.coalesce("_before", F.lit(True))).otherwise(F.col("_late"))
    judged = timed.withColumn("status", status)
    fate = F.when(F.col("status") == CONFLICT, DEAD_LETTER).when(late, DROPPED_LATE).otherwise(PROCESSED)
    return judged.withColumns({"processing_status": fate, "_was": F.col("_moves"), "_moves": F.col("status") != CONFLICT}).drop("_same", "_place", "_before", "_own", "wm_before", "wm_after")


def input_ledger(rows: DataFrame, lateness: int, view_conflicts: bool = False) -> DataFrame:
    """``rows`` (events) with ``status``, the class of their id, and
    ``processing_status``."""
    differs = ~F.coalesce("_same", F.lit(True)) & (F.lit(True) if view_conflicts else _click())
    current = _against_first(rows, F.lit(True)).withColumn("_moves", ~differs).drop("_same", "_place", "_before", "_own")
    while True:
        judged = cut(_judge(current, lateness, view_conflicts))
        # a late event moves nothing, counted or not
        if judged.where("_moves <> _was AND NOT _late").isEmpty():
            return judged.drop("_moves", "_was", "_late")
        current = judged.drop("_was", "_late", "status", "processing_status")


def topic_of() -> Column:
    return F.when(_click(), CLICKS_TOPIC).otherwise(VIEWS_TOPIC)


def conflict_letters(ledger: DataFrame) -> DataFrame:
    """Dead letters of conflicting ids; ``payload`` is null if the ledger has none."""
    payload = F.col("payload") if "payload" in ledger.columns else F.lit(None).cast("string")
    return ledger.where(F.col("status") == CONFLICT).select(
        topic_of().alias("topic"),
        F.col("p").alias("partition_no"),
        "offset_no",
        topic_of().alias("event_type"),
        F.col("id").alias("event_key"),
        F.col("ts").alias("event_time"),
        payload.alias("payload"),
        F.when(_click(), CLICK_CONFLICT).otherwise(VIEW_CONFLICT).alias("error_type"),
        F.when(_click(), CLICK_CONFLICT_MESSAGE).otherwise(VIEW_CONFLICT_MESSAGE).alias("error_message"),
        F.lit(1).alias("attempt_count"),
    )


def exhausted_letters(refused: DataFrame, max_retries: int = 3) -> DataFrame:
    """Dead letters of output rows that the table refused (``problem`` is the
    root cause) however often they were written; they have the place in the log
    of their view if ``refused`` has ``topic, p, offset_no``."""
    place = lambda c, kind: F.col(c) if c in refused.columns else F.lit(None).cast(kind)
    return refused.select(
        place("topic", "string").alias("topic"),
        place("p", "long").alias("partition_no"),
        place("offset_no", "long").alias("offset_no"),
        F.lit(VIEWS_TOPIC).alias("event_type"),
        F.col("page_view_id").alias("event_key"),
        "event_time",
        place("payload", "string").alias("payload"),
        F.lit(RETRY_EXHAUSTED).alias("error_type"),
        F.col("problem").alias("error_message"),
        F.lit(max_retries + 1).alias("attempt_count"),
    )
