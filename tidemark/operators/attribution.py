"""Attribution: a backward as-of join with tolerance, and its watermarked form.

``rows`` have ``kind`` ('view' or 'click'), ``id``, ``user_id``, ``ts``; clicks
also ``campaign_id``, views also ``url``.  The winner of a view is the greatest
``(ts, id)`` of its user's clicks in ``[ts - window, ts]``, ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import minutes
from .scan import with_min_from
from .watermark import accepted, final_watermarks

_MICRO = 1_000_000


def _micros(time: Column) -> Column:
    """Microseconds of a time; a time without zone counts as UTC."""
    return F.unix_micros(time.cast("timestamp"))


def _bucketed(rows: DataFrame, window: int) -> DataFrame:
    """Rows with ``bucket``, stretches of time as long as the window.  Clicks
    also enter the next one, so a view finds all its clicks in its own; a user
    with very many events is spread over as many tasks as buckets."""
    length = window * 60 * _MICRO
    own = F.floor(_micros(F.col("ts")) / length)
    buckets = F.when(F.col("kind") == "click", F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("bucket", F.explode(buckets))


def _click(ok: Column | None = None) -> Column:
    chosen = F.col("kind") == "click" if ok is None else (F.col("kind") == "click") & ok
    return F.when(chosen, F.struct("ts", F.col("id").alias("click_id"), "campaign_id"))


def attribute(rows: DataFrame, window: int) -> DataFrame:
    """Every view with ``click``, its winner or null: one shuffle, no join."""
    frame = Window.partitionBy("user_id", "bucket").orderBy(_micros(F.col("ts"))).rangeBetween(-window * 60 * _MICRO, Window.currentRow)
    found = _bucketed(rows, window).withColumn("click", F.max(_click()).over(frame))
    return found.where("kind = 'view'").drop("bucket")


def attribute_by_join(views: DataFrame, clicks: DataFrame, window: int) -> DataFrame:
    """The same by an equi-join on user and bucket with a range filter."""
    left = _bucketed(views, window).select("id", "user_id", "ts", "bucket").alias("v")
    right = _bucketed(clicks, window).select("user_id", "bucket", F.col("ts").alias("click_ts"), F.col("id").alias("click_id"), "campaign_id").alias("c")
    near = (F.col("click_ts") <= F.col("ts")) & (F.col("click_ts") >= F.col("ts") - minutes(window))
    pairs = left.join(right, (F.col("v.user_id") == F.col("c.user_id")) & (F.col("v.bucket") == F.col("c.bucket")) & near, "left")
    won = F.max(F.when(F.col("click_id").isNotNull(), F.struct(F.col("click_ts").alias("ts"), "click_id", "campaign_id")))
    return pairs.groupBy("v.id", "v.user_id", "v.ts").agg(won.alias("click"))


def with_emission(rows: DataFrame, lateness: int) -> DataFrame:
    """Adds ``emitted_at``, the place in arrival order of the event that makes
    the row final: the first whose time reaches ``ts`` plus the lateness, or
    the row itself; null while there is none.  The watermark never falls, so
    that is the least place among later times."""
    place = F.struct("arrival", "id")
    first = with_min_from(rows, "_first", place, F.col("ts") + minutes(lateness), ["p"])
    return first.withColumn("emitted_at", F.when(F.col("_first").isNotNull(), F.greatest("_first", place))).drop("_first")


def attribute_watermarked(rows: DataFrame, lateness: int, window: int) -> DataFrame:
    """Emitted views with their winners, exact for ties as well.

    Rows need ``p, arrival``.  A click that arrives after a view was emitted
    can be accepted and in the window only at exactly the view's time, so
    earlier clicks need no check, and clicks of the same time are replayed in
    order of arrival against the place of emission.
    """
    placed = with_emission(accepted(rows, lateness), lateness)
    user = Window.partitionBy("user_id", "bucket")
    before = user.orderBy(_micros(F.col("ts"))).rangeBetween(-window * 60 * _MICRO, -1)
    at = F.when(F.col("kind") == "click", F.struct("arrival", "id")).otherwise(F.col("emitted_at"))
    same = Window.partitionBy("user_id", "bucket", "ts").orderBy("_at", "_view").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _bucketed(placed, window).withColumn("_at", at).withColumn("_view", F.col("kind") == "view")
    found = rows.withColumn("_earlier", F.max(_click()).over(before)).withColumn("_same", F.max(_click()).over(same))
    emitted = found.where("kind = 'view' AND emitted_at IS NOT NULL")
    return emitted.withColumn("click", F.coalesce("_same", "_earlier")).drop("bucket", "_at", "_view", "_earlier", "_same")


def pending_views(rows: DataFrame, lateness: int) -> DataFrame:
    """Accepted views that no watermark has passed yet."""
    ends = final_watermarks(rows).withColumn("wm", F.col("max_event_time") - minutes(lateness)).select("p", "wm")
    return accepted(rows, lateness).where("kind = 'view'").join(ends, "p").where("ts > wm")


def flush_pending(rows: DataFrame, lateness: int, window: int) -> DataFrame:
    """Views that no watermark has passed yet, with their winners among what was
    accepted so far: for the end of a log, or of a partition that went idle."""
    ends = final_watermarks(rows).withColumn("wm", F.col("max_event_time") - minutes(lateness)).select("p", "wm")
    return attribute(accepted(rows, lateness), window).join(ends, "p").where("ts > wm").drop("wm")


def output_rows(attributed: DataFrame) -> DataFrame:
    """Output columns from views with ``click``."""
    return attributed.select(
        F.col("id").alias("page_view_id"),
        "user_id",
        F.col("ts").alias("event_time"),
        "url",
        F.col("click.campaign_id").alias("attributed_campaign_id"),
        F.col("click.click_id").alias("attributed_click_id"),
    )
